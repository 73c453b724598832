"""Exact removal of repeated byte strings with suffix arrays built by linear grouping.

`suffix_arrays` sorts the suffixes of many strings at once, each string by the grouping construction: suffixes are
grouped by their first byte, the groups of a string are processed in descending order, each splits the groups that its
members' previous-smaller pointers lead to, and in the end every group holds the suffixes of one Lyndon prefix; a
second pass emits the order within each group from the order of the suffixes that follow. Nothing is renamed
recursively. All strings of a batch take each step together, in numpy.

`remove_repeats` finds what the arrays must hold: every window of `length` bytes belongs to the anchor that it selects
(its gram of least hash), so equal windows have equal anchors. Runs of windows of an anchor that occurs once cannot
repeat. Equal runs collapse to one with a count, by aggregation. The distinct runs of an anchor are sorted together and
a window repeats where its neighbour in the array shares `length` bytes. Keys that many rows share (copies of a text,
a passage of thousands of documents) are dealt to many tasks in every join. An anchor with more than MOST distinct runs is
never gathered: its runs are cut again by longer grams, in the end by the whole window, which needs counting only.

Null texts are empty. Texts shorter than `length` lose nothing. Repeated rows repeat each other. An empty table gives
an empty result; extra columns are ignored. All bytes of equal windows are removed, overlaps and first copies included.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import MIX, Powers, chunks, drop_settled, frugal, mix64, ragged_take, release, settle, spread_join, text_bytes

POWERS = Powers(0xC2B2AE3D27D4EB4F)
GRAMS, MOST, BATCH, STEP = (100, 150, 180, 195), 64, 600_000, 1 << 18


def segments(raw: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """Runs of windows of `length` bytes that share an anchor, the leftmost `gram`-gram of least hash within the window.

    Returns (row, start, run, lead, anchor, body): the run's first window, the number of its windows, the anchor's place
    after `start`, and hashes of the anchor's bytes and of all bytes that the run's windows cover, with the lead.
    """
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty, empty, empty, empty, empty.view(np.uint64), empty.view(np.uint64)
    prefix = POWERS.prefix((raw.astype(np.uint64) + np.uint64(1)) * MIX)
    at = np.arange(n - gram + 1)
    hashes = (prefix[gram:] - prefix[: n - gram + 1]) * POWERS.upto(n + 1)[1][: n - gram + 1] * MIX
    hashes ^= hashes >> np.uint64(31)
    hashes *= np.uint64(0xBF58476D1CE4E5B9)
    keyed = ((hashes >> np.uint64(24)) << np.uint64(24)) | at.astype(np.uint64) if n < 1 << 24 else None
    width = length - gram + 1
    if keyed is None:  # one very long row: order by hash, then by place
        keyed = np.empty(len(at), np.uint64)
        keyed[np.lexsort((at, hashes))] = at.astype(np.uint64)
    low, size = keyed, 1
    while 2 * size <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    low = np.minimum(low[: len(low) - (width - size)], low[width - size :])
    if n < 1 << 24:
        place = (low & np.uint64((1 << 24) - 1)).astype(np.int64)
    else:
        back = np.empty(len(at), np.int64)
        back[keyed.astype(np.int64)] = at
        place = back[low.astype(np.int64)]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(place)]
    inside = np.arange(len(place)) + length <= offsets[row + 1]
    change = np.ones(len(place), bool)
    change[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1]) | (inside[1:] != inside[:-1])
    first = np.flatnonzero(change)
    run = np.diff(np.append(first, len(place)))
    keep = inside[first]
    first, run = first[keep], run[keep]
    anchor, lead = hashes[place[first]], place[first] - first
    body = mix64(POWERS.span(prefix, first, first + run - 1 + length) + lead.astype(np.uint64) * MIX)
    return row[first], first - offsets[row[first]], run, lead, anchor, body


def suffix_arrays(text: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The suffixes of each string text[bounds[k]:bounds[k+1]] in order, as places in text.

    Every string ends in a symbol smaller than all others in it, which occurs in it once.
    """
    n = len(text)
    string = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    key = string.astype(np.int64) * 512 + text
    sa = np.argsort(key, kind="stable").astype(np.int32)
    new = np.ones(n, bool)
    new[1:] = key[sa[1:]] != key[sa[:-1]]
    starts = np.flatnonzero(new)
    group = np.empty(n, np.int32)  # of a suffix: the first slot of its group
    group[sa] = np.repeat(starts, np.diff(np.append(starts, n)))
    slot = np.empty(n, np.int32)
    slot[sa] = np.arange(n)
    size = np.zeros(n, np.int32)
    size[starts] = np.diff(np.append(starts, n))
    before = np.full(n, -1, np.int32)  # previous suffix of the string with a smaller group
    low = bounds[:-1].astype(np.int32)
    cursor = bounds[1:].astype(np.int32).copy()
    live = np.flatnonzero(cursor > low)
    while len(live):
        ends = cursor[live]
        first = group[sa[ends - 1]]
        cursor[live] = first
        members = sa[ragged_take(first.astype(np.int64), (ends - first).astype(np.int64))]
        mine = np.repeat(first, ends - first)
        floor = np.repeat(low[live], ends - first)
        live = live[first > low[live]]
        prev = members - 1
        todo = np.flatnonzero(prev >= floor)
        prev[prev < floor] = -1
        while len(todo):
            at = prev[todo]
            here = group[at]
            go = here >= mine[todo]
            todo, at, here = todo[go], at[go], here[go]
            up = np.where((here > mine[todo]) | (before[at] >= 0), before[at], at - 1)
            up[up < floor[todo]] = -1
            prev[todo] = up
            todo = todo[up >= 0]
        before[members] = prev
        prev = prev[prev >= 0]
        if not len(prev):
            continue
        prev.sort()
        edge = np.ones(len(prev), bool)
        edge[1:] = prev[1:] != prev[:-1]
        at = np.flatnonzero(edge)
        who, count = prev[at], np.diff(np.append(at, len(prev)))
        home = group[who]
        order = np.lexsort((count, home))
        who, count, home = who[order], count[order], home[order]
        edge = np.ones(len(who), bool)
        edge[1:] = home[1:] != home[:-1]
        at = np.flatnonzero(edge)
        taken = np.diff(np.append(at, len(who)))
        heads = home[at]
        end = heads + size[heads]
        goal = (np.repeat(end - taken - at, taken) + np.arange(len(who))).astype(np.int32)
        # suffixes that stand where others must go take the places these leave
        was = slot[who]
        tail = np.repeat(end - taken, taken)
        leaving = np.sort(was[was < tail])
        if len(leaving):
            here = np.zeros(0, bool)
            held = sa[goal]
            slot[who] = -1
            stay = slot[held] >= 0
            moved, free = held[stay], leaving
            sa[free] = moved
            slot[moved] = free
        sa[goal] = who
        slot[who] = goal
        edge[1:] |= count[1:] != count[:-1]
        at = np.flatnonzero(edge)
        length = np.diff(np.append(at, len(who)))
        size[heads] -= taken
        size[goal[at]] = length
        group[who] = np.repeat(goal[at], length)
    # order within groups: the suffix before one that is placed goes next to its group's head
    out = np.full(n, -1, np.int32)
    head = np.zeros(n, np.int32)
    placed = np.zeros(n, bool)
    out[low] = bounds[1:] - 1
    placed[bounds[1:] - 1] = True
    live = np.arange(len(low))
    i, s = low.copy(), (bounds[1:] - 2).astype(np.int32)
    stop = bounds[1:].astype(np.int32)
    while len(live):
        ok = s >= low[live]
        ok[ok] = ~placed[s[ok]]
        now = s[ok]
        g = group[now]
        at = g + head[g]
        head[g] += 1
        out[at] = now
        placed[now] = True
        s[ok] = before[now]
        off = ~ok
        i[off] += 1
        done = i >= stop[live]
        if done.any():
            keep = ~done
            live, i, s, off = live[keep], i[keep], s[keep], off[keep]
        s[off] = out[i[off]] - 1
    return out


def repeated_windows(bodies: list[bytes], sizes: np.ndarray, length: int) -> list[np.ndarray]:
    """For each body, which of its windows occur elsewhere among the bodies of its set; sizes: bodies in each set."""
    lengths = np.array([len(b) for b in bodies], np.int64)
    raw = np.frombuffer(b"".join(bodies), np.uint8)
    gaps = np.arange(len(bodies))
    place = np.cumsum(lengths) - lengths + gaps
    last = np.cumsum(sizes) - 1
    set_of = np.repeat(np.arange(len(sizes)), sizes)
    place = place + set_of
    n = len(raw) + len(bodies) + len(sizes)
    text = np.ones(n, np.int32)
    text[ragged_take(place, lengths)] = raw.astype(np.int32) + 2
    ends = place[last] + lengths[last] + 1
    text[ends] = 0
    bounds = np.concatenate([[0], ends + 1])
    sa = suffix_arrays(text, bounds)
    prefix = POWERS.prefix((text.astype(np.uint64) + np.uint64(1)) * MIX)
    whole = np.zeros(n, bool)
    count = np.maximum(lengths - length + 1, 0)
    whole[ragged_take(place, count)] = True
    names = np.zeros(n, np.uint64)
    at = np.flatnonzero(whole)
    names[at] = POWERS.span(prefix, at, at + length)
    a, b = sa[:-1], sa[1:]
    same = whole[a] & whole[b] & (names[a] == names[b])
    edge = np.zeros(n, bool)
    edge[bounds[1:-1] - 1] = True
    same &= ~edge[: n - 1]
    hit = np.zeros(n, bool)
    hit[a[same]] = True
    hit[b[same]] = True
    return [hit[p : p + c] for p, c in zip(place.tolist(), count.tolist())]


def _runs(length: int, gram: int, wanted: str):
    """Rows of runs of the batch's texts; wanted: 'anchor', or 'all' columns."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(2))
            for i, j in chunks(offsets, STEP):
                row, start, count, lead, anchor, body = segments(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                cols = {"anchor": pa.array(anchor.view(np.int64))}
                if wanted == "all":
                    cols |= {"r1": batch.column(0).take(pa.array(row + i)), "r2": batch.column(1).take(pa.array(row + i)), "start": pa.array(start.astype(np.int32)), "run": pa.array(count.astype(np.int32)), "body": pa.array(body.view(np.int64))}
                if len(anchor):
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def _recut(length: int, gram: int):
    """Runs cut again by a longer gram; a gram of the whole window gives each window for itself."""

    def run(batches):
        for batch in batches:
            bodies = [x.as_py() for x in batch.column(3)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in bodies])]).astype(np.int64)
            raw = np.frombuffer(b"".join(bodies), np.uint8)
            base = batch.column(2).to_numpy()
            for i, j in chunks(offsets, STEP):
                row, start, count, lead, anchor, body = segments(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], length, gram)
                at = pa.array(row + i)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array((base[row + i] + start).astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(anchor.view(np.int64)), pa.array(body.view(np.int64)), pa.array([bodies[r][s : s + c + length - 1] for r, s, c in zip((row + i).tolist(), start.tolist(), count.tolist())], pa.binary())], names=["top", "whole", "at", "run", "anchor", "body", "bytes"])

    return run


def _judge(length: int):
    """Distinct runs sorted by anchor, set by set, to (anchor, body, hits): bits of the windows that repeat."""

    def run(batches):
        anchors, bodies, data, total = [], [], [], 0

        def emit(upto: int):
            key = np.array(anchors[:upto])
            edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            hits = []
            sizes = np.diff(np.append(edge, upto))
            width = np.add.reduceat(np.array([len(x) for x in data[:upto]]), edge)
            order = np.argsort(width, kind="stable")  # strings of like length take their steps together
            index = ragged_take(edge[order], sizes[order])
            flags = [None] * upto
            at, k = 0, 0
            while k < len(order):
                m, chars = k, 0
                while m < len(order) and (m == k or chars + width[order[m]] <= BATCH):
                    chars += width[order[m]]
                    m += 1
                take = index[at : at + int(sizes[order[k:m]].sum())]
                for i, f in zip(take.tolist(), repeated_windows([data[i] for i in take.tolist()], sizes[order[k:m]], length)):
                    flags[i] = f
                at, k = at + len(take), m
            hits = [np.packbits(f, bitorder="little").tobytes() for f in flags]
            return pa.RecordBatch.from_arrays([pa.array(anchors[:upto], pa.int64()), pa.array(bodies[:upto], pa.int64()), pa.array(hits, pa.binary())], names=["anchor", "body", "hits"])

        for batch in batches:
            anchors += batch.column(0).to_pylist()
            bodies += batch.column(1).to_pylist()
            data += batch.column(2).to_pylist()
            total = sum(map(len, data))
            if total >= 8 * BATCH:
                upto = len(anchors)
                while upto and anchors[upto - 1] == anchors[-1]:
                    upto -= 1
                if upto:
                    yield emit(upto)
                    anchors, bodies, data = anchors[upto:], bodies[upto:], data[upto:]
        if anchors:
            yield emit(len(anchors))

    return run


def _judged(runs: DataFrame, length: int) -> DataFrame:
    """(anchor, body, hits) of the distinct runs (anchor, body, bytes), all of an anchor in one partition and in order."""
    return runs.select("anchor", "body", "bytes").repartition("anchor").sortWithinPartitions("anchor", "body").mapInArrow(frugal(_judge(length)), "anchor long, body long, hits binary")


def _verdicts(sized: DataFrame, length: int, grams: tuple[int, ...]) -> DataFrame:
    """Which windows of each distinct run repeat: (anchor, body, n, run, bytes), n runs in its set, to (anchor, body, hits).

    Sets of up to MOST runs are sorted; larger sets are cut by longer grams.
    """
    out = _judged(sized.where(F.col("n") <= MOST), length)
    large = sized.where(F.col("n") > MOST)
    if large.isEmpty():
        return out
    parts = large.select(F.col("anchor").alias("top"), F.col("body").alias("whole"), F.lit(0).alias("at"), "bytes")
    schema = "top long, whole long, at int, run int, anchor long, body long, bytes binary"
    found = None
    for gram in (*grams, length):
        cut = settle(parts.mapInArrow(frugal(_recut(length, gram)), schema))
        counted = settle(cut.groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"))
        cut = settle(spread_join(cut, counted, ["anchor"], "many", ["top", "whole", "at"]))
        own = settle(cut.groupBy("anchor", "body").agg(F.count("*").alias("many"), F.min("run").alias("run"), F.min("bytes").alias("bytes")))
        sets = settle(own.groupBy("anchor").agg(F.count("*").alias("n"), F.count("*").alias("w")))
        own = settle(spread_join(own, sets, ["anchor"], "w", ["body"]))
        some = _judged(own.where((F.col("n") > 1) & (F.col("n") <= MOST)), length)
        known = own.where((F.col("n") <= MOST) | (F.lit(gram) == length)).select("anchor", "body", "many", F.col("many").alias("w")).join(some, ["anchor", "body"], "left")
        hit = spread_join(cut, settle(known), ["anchor", "body"], "w", ["top", "whole", "at"])
        hit = settle(hit.select("top", "whole", "at", "run", F.when(F.col("many") > 1, F.lit(None).cast("binary")).otherwise(F.col("hits")).alias("hits")))
        found = hit if found is None else found.union(hit)
        rest = own.where((F.col("n") > MOST) & (F.lit(gram) != length)).select("anchor", "body", "many")
        if gram == length or rest.isEmpty():
            break
        parts = spread_join(cut, rest, ["anchor", "body"], "many", ["top", "whole", "at"]).select("top", "whole", "at", "bytes")

    def merge(batches):
        for batch in batches:
            out = []
            for size, spans in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                flags = np.zeros(size, bool)
                for x in spans or []:
                    bits = np.ones(x["run"], bool) if x["hits"] is None else np.unpackbits(np.frombuffer(x["hits"], np.uint8), bitorder="little")[: x["run"]].astype(bool)
                    flags[x["at"] : x["at"] + x["run"]] |= bits
                out.append(np.packbits(flags, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["anchor", "body", "hits"])

    spans = found.groupBy("top", "whole").agg(F.collect_list(F.struct("at", "run", "hits")).alias("spans"))
    joined = large.select("anchor", "body", "run").join(spans, (F.col("anchor") == F.col("top")) & (F.col("body") == F.col("whole")), "left").select("anchor", "body", "run", "spans")
    return out.union(joined.mapInArrow(merge, "anchor long, body long, hits binary"))


def _apply(length: int, keep: bool):
    """Rows with their spans of windows to what is left of them."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            out = []
            for k, spans in enumerate(batch.column(2).to_pylist()):
                own = raw[offsets[k] : offsets[k + 1]]
                n = len(own)
                if not spans:
                    data = own.tobytes()
                    out.append((n, 0, 0, hashlib.sha256(data).hexdigest(), data.decode() if keep else None))
                    continue
                edge = np.zeros(n + 1, np.int32)
                for x in spans:
                    if x["hits"] is None:
                        edge[x["start"]] += 1
                        edge[x["start"] + x["run"] - 1 + length] -= 1
                    else:
                        at = x["start"] + np.flatnonzero(np.unpackbits(np.frombuffer(x["hits"], np.uint8), bitorder="little")[: x["run"]])
                        np.add.at(edge, at, 1)
                        np.add.at(edge, at + length, -1)
                gone = np.cumsum(edge[:n]) > 0
                left = own[~gone].tobytes()
                out.append((n, int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore") if keep else None))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())))], names=["row", "text", *ADDED])

    return run


ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text")


def remove_repeats(docs: DataFrame, length: int = 200, text: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_sha256 and kept_text: without the bytes of strings of `length` bytes that start elsewhere too.

    Columns of docs with one of these names are replaced. kept_text is the text of the remaining bytes; a character of
    which only a part remains is left out of it (not out of the digest of the remaining bytes).
    """
    spark = docs.sparkSession
    others = [F.col(f"`{c}`") for c in docs.columns if c != text and c.lower() not in ADDED]
    row = F.struct(*others) if others else F.struct(F.lit(None).cast("int").alias("none"))
    # equal texts share an identity of 128 bits: their spans are the same
    plain = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.xxhash64(plain).alias("r1"), F.xxhash64(F.lit(1), plain).alias("r2"), F.col(text).alias("text"), row.alias("row"))
    texts, rid, spread = source.select("r1", "r2", "text"), ["r1", "r2"], [F.to_json("row")]
    copies = settle(source.groupBy(*rid).agg(F.count("*").alias("copies")).where("copies > 1"))
    anchors = settle(texts.mapInArrow(frugal(_runs(length, GRAMS[0], "anchor")), "anchor long").groupBy("anchor").agg(F.count("*").alias("many")).where("many > 1"))
    release(spark)
    runs = texts.mapInArrow(frugal(_runs(length, GRAMS[0], "all")), "anchor long, r1 long, r2 long, start int, run int, body long")
    runs = settle(spread_join(runs, anchors, ["anchor"], "many", ["r1", "start"]))
    drop_settled(anchors)
    release(spark)
    bodies = settle(runs.groupBy("anchor", "body").agg(F.count("*").alias("many"), F.min(F.struct("r1", "r2", "start", "run")).alias("one")))
    sets = settle(bodies.groupBy("anchor").agg(F.count("*").alias("n"), F.count("*").alias("w")).where("n > 1"))
    distinct = settle(spread_join(bodies, sets, ["anchor"], "w", ["body"]))
    drop_settled(sets)
    release(spark)
    wanted = settle(distinct.select("one.r1", "one.r2", F.struct("anchor", "body", "n", "one.start", "one.run").alias("s")).groupBy(*rid).agg(F.collect_list("s").alias("wanted")))
    piece = lambda raw, s: F.struct(s["anchor"].alias("anchor"), s["body"].alias("body"), s["n"].alias("n"), s["run"].alias("run"), F.substring(raw, s["start"] + 1, s["run"] + (length - 1)).alias("bytes"))
    cut = F.flatten(F.transform(F.array(F.encode("text", "UTF-8")), lambda raw: F.transform("wanted", lambda s: piece(raw, s))))  # encoded once a text
    pieces = settle(spread_join(source, wanted, rid, "copies", spread, counts=copies).select(F.explode(cut).alias("e")).select("e.*").dropDuplicates(["anchor", "body"]))
    drop_settled(wanted)
    release(spark)
    verdicts = settle(_verdicts(pieces, length, GRAMS[1:]))
    drop_settled(pieces)
    release(spark)
    # what has no verdict occurs as a whole elsewhere
    known = settle(distinct.where("many = 1").select("anchor", "body").join(verdicts, ["anchor", "body"], "left").select("anchor", "body", F.coalesce("hits", F.lit(b"")).alias("hits")))
    placed = spread_join(runs, known, ["anchor", "body"], "many", ["r1", "start"], "left", counts=bodies)
    lists = placed.select(*rid, F.struct("start", "run", "hits").alias("s")).where("s.hits is null or hex(s.hits) rlike '[1-9A-F]'").groupBy(*rid).agg(F.collect_set("s").alias("spans"))
    lists = settle(lists)
    for table in (runs, bodies, distinct, verdicts, known):
        drop_settled(table)
    release(spark)
    schema = source.select("row", "text").withColumns({c: F.lit(0).cast("long") for c in ADDED[:3]} | {c: F.lit(None).cast("string") for c in ADDED[3:]}).schema
    out = spread_join(source, lists, rid, "copies", spread, "left", counts=copies).select("row", "text", "spans").mapInArrow(frugal(_apply(length, keep_text)), schema)
    return out.select(*(["row.*"] if others else []), F.col("text").alias(text), *ADDED)
