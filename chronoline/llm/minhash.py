"""MinHash near-duplicates with tensored banding.

Two collections of SIDE small hash collisions (HALF minhash values each) are computed per document; the SIDE x SIDE
table keys are all pairs of one collision from either, so 2 x SIDE x HALF minhash values serve SIDE^2 tables of
2 x HALF values. At a similarity of 0.75 a pair shares no table with probability under 0.003, at 0.85 under 2e-5.

Documents of equal shingle sets collapse to one class first (a third of all rows may be one copy). Table keys are
formed only of collisions that two classes share: a key that two classes share needs both. The tables are worked through
in SLICES parts. In a bucket the ends of every component found so far are paired with the ends of the bucket's least and
greatest component, never with all; candidate pairs whose 32 minhash values agree in fewer than FLOOR places (by their
low 16 bits) are dropped (at 0.75 a chance of 1e-6), the others are confirmed on full sets, which are built where a pair
is tested from compressed texts, and their links join components before the next part begins.

All pairs of a bucket of up to three documents are tested by that. What a larger bucket has in several components at the
end is compared by a prefix filter, which is exact: of two sets that meet the similarity, the first shingles in a common
order (rare ones first; so many that the rest cannot reach the similarity) share one. Shingles that many documents share
are dealt in blocks of BLOCK documents, and a pair of one component is never listed. So no two documents of a bucket stay
untested unless a chain of links joins them already.

Ids are integers. A null or empty text, or one without words, has an empty set and links with nothing, as has a row
without an id. Texts of under five words are one shingle. Rows that share an id are one document: they give a row each
and are in one component even where their texts differ. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import MIX, Weights, chunks, connected_components, drop_settled, frugal, mix64, release, settle, spread_join, text_bytes

WEIGHTS = Weights(0x9E3779B97F4A7C15)
SIDE, HALF, FLOOR, SLICES = 8, 2, 10, 2
#: Counters (a power of two) by which shingles are ordered, documents in a block, rows in a task of the prefix filter.
CELLS, BLOCK, ROWS = 1 << 18, 1024, 100_000


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each row, concatenated and sorted by row, and the offsets of the rows."""
    n = len(raw)
    low = raw + np.where((raw >= 65) & (raw <= 90), 32, 0).astype(np.uint8)
    gap = (low == 32) | ((low >= 9) & (low <= 13))
    new = np.ones(n + 1, bool)
    new[1:n] = gap[1:] != gap[:-1]
    new[offsets] = True
    at = np.flatnonzero(new)
    keep = ~gap[at[:-1]] if n else np.zeros(0, bool)
    starts, ends = at[:-1][keep], at[1:][keep]
    word = WEIGHTS.spans(low, starts, ends, 1)[0]
    cut = np.searchsorted(starts, offsets)
    salt = mix64(np.arange(1, width + 1, dtype=np.uint64) * MIX) | np.uint64(1)
    out, sizes = [], np.zeros(len(offsets) - 1, np.int64)
    full = np.zeros(max(0, len(word) - width + 1), np.uint64)
    for k in range(width):
        full += word[k : k + len(full)] * salt[k]
    full = mix64(full)
    for i, (a, b) in enumerate(zip(cut.tolist(), cut[1:].tolist())):
        if b - a >= width:
            sets = np.unique(full[a : b - width + 1])
        elif b > a:
            sets = mix64((word[a:b] * salt[: b - a]).sum(keepdims=True) + np.uint64(b - a))
        else:
            continue
        out.append(sets)
        sizes[i] = len(sets)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def signatures(sets: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of 2 x SIDE x HALF minhash values; rows of empty sets are zero."""
    out = np.zeros((len(cuts) - 1, 2 * SIDE * HALF), np.int64)
    rows = np.flatnonzero(cuts[1:] > cuts[:-1])
    if len(rows):
        starts = cuts[rows]
        for k in range(out.shape[1]):
            a, b = mix64(np.array([2 * k + 1, 2 * k + 2], np.uint64) * MIX)
            v = (sets ^ b) * (a | np.uint64(1))
            out[rows, k] = np.minimum.reduceat(v ^ (v >> np.uint64(29)), starts).view(np.int64)
    return out


def collisions(mins: np.ndarray) -> np.ndarray:
    """Hashes of the 2 x SIDE small collisions of each row; the lowest bit names the collection."""
    m = mins.view(np.uint64).reshape(len(mins), 2 * SIDE, HALF)
    h = np.broadcast_to(mix64(np.arange(1, 2 * SIDE + 1, dtype=np.uint64) * MIX), m.shape[:2])
    for k in range(HALF):
        h = mix64((h ^ m[:, :, k]) * np.uint64(0xD6E8FEB86659FD93) + MIX)
    return ((h & ~np.uint64(1)) | (np.arange(2 * SIDE) >= SIDE).astype(np.uint64)).view(np.int64)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)), pa.array(values.ravel()))


def _sign(width: int):
    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, 1 << 19):
                sets, cuts = shingle_sets(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], width)
                mins = signatures(sets, cuts)
                sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum(np.stack([mix64(sets + MIX), mix64(sets ^ MIX)]), axis=1)], axis=1)
                total = sums[:, cuts[1:]] - sums[:, cuts[:-1]]
                arrays = [pa.array(np.diff(cuts)), *(pa.array(x.view(np.int64)) for x in total), _lists(collisions(mins)), _lists(mins.astype(np.int16))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *arrays], names=["doc_id", "n_shingles", "h1", "h2", "halves", "sketch"])

    return frugal(run)


def _pack(batches):
    """Texts compressed one by one: less than half of what a shuffle of texts would move, a quarter of their sets."""
    squeeze = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        raw, offsets = text_bytes(batch.column(1))
        cuts = offsets.tolist()
        view = memoryview(raw)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([squeeze.compress(view[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["doc_id", "packed"])


def _test(percent: int, width: int):
    """Pairs (a, b) whose packed texts meet the similarity on their full shingle sets."""

    def run(batches):
        widen = zstandard.ZstdDecompressor()
        for batch in batches:
            packed = [x for pair in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()) for x in pair]
            keep = np.zeros(batch.num_rows, bool)
            sizes = np.array([len(x) for x in packed], np.int64)
            for i, j in chunks(np.concatenate([[0], np.cumsum(sizes[::2] + sizes[1::2])]), 1 << 19):
                texts = [widen.decompress(x) for x in packed[2 * i : 2 * j]]
                sets, cuts = shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), width)
                cuts = cuts.tolist()
                for k in range(j - i):
                    both = np.sort(sets[cuts[2 * k] : cuts[2 * k + 2]], kind="stable")
                    common = int((both[1:] == both[:-1]).sum())
                    keep[i + k] = common > 0 and 100 * common >= percent * (len(both) - common)
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(pa.array(keep)) for k in (0, 1)], names=["a", "b"])

    return frugal(run)


def near_duplicates(docs: DataFrame, percent: int = 75, width: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row: documents linked by 100 x intersection >= percent x union."""
    source = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    signed = settle(source.mapInArrow(_sign(width), "doc_id long, n_shingles long, h1 long, h2 long, halves array<long>, sketch array<short>"))
    has_set = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    filled = signed.where(has_set)
    classes = settle(filled.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    reps = settle(filled.join(classes, (filled.doc_id == classes.rep) & (filled.h1 == classes.h1) & (filled.h2 == classes.h2), "left_semi").dropDuplicates(["doc_id", "h1", "h2"]).select("doc_id", "halves", "sketch"))
    sides = _sides(reps)
    links, spent, tested = _same_id(filled, classes), [reps, sides], None
    parts = connected_components(links)
    for part in range(SLICES):
        apart, heads = _buckets(sides, parts, part)
        met = spread_join(apart, heads, ["key"], "n", ["component"])
        cross = lambda x, y: [F.struct(F.least(u, v).alias("a"), F.greatest(u, v).alias("b")) for u, v in ((f"{x}first", f"{y}last"), (f"{x}last", f"{y}first"))]
        against = lambda end: F.when(F.col("component") != F.col(f"{end}.component"), F.array(*cross("", f"{end}."))).otherwise(F.array().cast("array<struct<a:long,b:long>>"))
        pairs = met.select(F.explode(F.array_distinct(F.concat(against("low"), against("high")))).alias("e")).select("e.*").distinct()
        near = settle(_agreeing(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), reps))
        found = _confirm(near, source, percent, width)
        tested, links = near if tested is None else tested.union(near), links.union(found)
        spent += [near, found, parts]
        parts = connected_components(links)
        for table in (apart, heads):
            drop_settled(table)
        release(spark)
    rest = _untested(sides, parts, source, percent, width)
    if rest is not None:
        near = settle(_agreeing(rest.join(tested, ["a", "b"], "left_anti"), reps))
        found = _confirm(near, source, percent, width)
        spent += [rest, near, found, parts]
        parts = connected_components(links.union(found))
        release(spark)
    verdict = settle(classes.join(parts, F.col("rep") == F.col("node"), "left").select("h1", "h2", "copies", F.coalesce("component", "rep").alias("component_id")))
    for table in [*spent, classes, parts]:
        drop_settled(table)
    cols = ["doc_id", "n_shingles", "component_id"]
    own = spread_join(filled.select("doc_id", "n_shingles", "h1", "h2"), verdict, ["h1", "h2"], "copies", [F.monotonically_increasing_id()]).select(cols)
    bare = signed.where(~F.coalesce(has_set, F.lit(False))).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return own.union(bare).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(filled: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the classes of rows that share an id but not a text."""
    ids = settle(filled.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x <> y").select("doc_id"))
    rows = filled.join(ids, "doc_id").select("doc_id", "h1", "h2").distinct().join(classes, ["h1", "h2"])
    return settle(rows.groupBy("doc_id").agg(F.collect_set("rep").alias("r")).select(F.array_min("r").alias("a"), F.explode("r").alias("b")).where("a <> b"))


def _sides(reps: DataFrame) -> DataFrame:
    """(doc_id, halves): the small collisions that a document shares with another one, settled."""
    single = reps.select("doc_id", F.explode("halves").alias("half"))
    shared = settle(single.groupBy("half").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).where("low < high").select("half", "n"))
    release(reps.sparkSession)
    sides = settle(spread_join(single, shared, ["half"], "n", ["doc_id"]).groupBy("doc_id").agg(F.collect_set("half").alias("halves")))
    drop_settled(shared)
    release(reps.sparkSession)
    return sides


def _keyed(sides: DataFrame, parts: DataFrame, part: int) -> DataFrame:
    """(doc_id, component, key): the keys of one part of the tables, all pairs of a document's collisions of either collection."""
    side = lambda k: F.filter("halves", lambda x: x.bitwiseAND(F.lit(1)) == k)
    keys = F.flatten(F.transform(side(0), lambda x: F.transform(side(1), lambda y: F.xxhash64(x, y))))
    return _named(sides, parts).select("doc_id", "component", F.explode(F.filter(keys, lambda k: F.pmod(k, F.lit(SLICES)) == part)).alias("key"))


def _buckets(sides: DataFrame, parts: DataFrame, part: int) -> tuple[DataFrame, DataFrame]:
    """The components of each bucket with their least and greatest document, and of buckets of several the end components."""
    apart = settle(_keyed(sides, parts, part).groupBy("key", "component").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")))
    whole = F.struct("component", "first", "last")
    heads = settle(apart.groupBy("key").agg(F.min(whole).alias("low"), F.max(whole).alias("high"), F.count("*").alias("n")).where("n > 1"))
    return apart, heads


def _named(d: DataFrame, parts: DataFrame) -> DataFrame:
    """d with the component of its doc_id."""
    return d.join(parts.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _unpacked(column: pa.Array, width: int):
    """Parts of a column of packed texts: the first row, the shingle sets and the offsets of the rows."""
    widen = zstandard.ZstdDecompressor()
    packed = column.to_pylist()
    for i, j in chunks(np.concatenate([[0], np.cumsum([len(x) for x in packed])]).astype(np.int64), 1 << 18):
        texts = [widen.decompress(x) for x in packed[i:j]]
        yield i, *shingle_sets(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64), width)


def _cell(sets: np.ndarray) -> np.ndarray:
    return (sets & np.uint64(CELLS - 1)).astype(np.int64)


def _tally(width: int):
    """How many shingles of the sets fall in each cell."""

    def run(batches):
        counts = np.zeros(CELLS, np.int64)
        for batch in batches:
            for _, sets, _ in _unpacked(batch.column(1), width):
                counts += np.bincount(_cell(sets), minlength=CELLS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["cell", "n"])

    return frugal(run)


def _prefixes(percent: int, width: int, counts: np.ndarray):
    """The first shingles of each set in the common order: all but those that cannot be a similar pair's first common one."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for i, sets, cuts in _unpacked(batch.column(1), width):
                sizes = np.diff(cuts)
                row = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((sets, counts[_cell(sets)], row))
                at = np.arange(len(sets)) - np.repeat(cuts[:-1], sizes)
                least = np.maximum(-(-percent * sizes // 100), 1)
                keep = at <= np.repeat(sizes - least, sizes)
                columns = [sets[order][keep].view(np.int64), ids[i + row[keep]], sizes[row[keep]], at[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["shingle", "doc_id", "size", "at"])

    return frugal(run)


def _matches(percent: int):
    """Pairs of several components that share a shingle and may meet the similarity if it is their first common one."""

    def run(table):
        shingle, x, y, doc, size, at, component = (table.column(k).to_numpy() for k in ("shingle", "x", "y", "doc_id", "size", "at", "component"))
        order = np.lexsort((y, x, shingle))
        shingle, x, y, doc, size, at, component = (v[order] for v in (shingle, x, y, doc, size, at, component))
        new = (shingle[1:] != shingle[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
        cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(doc)]])
        out = [np.zeros((2, 0), np.int64)]
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            for k in range(i, j, 256):  # a block of many documents in strips: bounded memory
                s = slice(k, min(k + 256, j))
                most = np.minimum.outer(size[s] - at[s], size[i:j] - at[i:j])
                may = (doc[s, None] < doc[i:j]) & (component[s, None] != component[i:j]) & (most * (100 + percent) >= percent * np.add.outer(size[s], size[i:j]))
                a, b = np.nonzero(may)
                out.append(np.stack([doc[s][a], doc[i:j][b]]))
            if sum(v.shape[1] for v in out[-64:]) > 1_000_000:
                out = [np.unique(np.concatenate(out, axis=1), axis=1)]
        a, b = np.unique(np.concatenate(out, axis=1), axis=1)
        return pa.table({"a": a, "b": b})

    return run


def _untested(sides: DataFrame, parts: DataFrame, source: DataFrame, percent: int, width: int) -> DataFrame | None:
    """Pairs of several components that may be similar, of all documents of buckets that the ends of components may have left untested; null if none are."""
    spark = sides.sparkSession
    ids = None
    for part in range(SLICES):
        keyed = settle(_keyed(sides, parts, part))
        open_ = settle(keyed.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y and n > 3").select("key", "n"))
        some = settle(spread_join(keyed, open_, ["key"], "n", ["doc_id"]).select("doc_id").distinct())
        ids = some if ids is None else ids.union(some)
        drop_settled(keyed)
        drop_settled(open_)
    ids = settle(ids.distinct())
    if ids.isEmpty():
        drop_settled(ids)
        return None
    texts = settle(source.where("doc_id is not null").mapInArrow(frugal(_pack), "doc_id long, packed binary").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "packed"]))
    release(spark)
    counts = np.zeros(CELLS, np.int32)
    tally = texts.mapInArrow(_tally(width), "cell long, n long").groupBy("cell").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()
    counts[tally.column("cell").to_numpy()] = tally.column("n").to_numpy()
    first = settle(_named(texts.mapInArrow(_prefixes(percent, width, counts), "shingle long, doc_id long, size long, at long"), parts))
    shared = first.groupBy("shingle").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("n")).where("x < y")
    shared = settle(shared.select("shingle", "n", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")))
    dealt = spread_join(first, shared, ["shingle"], "n", ["doc_id"]).withColumn("block", F.pmod(F.xxhash64("doc_id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = settle(dealt.select("shingle", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "doc_id", "size", "at", "component"))
    tasks = max(1, dealt.count() // ROWS)
    out = settle(dealt.groupBy(F.pmod(F.xxhash64("shingle", "x", "y"), F.lit(tasks)).alias("task")).applyInArrow(_matches(percent), "a long, b long").distinct())
    for table in (ids, texts, first, shared, dealt):
        drop_settled(table)
    release(spark)
    return out


def _agreeing(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose minhash values agree in FLOOR places or more."""
    a, b = reps.select(F.col("doc_id").alias("a"), F.col("sketch").alias("x")), reps.select(F.col("doc_id").alias("b"), F.col("sketch").alias("y"))
    same = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return pairs.join(a, "a").join(b, "b").where(same >= FLOOR).select("a", "b")


def _confirm(pairs: DataFrame, source: DataFrame, percent: int, width: int) -> DataFrame:
    """Pairs that meet the similarity on their full shingle sets. Ids are settled first: their size is then known to the
    planner, which broadcasts them if they are few (the session's limit) and else shuffles the compressed texts."""
    spark = pairs.sparkSession
    ids = settle(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = settle(source.where("doc_id is not null").mapInArrow(frugal(_pack), "doc_id long, packed binary").join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id", "packed"]))
    release(spark)
    x, y = texts.select(F.col("doc_id").alias("a"), F.col("packed").alias("x")), texts.select(F.col("doc_id").alias("b"), F.col("packed").alias("y"))
    found = settle(pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_test(percent, width), "a long, b long").distinct())
    drop_settled(texts)
    drop_settled(ids)
    return found
