"""Hierarchical residual packing of tokenized documents into sequences of a fixed capacity.

Each partition packs its items best-fit, longest first, and emits its nearly full bins; bins with room travel on as
items and are packed again in ever fewer partitions. A node of the tree takes at most FAN x CARRY bins: what a node
holds beyond CARRY leaves it as finished, fullest first, so no node grows with the corpus and nothing is dropped.

Null texts are empty documents of one token (the end mark); repeated rows are packed once each; an empty table packs
into nothing; extra columns are ignored; long documents are cut into pieces of the whole capacity.
"""

from __future__ import annotations

import bisect
import json
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.bpe import Merges
from chronoline.llm.shared import chunks, frugal, settle, text_bytes
from chronoline.llm.words import WordTable, code_points, odd_rows, split

NODE, FAN, CARRY, SLACK = 16_384, 8, 16_384, 8
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """A tokenizer file of the tokenizers library: BPE with word ends over lower-cased words.

    Distinct words are folded by the file's merges; a row with a code point that a normalizer may join to another, or
    with a contraction, goes to the library whole. Ids are the library's (tests hold both against each other).
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        ids, end = model["vocab"], model["end_of_word_suffix"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        merged = [(ids[x], ids[y], ids[x + y]) for x, y in pairs]
        assert all(p[2] < q[2] for p, q in zip(merged, merged[1:])), "ids of merges must rise with their ranks"
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        letters = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.inner, self.last = (np.array([ids[letters[b] + x] for b in range(256)], np.int32) for x in ("", end))
        self.merges = Merges(merged)
        self.lower = np.array([ord(x) if len(x := chr(i).lower()) == 1 else i for i in range(0x3000)], np.uint32)
        self.table = WordTable(self.encode_words)

    def base(self, matrix: np.ndarray) -> np.ndarray:
        ids = self.inner[matrix]
        ids[:, -1] = self.last[matrix[:, -1]]
        return ids

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.merges.fold_words([w.encode() for w in words], self.base)

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        cp, bounds = code_points(raw, offsets)
        odd = odd_rows(cp, bounds, normalized=True)
        starts, ends = split(cp, bounds, spaced=False)
        cp = np.where(cp < len(self.lower), self.lower[np.minimum(cp, len(self.lower) - 1)], cp)
        ids, size = self.table.ids(cp, starts, ends)
        word = np.concatenate([[0], np.cumsum(size)])
        cut = word[np.searchsorted(starts, bounds)]
        for i in range(len(offsets) - 1):
            if odd[i]:
                yield np.array(self.tokenizer.encode(raw[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids, np.uint32)
            else:
                yield ids[cut[i] : cut[i + 1]]


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The token pieces of whole documents: (doc_id, piece, start, length, ids_crc32); only documents over the capacity are cut."""

    def run(batches):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            keys = batch.column(0).to_pylist()
            out = []
            for i, j in chunks(offsets, 1 << 19):
                for k, ids in enumerate(encoder(path).encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), i):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    for p, s in enumerate(range(0, len(ids), capacity)):
                        part = ids[s : s + capacity]
                        out.append((keys[k], p, s, len(part), zlib.crc32(part.tobytes())))
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), PIECE)


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of item indices: longest item first, each into the fullest bin that holds it; ties by index."""
    bins: list[list[int]] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_rooms: list[int] = []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(open_rooms, size)
        if at == len(open_rooms):
            b, left = len(bins), capacity - size
            bins.append([i])
        else:
            left = open_rooms[at]
            b = room[left].pop()
            if not room[left]:
                open_rooms.pop(at)
            bins[b].append(i)
            left -= size
        if left:
            if not room[left]:
                bisect.insort(open_rooms, left)
            room[left].append(b)
    return bins


BIN = "node long, done boolean, fill long, items array<struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long>>"


def pack_round(bins: DataFrame, capacity: int, last: bool) -> DataFrame:
    """Best fit within each node; bins with at most SLACK tokens of room, and those beyond CARRY, are done."""

    def run(table: pa.Table) -> pa.Table:
        fill = table.column("fill").to_numpy()
        order = np.lexsort((table.column("tie").to_numpy(), -fill))
        table, fill = table.take(pa.array(order)), fill[order]
        packed = best_fit(fill, capacity)
        lists = table.column("items").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        starts, ends = lists.offsets.to_numpy()[:-1], lists.offsets.to_numpy()[1:]
        total = np.array([fill[b].sum() for b in packed], np.int64)
        done = total >= capacity - SLACK
        open_bins = np.flatnonzero(~done)
        done[open_bins[np.argsort(total[open_bins], kind="stable")][CARRY:]] = True
        done |= last
        take = np.concatenate([np.arange(starts[i], ends[i]) for b in packed for i in b])
        cuts = np.concatenate([[0], np.cumsum([sum(ends[i] - starts[i] for i in b) for b in packed])])
        values = lists.values.take(pa.array(take))  # fields that the input says are never null are so no longer
        items = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.StructArray.from_arrays(values.flatten(), names=[f.name for f in values.type]))
        node = pa.array(np.full(len(packed), table.column("node")[0].as_py() // FAN, np.int64))
        return pa.Table.from_arrays([node, pa.array(done), pa.array(total), items], names=["node", "done", "fill", "items"])

    return bins.withColumn("tie", F.xxhash64("items")).groupBy("node").applyInArrow(run, BIN)


def pack(items: DataFrame, capacity: int = 2048) -> DataFrame:
    """items (doc_id, piece, start, length, ids_crc32) with sequence_id and offset added; full pieces are sequences by themselves."""
    packed_item = F.struct("doc_id", "piece", "start", "length", "ids_crc32")
    whole = items.where(F.col("length") >= capacity).select(F.lit(0).cast("long").alias("node"), F.lit(True).alias("done"), F.col("length").alias("fill"), F.array(packed_item).alias("items"))
    rest = items.where(F.col("length") < capacity)
    nodes = max(1, -(-rest.count() // NODE))
    now = rest.select(F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(nodes)).alias("node"), F.lit(False).alias("done"), F.col("length").alias("fill"), F.array(packed_item).alias("items"))
    finished = [whole]
    while True:
        after = settle(pack_round(now, capacity, nodes == 1))
        finished.append(after.where("done"))
        if nodes == 1:
            break
        now, nodes = after.where("not done"), -(-nodes // FAN)
    out = finished[0]
    for part in finished[1:]:
        out = out.unionByName(part)
    before = F.transform("items", lambda _, i: F.aggregate(F.slice("items", 1, i), F.lit(0).cast("long"), lambda acc, x: acc + x["length"]))
    laid = out.withColumn("sequence_id", F.monotonically_increasing_id()).select("sequence_id", F.explode(F.arrays_zip("items", before.alias("offset"))).alias("e"))
    return laid.select("e.items.*", "sequence_id", "e.offset")


def pack_documents(df: DataFrame, path: str, capacity: int = 2048, end: int = 0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Tokenized pieces of whole documents, each with its sequence and its place there, gapless from 0."""
    return pack(settle(pieces(df, path, capacity, end, key, text)), capacity)
