"""Byte-level BPE encoding and decoding by a ranked vocabulary.

The ranked merges are folded over the byte arrays of *distinct* words, all words of a length at once; the rank map is
built from the vocabulary file, a fixed table. Ids of distinct words are laid out again in the order of the text, and
decoding concatenates the binary pieces of the ids. `fold_sql` is the same fold as one Spark column expression.

Nulls encode as the empty text (no ids); an empty table gives an empty result; extra columns are not touched and
columns of clashing names are replaced; equal rows stay separate rows; texts are encoded whole, whatever their length.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import chunks, ragged_take, text_bytes
from chronoline.llm.words import WordTable, code_points, odd_rows, split

NONE = 1 << 30
LONG = 48


@lru_cache(4)
def ranks_of(lines: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines.splitlines() if x.strip())}


class Merges:
    """Pairs of ids that join into one id; the id is also the rank of the merge. A fixed table, open addressing in numpy."""

    def __init__(self, pairs: list[tuple[int, int, int]]):
        a, b, values = (np.array(x, np.uint64) for x in zip(*pairs))
        keys = (a << np.uint64(32)) | b
        self.bits = max(4, len(keys).bit_length() + 3)
        self.slots, self.joint = np.full(1 << self.bits, (1 << 64) - 1, np.uint64), np.full(1 << self.bits, NONE, np.int32)
        probe, left = 0, np.arange(len(keys))
        while len(left):
            at = self._slot(keys[left], probe)
            free = np.flatnonzero(self.joint[at] == NONE)
            free = free[np.unique(at[free], return_index=True)[1]]
            self.slots[at[free]], self.joint[at[free]] = keys[left[free]], values[left[free]]
            left = np.delete(left, free)
            probe += 1

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = (keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keys = ((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)).ravel()
        out = np.full(len(keys), NONE, np.int32)
        left, probe = np.arange(len(keys)), 0
        while len(left):
            at = self._slot(keys if probe == 0 else keys[left], probe)
            held = self.slots[at]
            hit = held == (keys if probe == 0 else keys[left])
            out[left[hit]] = self.joint[at[hit]]
            left = left[~hit & (self.joint[at] != NONE)]
            probe += 1
        return out.reshape(a.shape)

    def fold(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of byte ranks, merged pair by pair (the pair of least rank, leftmost on ties): the merged rows and their sizes."""
        n, width = ids.shape
        out, size = ids.copy(), np.full(n, width)
        rows = np.arange(n)
        rank = self.joined(ids[:, :-1], ids[:, 1:])
        while len(rows) and ids.shape[1] > 1:
            where = rank.argmin(1)
            line = np.arange(len(rows))
            best = rank[line, where]
            on = best != NONE
            if not on.all():
                off = rows[~on]
                out[off, : ids.shape[1]] = ids[~on]
                size[off] = ids.shape[1]
                rows, ids, rank, where, best = rows[on], ids[on], rank[on], where[on], best[on]
                line = np.arange(len(rows))
            if not len(rows):
                break
            width = ids.shape[1] - 1
            cols = np.arange(width)
            ids = np.take_along_axis(ids, cols + (cols > where[:, None]), 1)
            ids[line, where] = best
            rank = np.take_along_axis(rank, cols[:-1] + (cols[:-1] >= where[:, None]), 1)
            for step in (-1, 0):  # only the pairs beside the merged one change
                at = where + step
                ok = np.flatnonzero((at >= 0) & (at < width - 1))
                if len(ok):
                    rank[ok, at[ok]] = self.joined(ids[ok, at[ok]], ids[ok, at[ok] + 1])
        if len(rows):
            out[rows, : ids.shape[1]] = ids
            size[rows] = ids.shape[1]
        return out, size

    def fold_words(self, raw: list[bytes], base) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, concatenated, and their numbers. base: from a matrix of bytes, a word a row, to one of ids."""
        total = np.zeros(len(raw), np.int64)
        sizes: dict[int, list[int]] = {}
        for i, w in enumerate(raw):
            sizes.setdefault(len(w), []).append(i)
        folded = []
        for width, at in sizes.items():
            if not width:
                continue
            ids = base(np.frombuffer(b"".join([raw[i] for i in at]), np.uint8).reshape(len(at), width))
            if width > LONG:
                rows = [self.fold_long(x) for x in ids.tolist()]
                size = np.array([len(x) for x in rows])
                ids = np.zeros((len(rows), size.max()), np.int32)
                for x, row in zip(ids, rows):
                    x[: len(row)] = row
            else:
                ids, size = self.fold(ids)
            total[at] = size
            folded.append((np.array(at), ids, size))
        start = np.cumsum(total) - total
        flat = np.zeros(int(total.sum()), np.uint32)
        for at, ids, size in folded:
            flat[ragged_take(start[at], size)] = ids[np.arange(ids.shape[1]) < size[:, None]]
        return flat, total

    def fold_long(self, ids: list[int]) -> list[int]:
        """The same merges for one long word, by a heap over a linked list: n log n."""
        n = len(ids)
        ids, after, before, alive = list(ids), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        first = self.joined(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        known: dict[tuple[int, int], int] = {}

        def pair(i: int) -> int:
            if after[i] >= n:
                return NONE
            key = ids[i], ids[after[i]]
            if key not in known:
                known[key] = int(self.joined(np.array(key[:1]), np.array(key[1:]))[0])
            return known[key]

        heap = [(r, i) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if not alive[i] or pair(i) != r:
                continue
            j = after[i]
            ids[i], alive[j], after[i] = r, False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (r := pair(k)) != NONE:
                    heapq.heappush(heap, (r, k))
        return [x for x, a in zip(ids, alive) if a]


class Vocabulary:
    """A rank file: pieces by rank, and the rank of the joint piece for every pair of ranks that joins into one."""

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="ascii") as f:
            self.rank = ranks_of(f.read())
        self.pattern = regex.compile(pattern.replace(r"\s+(?!\S)|\s+", r"[\p{White_Space}]+(?![^\p{White_Space}])|[\p{White_Space}]+").replace(r"[^\s\p{L}", r"[^\p{White_Space}\p{L}"))
        self.pieces = [b""] * (max(self.rank.values()) + 1)
        for piece, i in self.rank.items():
            self.pieces[i] = piece
        self.piece_size = np.array([len(p) for p in self.pieces], np.int64)
        self.piece_start = np.cumsum(self.piece_size) - self.piece_size
        self.piece_flat = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.byte = np.array([self.rank.get(bytes([b]), NONE) for b in range(256)], np.int32)
        self.merges = Merges([(self.rank[p[:k]], self.rank[p[k:]], i) for p, i in self.rank.items() for k in range(1, len(p)) if p[:k] in self.rank and p[k:] in self.rank])
        self.table = WordTable(self.encode_words)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct words: a word that is a piece has its rank, the others are folded."""
        raw = [w.encode() for w in words]
        whole = np.array([self.rank.get(w, -1) for w in raw], np.int64)
        parts = np.flatnonzero(whole < 0)
        ids, size = self.merges.fold_words([raw[i] for i in parts.tolist()], lambda x: self.byte[x])
        total = np.ones(len(raw), np.int64)
        total[parts] = size
        start = np.cumsum(total) - total
        flat = np.zeros(int(total.sum()), np.uint32)
        flat[start[whole >= 0]] = whole[whole >= 0]
        flat[ragged_take(start[parts], size)] = ids
        return flat, total

    def encode(self, raw: np.ndarray, offsets: np.ndarray):
        """For each row of a range of texts, the array of its ids."""
        cp, bounds = code_points(raw, offsets)
        odd = odd_rows(cp, bounds, normalized=False)
        starts, ends = split(cp, bounds, spaced=True)
        ids, size = self.table.ids(cp, starts, ends)
        word = np.concatenate([[0], np.cumsum(size)])
        cut = word[np.searchsorted(starts, bounds)]
        for i in range(len(offsets) - 1):
            if odd[i]:
                yield self.encode_words(self.pattern.findall(raw[offsets[i] : offsets[i + 1]].tobytes().decode()))[0]
            else:
                yield ids[cut[i] : cut[i + 1]]

    def decode(self, ids: np.ndarray) -> bytes:
        return self.piece_flat[ragged_take(self.piece_start[ids], self.piece_size[ids])].tobytes()


@lru_cache(4)
def vocabulary(path: str, pattern: str) -> Vocabulary:
    return Vocabulary(path, pattern)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """df with the array `out` of the ids of the whole of column `text`. The vocabulary file must be on every executor."""
    names = [c for c in df.columns if c not in (out, text)]

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(len(names)))
            for i, j in chunks(offsets, 1 << 20):
                rows = [x.astype(np.int32) for x in vocab.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])]
                cuts = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, j - i) for k in range(len(names))), batch.column(len(names)).slice(i, j - i), ids], names=[*names, text, out])

    schema = df.select(*names, text).withColumn(out, F.array(F.lit(0))).schema
    return df.select(*names, text).mapInArrow(run, schema)


def digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256): texts are encoded, the ids decoded again, and both digested."""

    def run(batches):
        vocab = vocabulary(path, pattern)
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            out = []
            for i, j in chunks(offsets, 1 << 20):
                for ids in vocab.encode(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    out.append((len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(vocab.decode(ids)).hexdigest()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string()), pa.array([x[2] for x in out], pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    schema = df.select(key).withColumns({"n_tokens": F.lit(0).cast("long"), "ids_sha256": F.lit(""), "decoded_sha256": F.lit("")}).schema
    return df.select(key, text).mapInArrow(run, schema)


def fold_sql(word: Column, ranks: dict[bytes, int]) -> Column:
    """The ids of one word as a Spark expression: higher-order functions fold merges over an array of hexadecimal pieces.

    The rank map is a literal of buckets by crc32, so that a lookup scans a few entries and not the whole map. `word`
    is a string column; null gives null, the empty word an empty array. For vocabularies of some thousand entries: the
    plan holds the literal, and the fold is interpreted, not compiled.
    """
    n = max(1, len(ranks) // 4)
    buckets: list[dict[str, int]] = [{} for _ in range(n)]
    from zlib import crc32

    for piece, i in ranks.items():
        name = piece.hex().upper()
        buckets[crc32(name.encode()) % n][name] = i
    cell = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv)) if d else F.expr("cast(map() as map<string,int>)")
    literal = F.array(*(cell(d) for d in buckets))
    rank = lambda piece: F.try_element_at(F.element_at(literal, (F.crc32(piece.cast("binary")) % n + 1).cast("int")), piece)
    pieces = F.transform(F.filter(F.split(F.regexp_replace(F.hex(F.encode(word, "UTF-8")), "(..)", "$1 "), " "), lambda x: x != ""), lambda x: x)
    steps = F.sequence(F.lit(1), F.greatest(F.size(pieces), F.lit(1)))

    def merge(acc: Column, _: Column) -> Column:
        pairs = F.transform(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), lambda x, i: F.struct(F.coalesce(rank(F.concat(x, F.get(acc, i + 1))), F.lit(NONE)).alias("r"), i.alias("i")))
        low = F.array_min(pairs)
        joined = F.concat(F.slice(acc, 1, low["i"]), F.array(F.concat(F.get(acc, low["i"]), F.get(acc, low["i"] + 1))), F.slice(acc, low["i"] + 3, F.size(acc)))
        return F.when(low.isNull() | (low["r"] == NONE), acc).otherwise(joined)

    return F.transform(F.aggregate(steps, pieces, merge), lambda x: rank(x))


def pattern_words(text: str, pattern: str) -> list[str]:
    """Words of a text by the plain pattern; the tests hold the vectorised splitting against it."""
    return [m.group(0) for m in regex.finditer(pattern, text)] if text and not re.fullmatch("", text) else []
