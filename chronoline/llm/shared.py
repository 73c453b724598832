"""Checkpoints, connected components and Arrow helpers that the operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MIX = np.uint64(0x9E3779B97F4A7C15)


#: Bytes of an Arrow batch that goes to a Python worker, unless the session sets its own bound.
BATCH_BYTES = 2 << 20
#: Keys with more than 1 / HOT of all rows are dealt to SPREAD partitions each; there are HOT of them at most.
HOT, SPREAD = 1_000, 64
_written: list[list[str]] = []


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches bounded by bytes, not only by rows: rows of any length leave a worker's memory alone."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is None:
        spark.conf.set(name, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A temporary one only in local mode, where all is one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "chronoline-shared"))
    return sc._jsc.sc().getCheckpointDir().get()


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind it as make it differ from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def settle(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage is cut and lost executors cost nothing."""
    bounded_batches(df.sparkSession)
    path = f"{shared_dir(df.sparkSession)}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _written:
        _written[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def drop_settled(df: DataFrame) -> None:
    """Removes the files of a settled frame that no later plan reads."""
    for f in df.inputFiles()[:1]:
        _delete(df.sparkSession, f.rsplit("/", 1)[0])


def settled_alone(spark: SparkSession, build) -> DataFrame:
    """The frame that build() returns, settled; whatever else was settled for it is removed."""
    _written.append([])
    try:
        out = settle(build())
        keep = _written[-1].pop()
        for path in _written[-1]:
            _delete(spark, path)
    finally:
        _written.pop()
    if _written:
        _written[-1].append(keep)
    return out


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str, by, how: str = "inner", counts: DataFrame | None = None) -> DataFrame:
    """left joined to right, which has each key once. right, or else `counts`, has in `weight` the rows of left by key.

    A key with more than a thousandth of these rows is hot: its rows of left are dealt to SPREAD partitions by the hash
    of `by`, and its row of right goes to all of them. There are a thousand hot keys at most: their hashes are collected
    and become a literal of the plan. `weight` of right is dropped. The weights are read first: settle what holds them.
    """
    counts, right = (right, right.drop(weight)) if counts is None else (counts, right)
    total, most = (x or 0 for x in counts.agg(F.sum(weight), F.max(weight)).first())
    limit = max(100, total // HOT)
    hot = [r[0] for r in counts.where(F.col(weight) > limit).select(F.xxhash64(*keys)).collect()] if most > limit else []
    if not hot:
        return left.join(right, keys, how)
    is_hot = F.xxhash64(*keys).isin(hot)
    dealt = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*by), F.lit(SPREAD)).cast("int")).otherwise(0))
    wide = right.withColumn("_salt", F.explode(F.when(is_hot, F.array(*(F.lit(i) for i in range(SPREAD)))).otherwise(F.array(F.lit(0)))))
    return dealt.join(wide, [*keys, "_salt"], how).drop("_salt")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64 values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release(spark: SparkSession) -> None:
    """Lets the JVM find shuffles that nothing refers to, so that their files go before the next stage writes its own."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


class Powers:
    """Powers of an odd base and of its inverse, modulo 2^64, grown on demand: substring hashes from prefix sums."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                setattr(self, name, np.cumprod(p, dtype=np.uint64))
        return self.up[:n], self.down[:n]

    def prefix(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * self.upto(len(values) + 1)[0][:-1], out=out[1:])
        return out

    def span(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Scrambled hashes of the spans [start, end); equal spans have equal hashes wherever they lie."""
        h = (prefix[end] - prefix[start]) * self.upto(len(prefix))[1][start]
        return mix64(h + (end - start).astype(np.uint64) * MIX)


class Weights:
    """Hashes of words by a random weight for each place in a word, in two independent copies.

    Unlike sums of powers modulo 2^64, they have no pairs of texts that collide by their structure."""

    def __init__(self, salt: int):
        self.salt, self.held = np.array([salt, salt ^ 0x5851F42D4C957F2D], np.uint64), np.zeros((2, 0), np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if self.held.shape[1] < n:
            at = np.arange(1, max(n, 4096, 2 * self.held.shape[1]) + 1, dtype=np.uint64) * MIX
            self.held = np.stack([mix64(at ^ mix64(s)) | np.uint64(1) for s in self.salt[:, None]])
        return self.held

    def spans(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, copies: int = 2) -> np.ndarray:
        """Rows of hashes of the spans [start, end) of small integers, which rise and do not overlap; none is empty."""
        if not len(starts):
            return np.zeros((copies, 0), np.uint64)
        place = np.zeros(len(values), np.int32)
        place[starts] = starts
        place = np.arange(len(values), dtype=np.int32) - np.maximum.accumulate(place)
        size = ends - starts
        weights = self.upto(int(size.max()) + 1)
        np.minimum(place, int(size.max()), out=place)  # between spans the place means nothing
        edges = np.empty(2 * len(starts), np.int64)
        edges[::2], edges[1::2] = starts, ends
        edges = edges[: -1 if edges[-1] >= len(values) else None]
        plain = values.astype(np.uint64) + np.uint64(1)
        return np.stack([mix64(np.add.reduceat(plain * weights[k][place], edges)[::2] + size.astype(np.uint64) * MIX) for k in range(copies)])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column, not copied, and the offsets of its rows; null rows are empty."""
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def trim() -> None:
    """Freed memory goes back to the system: workers are reused and wait between tasks."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def frugal(run):
    """run over batches, and then trim()."""

    def both(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return both


def chunks(offsets: np.ndarray, most: int):
    """Ranges of rows of about `most` bytes; a longer row stands alone, whole."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j
        i = j


def ragged_take(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


def find_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the edges (a, b), by vectorised hooking and jumping."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        if np.array_equal(before, root):
            return root


def _forest(batches):
    """Edges of a partition in batches reduced to (node, smallest node reached); nothing is lost for connectivity."""
    held = None
    for batch in batches:
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            a, b = np.concatenate([held[0], a]), np.concatenate([held[1], b])
        if not len(a):
            continue
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = find_roots(at[: len(a)], at[len(a) :], len(nodes))
        keep = root != np.arange(len(nodes))
        held = nodes[keep], nodes[root[keep]]
        if len(held[0]) > 2_000_000:  # bounded memory: what is held goes out and counting starts anew
            yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["a", "b"])
            held = None
    if held is not None:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=["a", "b"])


def _labels(batches):
    """Every node of all edges of a task with the smallest node reached; for a number of edges that was checked before."""
    held = [(batch.column(0).to_numpy(), batch.column(1).to_numpy()) for batch in batches if batch.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = find_roots(at[: len(a)], at[len(a) :], len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


#: Edges that one task labels by itself: about 300 MB at its peak. More edges take the rounds.
ONE_TASK = 2_000_000


def connected_components(edges: DataFrame, one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node of the edges (a, b); component is the smallest node reachable.

    Partitions first reduce their edges to forests. If those are counted and hold at most `one_task` edges, one task on
    an executor labels them; rounds of shuffles would cost more than the work. Beyond that, rounds of large-star and
    small-star over the edge list, which never grows: each star is an aggregation with map-side combining and a join,
    so a hub of any degree is no single task's load. Every round is settled. Both ways give the same rows.
    """
    at = settle(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null and a <> b").mapInArrow(_forest, "a long, b long"))
    if at.count() <= one_task:
        labelled = settle(at.coalesce(1).mapInArrow(_labels, "node long, component long"))
        drop_settled(at)
        return labelled
    seen = None
    while True:
        both = at.union(at.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        after = settle(small)
        drop_settled(at)
        at = after
        mark = tuple(at.agg(F.count("*"), F.sum("b"), F.bit_xor(F.xxhash64("a", "b")), F.count_distinct("a")).first())
        if mark == seen:
            return at.select(F.col("a").alias("node"), F.col("b").alias("component")).union(at.select("b", "b").distinct())
        seen = mark
