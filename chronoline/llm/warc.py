"""WARC archives with a two-level capture index.

Pages become gzip-member WARC records in archives of about ARCHIVE bytes, written to the shared folder as values of a
table, since Python workers may not reach the store that Spark writes to. Equal payloads of at least LEAST bytes are written once, the others revisit it; smaller ones are all
written. The index holds the captures in the order of their reversed-host URL keys: ranges of keys (Spark's range
partitioning, which spreads a host of any size over several ranges) are sorted into compressed blocks of LINES lines
each. The sparse directory has the first key of every block; above it stand the first and last key of each range, PARTS
of them at most (ranges grow beyond that). A lookup searches the directory, opens the blocks that may hold its key,
searches them, and cuts the byte ranges it finds out of the archives; a host or a prefix of keys is one run of blocks
(`captures_of`).

A null html is an empty payload; a null url is the empty key; repeated rows get a record each and read back alike; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import re
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import bounded_batches, drop_settled, settle, spread_join

ARCHIVE, LINES, RANGE, PARTS, LEAST = 4 << 20, 256, 50_000, 4_096, 1_000
DATE = "2024-01-01T00:00:00Z"


def surt(url: str | None) -> str:
    """A sort key: the host's labels reversed, then port, path and query; scheme, user, leading www and fragment dropped, spaces and control characters escaped."""
    m = re.match(r"(?:[a-zA-Z][\w+.-]*://)?(?:[^/@?#]*@)?([^/:?#]*)(:\d+)?([^#]*)", url or "")
    host = re.sub(r"^www\d*\.", "", m.group(1).lower())
    key = ",".join(reversed(host.split("."))) + (m.group(2) or "") + ")" + (m.group(3).lower() or "/")
    return re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c.group(0)):02x}", key)


def record(page_id, url, payload: bytes, refers_to) -> bytes:
    """One record as a gzip member; a revisit holds the headers of the response only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:x-page:{page_id}>", f"WARC-Date: {DATE}", "WARC-Target-URI: " + re.sub(r"[\r\n]", "", url or ""), f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode() + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """The headers of a record and the payload of its HTTP response."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


ENTRIES = pa.list_(pa.struct([("key", pa.string()), ("page_id", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())]))


def _write(batches):
    """Archives of about ARCHIVE compressed bytes with the entries of their records."""
    part, n = TaskContext.get().partitionId(), 0
    data, entries = bytearray(), []

    def flush():
        nonlocal data, entries, n
        out = pa.RecordBatch.from_arrays([pa.array([f"{part:06d}-{n:06d}"]), pa.array([bytes(data)], pa.binary()), pa.array([entries], ENTRIES)], names=["archive", "warc", "entries"])
        data, entries, n = bytearray(), [], n + 1
        return out

    for batch in batches:
        for page_id, url, page, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
            member = record(page_id, url, (page or "").encode(), refers_to)
            entries.append({"key": surt(url), "page_id": page_id, "offset": len(data), "length": len(member)})
            data += member
            if len(data) >= ARCHIVE:
                yield flush()
    if entries:
        yield flush()


def write_archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(archive, warc, entries), written to the shared folder. Only pages of `least` bytes and more are compared by digest."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    pages = pages.withColumn("digest", F.when(F.octet_length("html") >= least, F.sha1(F.encode("html", "UTF-8"))))
    equal = settle(pages.where("digest is not null").groupBy("digest").agg(F.max("page_id").alias("top"), F.count("*").alias("many")).where("many > 1"))
    large = spread_join(pages.where("digest is not null"), equal, ["digest"], "many", ["page_id", "url"], "left")
    roles = large.select("page_id", "url", "html", F.when(F.col("top") != F.col("page_id"), F.col("top")).alias("refers_to"))
    small = pages.where("digest is null").select("page_id", "url", "html", F.lit(None).cast("long").alias("refers_to"))
    bounded_batches(pages.sparkSession)
    return settle(roles.union(small).mapInArrow(_write, "archive string, warc binary, entries array<struct<key:string,page_id:long,offset:long,length:long>>"))


LINE = "\t"
INDEX = "part int, first array<string>, blocks array<binary>, last string"


def _blocks(batches):
    """The sorted captures of one range as one row: compressed blocks of LINES lines, their first keys, and the last key."""
    lines, first, blocks, last = [], [], [], None

    def close(some: list[str]):
        first.append(some[0].split(LINE, 1)[0])
        blocks.append(zlib.compress("\n".join(some).encode(), 6))

    for batch in batches:
        lines += [LINE.join(map(str, x)) for x in zip(*(c.to_pylist() for c in batch.columns))]
        if lines:
            last = lines[-1].split(LINE, 1)[0]
        while len(lines) >= LINES:
            close(lines[:LINES])
            lines = lines[LINES:]
    if lines:
        close(lines)
    if first:
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([first]), pa.array([blocks], pa.list_(pa.binary())), pa.array([last])], names=["part", "first", "blocks", "last"])


def build_index(archives: DataFrame) -> DataFrame:
    """(part, first, blocks, last): captures in the order of their keys, in PARTS ranges at most, settled."""
    entries = archives.select("archive", F.explode("entries").alias("e")).select("e.key", F.coalesce(F.col("e.page_id").cast("string"), F.lit("")).alias("id"), "archive", "e.offset", "e.length")
    total = archives.agg(F.sum(F.size("entries"))).first()[0] or 0
    parts = min(PARTS, max(1, -(-total // RANGE)))
    dealt = entries.repartitionByRange(parts, "key", "id", "archive", "offset").sortWithinPartitions("key", "id", "archive", "offset")
    return settle(dealt.mapInArrow(_blocks, INDEX))


def lines_of(block: bytes) -> list[str]:
    return zlib.decompress(block).decode().split("\n")


def search(first: list[str], blocks: list[bytes], key: str, opened: dict[int, list[str]] | None = None) -> list[tuple[str, str, int, int]]:
    """The captures (id, archive, offset, length) of a key: binary search in the directory, then within the block and those that go on with it."""
    opened = {} if opened is None else opened
    at = max(0, bisect.bisect_left(first, key) - 1)
    out = []
    while at < len(blocks) and first[at] <= key:
        if at not in opened:
            opened.clear()  # keys come in order: one block is open at a time
            opened[at] = lines_of(blocks[at])
        lines = opened[at]
        i = bisect.bisect_left(lines, key + LINE)
        while i < len(lines) and lines[i].startswith(key + LINE):
            _, page, archive, offset, length = lines[i].split(LINE)
            out.append((page, archive, int(offset), int(length)))
            i += 1
        at += 1
    return out


CAPTURE = "key string, id string, archive string, offset long, length long"


def _captures(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) if rows else [()] * 5
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("key", "id", "archive", "offset", "length"), cols, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()))})


def _find(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = []
    if right.num_rows:
        first, blocks = right.column("first")[0].as_py(), right.column("blocks")[0].as_py()
        opened: dict[int, list[str]] = {}
        for key in sorted(set(left.column("key").to_pylist())):
            rows += [(key, *hit) for hit in search(first, blocks, key, opened)]
    return _captures(rows)


def directory(index: DataFrame) -> list[tuple[str, str, int]]:
    """The first and last key and the number of each range, in order: PARTS entries at most."""
    return sorted((r["f"], r["last"], r["part"]) for r in index.select(F.get("first", F.lit(0)).alias("f"), "last", "part").collect())


def locate(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(key, id, archive, offset, length): all captures of the keys (key). A key may go on over several ranges."""
    top = directory(index)
    ends = [x[1] for x in top]

    def find(batches):
        for batch in batches:
            key_of, part_of = [], []
            for key in batch.column(0).to_pylist():
                at = bisect.bisect_left(ends, key)
                while at < len(top) and top[at][0] <= key:
                    key_of.append(key)
                    part_of.append(top[at][2])
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array(key_of, pa.string()), pa.array(part_of, pa.int32())], names=["key", "part"])

    asked = keys.select("key").distinct().mapInArrow(find, "key string, part int")
    return asked.groupBy("part").cogroup(index.groupBy("part")).applyInArrow(_find, CAPTURE)


def captures_of(index: DataFrame, prefix: str) -> DataFrame:
    """(key, id, archive, offset, length) of all captures whose key starts with a prefix, such as a reversed host: `com,example`.

    Only the ranges and blocks that may hold such keys are read and opened."""

    def run(batches):
        for batch in batches:
            rows = []
            for first, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                at = max(0, bisect.bisect_left(first, prefix) - 1)
                while at < len(blocks) and first[at][: len(prefix)] <= prefix:
                    for line in lines_of(blocks[at]):
                        if line.startswith(prefix):
                            key, page, archive, offset, length = line.split(LINE)
                            rows.append((key, page, archive, int(offset), int(length)))
                    at += 1
            yield from _captures(rows).to_batches()

    touched = [part for first, last, part in directory(index) if first[: len(prefix)] <= prefix <= last]
    return index.where(F.col("part").isin(touched)).select("first", "blocks").mapInArrow(run, CAPTURE)


def _fetch(left: pa.Table, right: pa.Table) -> pa.Table:
    rows = []
    if right.num_rows:
        data = right.column("warc")[0].as_buffer()
        for page, offset, length in zip(*(left.column(c).to_pylist() for c in ("id", "offset", "length"))):
            fields, payload = parse(data[offset : offset + length].to_pybytes())
            kind, to = fields["WARC-Type"], fields.get("WARC-Refers-To")
            digest = base64.b32decode(fields["WARC-Payload-Digest"].split(":")[1]).hex()
            own = kind == "response"
            if own and hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError(f"the payload of page {page} does not have its digest")
            rows.append((int(page) if page else None, fields["WARC-Target-URI"], len(payload) if own else None, digest, kind, None if own else int(to[len("<urn:x-page:") : -1])))
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.table({k: pa.array(c, t) for k, c, t in zip(("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"), cols, (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()))})


def read_records(located: DataFrame, archives: DataFrame) -> DataFrame:
    """Records cut out of their archives by offset and length, (page_id, url, payload_bytes, payload_digest, record_type,
    refers_to); a revisit has its response's payload. An archive is one value of a table that only Spark need reach."""
    tasks = max(1, archives.count() // 4)  # a few archives a task, however many there are
    whole = archives.select("archive", "warc").repartition(tasks, "archive").groupBy("archive")
    rows = settle(located.repartition(tasks, "archive").groupBy("archive").cogroup(whole).applyInArrow(_fetch, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"))
    keys = ["refers_to", "payload_digest"]
    again = rows.where("record_type = 'revisit'")
    full = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("bytes"))
    targets = settle(again.groupBy(*keys).agg(F.count("*").alias("times")).join(full, keys, "left"))
    filled = spread_join(again.drop("payload_bytes"), targets, keys, "times", ["page_id", "url"], "left").withColumnRenamed("bytes", "payload_bytes")
    return rows.where("record_type = 'response'").unionByName(filled).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")


def _keys(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([surt(x) for x in batch.column(0).to_pylist()], pa.string())], names=["key"])


def round_trip(pages: DataFrame) -> DataFrame:
    """All pages written, indexed, looked up by key and read back."""
    archives = write_archives(pages)
    index = build_index(archives)
    urls = pages.select(F.col("url").cast("string").alias("url")).distinct()
    out = read_records(locate(urls.mapInArrow(_keys, "key string"), index), archives)
    drop_settled(index)
    drop_settled(archives)
    return out
