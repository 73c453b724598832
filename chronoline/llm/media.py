"""Media columns: signature sniffing, validation, type correction and carving.

An Aho-Corasick automaton finds magic bytes at any place of a value; a validator for each format walks its structure
and confirms the length; the format that starts at byte 0 corrects the declared type, validated media further in are
carved. `store` writes payloads losslessly as 8-bit samples of WAV, BMP or PNG files.

A null value is empty: no type, no features; bytes of no known format keep their declared type; repeated rows are
treated alike; an empty table gives an empty result; values are searched whole.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoline.llm.shared import text_bytes

WIDTH = 576
#: Magic bytes by type (fixed values).
MAGIC = {"image/png": [b"\x89PNG\r\n\x1a\n"], "audio/wav": [b"RIFF"], "image/bmp": [b"BM"], "image/gif": [b"GIF87a", b"GIF89a"], "image/jpeg": [b"\xff\xd8\xff"], "application/gzip": [b"\x1f\x8b\x08"], "application/zip": [b"PK\x03\x04"], "application/pdf": [b"%PDF-"]}


def _png(b: memoryview) -> int:
    at, seen = 8, set()
    while at + 12 <= len(b):
        n, kind = struct.unpack_from(">I4s", b, at)
        if at + 12 + n > len(b) or zlib.crc32(b[at + 4 : at + 8 + n]) != struct.unpack_from(">I", b, at + 8 + n)[0] or (not seen and kind != b"IHDR"):
            return 0
        seen.add(kind)
        at += 12 + n
        if kind == b"IEND":
            return at if b"IDAT" in seen else 0
    return 0


def _wav(b: memoryview) -> int:
    if len(b) < 44 or b[8:12] != b"WAVE":
        return 0
    size = struct.unpack_from("<I", b, 4)[0] + 8
    at, seen = 12, set()
    while at + 8 <= min(size, len(b)):
        kind, n = struct.unpack_from("<4sI", b, at)
        seen.add(kind)
        at += 8 + n + n % 2
    return size if at == size <= len(b) and {b"fmt ", b"data"} <= seen else 0


def _bmp(b: memoryview) -> int:
    if len(b) < 54:
        return 0
    size, zero, offset, head, width, height, planes, bits, packing = struct.unpack_from("<IIIIiiHHI", b, 2)
    if zero or head not in (40, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or width <= 0 or not height or size > len(b):
        return 0
    return size if packing or offset + (width * bits + 31) // 32 * 4 * abs(height) <= size else 0


def _gif(b: memoryview) -> int:
    if len(b) < 14:
        return 0
    at = 13 + (3 << (b[10] & 7) + 1 if b[10] & 128 else 0)

    def blocks(at: int) -> int:
        while at < len(b) and b[at]:
            at += b[at] + 1
        return at + 1

    while at < len(b):
        if b[at] == 0x3B:
            return at + 1
        if b[at] == 0x21:
            at = blocks(at + 2)
        elif b[at] == 0x2C and at + 10 < len(b):
            at = blocks(at + 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0))
        else:
            return 0
    return 0


def _jpeg(b: memoryview) -> int:
    at, data = 2, bytes(b)
    while at + 4 <= len(b):
        if b[at] != 0xFF:
            return 0
        if b[at + 1] == 0xD9:
            return at + 2
        n = struct.unpack_from(">H", b, at + 2)[0]
        if n < 2:
            return 0
        if b[at + 1] == 0xDA:
            at += 2 + n
            while True:
                at = data.find(b"\xff", at)
                if at < 0 or at + 1 >= len(b):
                    return 0
                if b[at + 1] and not 0xD0 <= b[at + 1] <= 0xD7:
                    break
                at += 2
        else:
            at += 2 + n
    return at + 2 if at + 2 <= len(b) and bytes(b[at : at + 2]) == b"\xff\xd9" else 0


def _gzip(b: memoryview) -> int:
    d = zlib.decompressobj(31)
    try:
        for i in range(0, len(b), 65536):
            d.decompress(b[i : i + 65536])
            if d.eof:
                return i + 65536 - len(d.unused_data) if i + 65536 <= len(b) else len(b) - len(d.unused_data)
    except zlib.error:
        pass
    return 0


def _zip(b: memoryview) -> int:
    data = bytes(b)
    at = data.find(b"PK\x05\x06")
    while at >= 0 and at + 22 <= len(data):
        size, offset, note = struct.unpack_from("<IIH", data, at + 12)
        if offset + size == at and at + 22 + note <= len(data):
            return at + 22 + note
        at = data.find(b"PK\x05\x06", at + 1)
    return 0


def _pdf(b: memoryview) -> int:
    data = bytes(b)
    at = data.find(b"%%EOF")
    return at + 5 if at > 0 and b"startxref" in data[:at] else 0


VALID = {"image/png": _png, "audio/wav": _wav, "image/bmp": _bmp, "image/gif": _gif, "image/jpeg": _jpeg, "application/gzip": _gzip, "application/zip": _zip, "application/pdf": _pdf}


@lru_cache(1)
def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for kind, marks in MAGIC.items():
        for mark in marks:
            out.add_word(mark.decode("latin-1"), (kind, len(mark)))
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[tuple[int, int, str]]:
    """(offset, length, type) of validated media, outermost first; what lies within one is not looked for again."""
    view, out, end = memoryview(data), [], 0
    for last, (kind, n) in automaton().iter(data.decode("latin-1")):
        at = last + 1 - n
        if at >= end and (length := VALID[kind](view[at:])):
            out.append((at, length, kind))
            end = at + length
    return out


def to_wav(payload: bytes) -> bytes:
    """One channel of unsigned 8-bit samples."""
    pad = b"\0" * (len(payload) % 2)
    return b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def to_bmp(payload: bytes) -> bytes:
    """Grey 8-bit samples in rows of WIDTH, top first."""
    palette = bytes(x for i in range(256) for x in (i, i, i, 0))
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 1078 + len(payload), 0, 1078, 40, WIDTH, -(len(payload) // WIDTH), 1, 8, 0, len(payload), 2835, 2835, 256, 0) + palette + payload


def to_png(payload: bytes) -> bytes:
    """Grey 8-bit samples in rows of WIDTH, unfiltered, in stored deflate blocks."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 0)) + chunk(b"IEND", b"")


def samples(data: bytes, kind: str) -> bytes:
    """The 8-bit samples of a file that `store` wrote."""
    if kind == "audio/wav":
        return data[44 : 44 + struct.unpack_from("<I", data, 40)[0]]
    if kind == "image/bmp":
        return data[struct.unpack_from("<I", data, 10)[0] :]
    at, parts = 8, []
    while at < len(data):
        n, name = struct.unpack_from(">I4s", data, at)
        if name == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, WIDTH + 1)[:, 1:].tobytes()


FORMS = (to_wav, to_bmp, to_png)


def store(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): texts as UTF-8, padded by 255 to a positive multiple of WIDTH, in a format chosen by their content."""

    def run(batches):
        for batch in batches:
            raw, offsets = text_bytes(batch.column(1))
            media, sizes = [], []
            for a, b in zip(offsets.tolist(), offsets[1:].tolist()):
                data = raw[a:b].tobytes()
                data += b"\xff" * (-len(data) % WIDTH if data else WIDTH)
                media.append(FORMS[zlib.crc32(data) % 3](data))
                sizes.append(b - a)
                if sum(map(len, media)) > 4 << 20:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(len(sizes) - len(media), len(media)), pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])
                    media = []
            if media:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(len(sizes) - len(media), len(media)), pa.array(sizes[-len(media) :], pa.int64()), pa.array(media, pa.binary())], names=[key, "n_bytes", "media"])

    schema = docs.select(key).withColumns({"n_bytes": F.lit(0).cast("long"), "media": F.lit(b"")}).schema
    return docs.select(key, text).mapInArrow(run, schema)


def carve(media: DataFrame, key: str, column: str = "media", declared: str | None = None) -> DataFrame:
    """(key, declared_type, media_type, found, media_bytes, media_sha256, payload_bytes, payload_sha256, tail_crc32, feature) for every value.

    found: array of (offset, length, type) of all validated media; media_type: that of byte 0, else the declared one.
    """

    def run(batches):
        for batch in batches:
            out = []
            for data, said in zip(batch.column(1), batch.column(2).to_pylist()):
                data = data.as_py() or b""
                found = sniff(data)
                kind = found[0][2] if found and found[0][0] == 0 else said
                own = samples(data, kind) if found and found[0][0] == 0 and kind in ("audio/wav", "image/bmp", "image/png") else data
                count = np.bincount(np.frombuffer(own, np.uint8), minlength=256) if own else np.zeros(256, int)
                feature = f"{kind};samples={len(own)};sum={int((count * np.arange(256)).sum())};distinct={int((count > 0).sum())};embedded={len(found) - (1 if found and found[0][0] == 0 else 0)}"
                out.append((said, kind, [{"offset": a, "length": n, "type": k} for a, n, k in found], len(data), hashlib.sha256(data).hexdigest(), len(own), hashlib.sha256(own).hexdigest(), zlib.crc32(own[-32:]) if own else 0, feature))
            cols = list(zip(*out)) if out else [()] * 9
            kinds = (pa.string(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())])), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[key, "declared_type", "media_type", "found", "media_bytes", "media_sha256", "payload_bytes", "payload_sha256", "tail_crc32", "feature"])

    rows = media.select(key, column, (F.col(declared) if declared else F.lit("application/octet-stream")).alias("declared"))
    schema = media.select(key).schema.simpleString()[len("struct<") : -1].replace(":", " ", 1)
    return rows.mapInArrow(run, f"{schema}, declared_type string, media_type string, found array<struct<offset:long,length:long,type:string>>, media_bytes long, media_sha256 string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string")
