"""Binary data segments and index files, for exchange with files written
elsewhere. Inside, rows are Parquet."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Magic words and versions (little-endian formats).
DATA_MAGIC, INDEX_MAGIC, VERSION = b"VLDT", b"VLIX", 1
_HEAD, _ROW = struct.Struct("<4sI"), struct.Struct("<III")


class FormatError(ValueError):
    pass


def encode_row(id_: int, vector, meta) -> bytes:
    text = json.dumps(meta, ensure_ascii=False, separators=(",", ":")).encode()
    return _ROW.pack(id_ & 0xFFFFFFFF, len(text), 4 * len(vector)) + text + struct.pack(f"<{len(vector)}f", *vector)


def decode_row(data: bytes, at: int = 0) -> tuple[int, list[float], object, int]:
    """id, vector, metadata and where the next row begins."""
    id_, metas, vectors = _ROW.unpack_from(data, at)
    at += _ROW.size
    meta = json.loads(data[at : at + metas]) if metas else None
    at += metas
    return id_, list(struct.unpack_from(f"<{vectors // 4}f", data, at)), meta, at + vectors


def encode_segment(rows: list[tuple[int, list[float], object]]) -> tuple[bytes, list[tuple[int, int]]]:
    """The segment, and (offset, length) of each row."""
    out, places = [_HEAD.pack(DATA_MAGIC, VERSION)], []
    at = _HEAD.size
    for row in rows:
        data = encode_row(*row)
        places.append((at, len(data)))
        out.append(data)
        at += len(data)
    return b"".join(out), places


def rows_of_segment(data: bytes) -> Iterator[tuple[int, int, int, list[float], object]]:
    """offset, length, id, vector, metadata. A row that is cut off ends it."""
    if len(data) < _HEAD.size:
        raise FormatError("data segment is shorter than its header")
    magic, version = _HEAD.unpack_from(data)
    if magic != DATA_MAGIC:
        raise FormatError("no data segment")
    if version != VERSION:
        raise FormatError(f"unsupported version {version}")
    at = _HEAD.size
    while len(data) - at >= _ROW.size:
        _, metas, vectors = _ROW.unpack_from(data, at)
        if at + _ROW.size + metas + vectors > len(data):
            return
        id_, vector, meta, end = decode_row(data, at)
        yield at, end - at, id_, vector, meta
        at = end


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(segment, offset, length, id, vector, meta VARIANT) of a folder of segments."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p.rsplit("/", 1)[-1], o, n, i, v, json.dumps(m)) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for o, n, i, v, m in rows_of_segment(c)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float32()), pa.string())
            names = ["segment", "offset", "length", "id", "vector", "meta"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    out = files.mapInArrow(run, "segment string, offset long, length long, id long, vector array<float>, meta string")
    return out.withColumn("meta", F.parse_json("meta"))


_ENTRY = struct.Struct("<IIII")


def encode_index(entries: list[tuple[int, str, int, int]]) -> bytes:
    """An index file: (id, segment, offset, length) of rows; segment names are
    listed once."""
    names = sorted({e[1] for e in entries})
    place = {n: k for k, n in enumerate(names)}
    text = json.dumps(names, ensure_ascii=False, separators=(",", ":")).encode()
    out = [_HEAD.pack(INDEX_MAGIC, VERSION), struct.pack("<II", len(text), len(entries)), text]
    return b"".join(out + [_ENTRY.pack(i & 0xFFFFFFFF, place[n], at, size) for i, n, at, size in entries])


def decode_index(data: bytes) -> list[tuple[int, str, int, int]]:
    if len(data) < _HEAD.size + 8:
        raise FormatError("index file is shorter than its header")
    magic, version = _HEAD.unpack_from(data)
    if magic != INDEX_MAGIC:
        raise FormatError("no index file")
    if version != VERSION:
        raise FormatError(f"unsupported version {version}")
    text, n = struct.unpack_from("<II", data, _HEAD.size)
    at = _HEAD.size + 8
    if len(data) < at + text + n * _ENTRY.size:
        raise FormatError("index file is cut off")
    names = json.loads(data[at : at + text])
    found = [_ENTRY.unpack_from(data, at + text + k * _ENTRY.size) for k in range(n)]
    if any(e[1] >= len(names) for e in found):
        raise FormatError("an entry names no segment")
    return [(i, names[k], o, size) for i, k, o, size in found]
