"""The change log: records (seq, type, id, vector, meta) and their fold.

Types are upsert, remove and setMeta. The fold of a log is, for each id, what
its records leave after its last removal: the vector of the last upsert since,
the metadata of the last upsert or setMeta since the first such upsert; a
setMeta without an upsert before it does nothing.

As a stream, every micro-batch is folded onto the current snapshot version
and written as the next; the snapshot's pointer moves last.
"""

from __future__ import annotations

import json
import struct
import time
import zlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The binary format (little-endian).
MAGIC, FOOTER, VERSION = b"VLWA", b"WCRC", 1
TYPES = {1: "upsert", 2: "remove", 3: "setMeta"}
CODES = {v: k for k, v in TYPES.items()}
_HEAD, _REC = struct.Struct("<4sI"), struct.Struct("<BBIII")


class LogError(ValueError):
    """A log that can't be read; ``kind``: short, magic, version, type,
    meta, truncated."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def fold(log: DataFrame) -> DataFrame:
    """(id, vector, meta) that the log leaves. Two windows by id over the log,
    then one aggregation on the same partitioning."""
    w = Window.partitionBy("id")
    df = log.withColumn("__gone", F.max(F.when(F.col("type") == "remove", F.col("seq"))).over(w))
    df = df.where(F.col("__gone").isNull() | (F.col("seq") > F.col("__gone")))
    df = df.withColumn("__born", F.min(F.when(F.col("type") == "upsert", F.col("seq"))).over(w)).where("seq >= __born")
    said = F.when(F.col("type").isin("upsert", "setMeta"), F.col("seq"))
    born = F.when(F.col("type") == "upsert", F.col("seq"))
    last = df.groupBy("id").agg(F.max_by("vector", born).alias("vector"), F.max_by(F.struct("meta"), said).alias("__m"))
    return last.select("id", "vector", F.col("__m.meta").alias("meta"))


def fold_onto(rows: DataFrame, log: DataFrame) -> DataFrame:
    """``rows`` (id, vector, meta) after the log: they count as upserts before it."""
    before = rows.select(F.lit(-1).cast("long").alias("seq"), F.lit("upsert").alias("type"), "id", "vector", "meta")
    return fold(before.unionByName(log.select("seq", "type", "id", "vector", "meta")))


def fold_with_attrs(log: DataFrame, projector: Callable[[Column], Column]) -> DataFrame:
    """The fold with attrs taken from the metadata by the caller's expression."""
    return fold(log).withColumn("attrs", projector(F.col("meta")))


def stream_fold(log: DataFrame, snapshot, checkpoint: str, available_now: bool = True, every: str | None = None):
    """Folds a streaming log into ``snapshot`` (read() -> rows or None,
    write(rows, version)). A batch that runs again writes its version again."""

    def batch(df: DataFrame, version: int) -> None:
        rows = snapshot.read()
        snapshot.write(fold(df) if rows is None else fold_onto(rows, df), version)

    writer = log.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now and not every else writer.trigger(processingTime=every or "10 seconds")).start()


class VersionedRows:
    """Rows as one Parquet folder for each version; the newest complete one counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root, root.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def versions(self) -> list[int]:
        jvm, root, fs = self._fs()
        if not fs.exists(root):
            return []
        names = [s.getPath() for s in fs.listStatus(root)]
        return sorted(int(p.getName()[1:]) for p in names if p.getName().startswith("v") and fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def read(self, version: int | None = None) -> DataFrame | None:
        have = self.versions()
        if not have:
            return None
        return self.spark.read.parquet(f"{self.path}/v{have[-1] if version is None else version}")

    def write(self, rows: DataFrame, version: int) -> None:
        # never over the version that the rows come from
        have = self.versions()
        if have and version <= have[-1]:
            return
        rows.write.mode("overwrite").parquet(f"{self.path}/v{version}")

    def drop_before(self, version: int) -> None:
        jvm, root, fs = self._fs()
        for v in self.versions():
            if v < version:
                fs.delete(jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{v}"), True)


# ---- binary logs


def encode(records: Iterable[dict]) -> bytes:
    out = [_HEAD.pack(MAGIC, VERSION)]
    for r in records:
        meta = b"" if r["type"] == "remove" else json.dumps(r.get("meta"), ensure_ascii=False, separators=(",", ":")).encode()
        vector = struct.pack(f"<{len(r['vector'])}f", *r["vector"]) if r["type"] == "upsert" else b""
        out.append(_REC.pack(CODES[r["type"]], 0, r["id"] & 0xFFFFFFFF, len(meta), len(vector)) + meta + vector)
    return b"".join(out)


def decode(data: bytes) -> Iterator[dict]:
    """Records of one log or of several behind each other; a checksum footer ends it."""
    if len(data) < _HEAD.size:
        raise LogError("short", "log is shorter than its header")
    if data[:4] != MAGIC:
        raise LogError("magic", "no log header")
    if footer(data) is not None:
        data = data[:-8]
    at = 0
    while at < len(data):
        if data[at : at + 4] == MAGIC and len(data) - at >= _HEAD.size:
            if (version := _HEAD.unpack_from(data, at)[1]) != VERSION:
                raise LogError("version", f"unsupported version {version}")
            at += _HEAD.size
            continue
        if len(data) - at < _REC.size:
            raise LogError("truncated", "record header is cut off")
        code, _, id_, metas, vectors = _REC.unpack_from(data, at)
        at += _REC.size
        if code not in TYPES:
            raise LogError("type", f"unknown record type {code}")
        if len(data) - at < metas + vectors:
            raise LogError("truncated", "record is cut off")
        try:
            meta = json.loads(data[at : at + metas]) if metas else None
        except ValueError as e:
            raise LogError("meta", "metadata is no JSON") from e
        vector = list(struct.unpack_from(f"<{vectors // 4}f", data, at + metas)) if code == 1 else None
        at += metas + vectors
        yield {"type": TYPES[code], "id": id_, "meta": meta, "vector": vector}


class LogFolder:
    """Binary logs in a folder, one numbered file for each append. A file is
    whole or isn't there; two writers can't take one number."""

    def __init__(self, files, path: str):
        self.files, self.path = files, path.rstrip("/")

    def names(self) -> list[str]:
        return [n for n in self.files.names(self.path) if n.endswith(".wal")]

    def append(self, records: Iterable[dict]) -> str:
        data, have = with_checksum(encode(records)), self.names()
        number = int(have[-1].split(".")[0]) + 1 if have else 0
        while not self.files.make_new(f"{self.path}/{number:012d}.claim", ""):
            number += 1
        name = f"{number:012d}.wal"
        self.files.write(f"{self.path}/{name}", data)
        return name

    def records(self) -> Iterator[dict]:
        for n in self.names():
            yield from decode(self.files.read_bytes(f"{self.path}/{n}"))

    def truncate(self, upto: str | None = None) -> int:
        """Drops the files up to one that a snapshot holds (all without it)."""
        gone = [n for n in self.names() if upto is None or n <= upto]
        for n in gone:
            self.files.delete(f"{self.path}/{n}")
            self.files.delete(f"{self.path}/{n.split('.')[0]}.claim")
        return len(gone)


class AutoSave:
    """Saves after ``every`` operations or ``after_ms`` since the last save,
    whichever comes first, and then truncates the log up to what was saved."""

    def __init__(self, save: Callable[[], object], log: LogFolder | None = None, every: int = 1000, after_ms: int | None = None, clock: Callable[[], int] = lambda: int(time.time() * 1000)):
        self.save, self.log, self.every, self.after_ms, self.clock = save, log, max(1, every), after_ms, clock
        self.operations, self.last = 0, clock()

    def wrote(self, operations: int = 1) -> bool:
        self.operations += operations
        late = self.after_ms is not None and self.clock() - self.last >= self.after_ms
        return bool(self.operations) and (self.operations >= self.every or late) and self.flush()

    def flush(self) -> bool:
        upto = (self.log.names() or [None])[-1] if self.log else None
        self.save()  # a save that fails leaves the log
        if upto:
            self.log.truncate(upto)
        self.operations, self.last = 0, self.clock()
        return True


def with_checksum(data: bytes) -> bytes:
    return data + FOOTER + struct.pack("<I", zlib.crc32(data))


def footer(data: bytes) -> int | None:
    return struct.unpack("<I", data[-4:])[0] if len(data) >= 16 and data[-8:-4] == FOOTER else None


def verify(data: bytes) -> dict:
    """ok, records, checksum (None where there is no footer)."""
    want = footer(data)
    right = None if want is None else zlib.crc32(data[:-8]) == want
    try:
        n = sum(1 for _ in decode(data))
    except LogError as e:
        return {"ok": False, "records": 0, "checksum": right, "error": e.kind}
    return {"ok": right is not False, "records": n, "checksum": right, "error": None if right is not False else "checksum"}


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """A folder of binary logs, in order of name, as log records. Files are
    decoded where they lie; errors surface."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [(p, n, r["type"], r["id"], r["vector"], json.dumps(r["meta"])) for p, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, r in enumerate(decode(c))]
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.float32()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["file", "n", "type", "id", "vector", "meta"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    rows = files.mapInArrow(run, "file string, n long, type string, id long, vector array<float>, meta string")
    starts = rows.groupBy("file").agg(F.count("*").alias("c")).withColumn("s", F.coalesce(F.sum("c").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return rows.join(starts, "file").select((F.col("s") + F.col("n")).alias("seq"), "type", "id", "vector", F.parse_json("meta").alias("meta"))
