"""Helpers every operator of this folder uses: the shared folder, written
tables, held-out folds and Arrow text buffers."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Where Spark splits words: the space and the five ASCII controls 9 to 13.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it.
    Only where it is unset and the session is local (tests, a laptop) one is
    made; a cluster has to name its own."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="nearfield-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def mounted_folder(spark: SparkSession) -> str:
    """A new path below the shared folder that Python on every machine can
    open. The shared folder has to be a mount then (file:, NFS, FUSE)."""
    folder = shared_folder(spark)
    parts = urlparse(folder)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"{folder} is no mounted file system; name a mounted folder as model_dir")
    return f"{unquote(parts.path)}/nearfield-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: lineage ends here, and
    a lost executor costs no more than the tasks that read its part."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nearfield-{uuid.uuid4().hex}.parquet"
    for held in _scratch[-1:]:
        held.paths.append(path)
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._nf_path = path
    return back


class Scratch:
    """Inside ``with Scratch(spark) as s`` tables that ``written`` makes are
    noted, and deleted at the end but for those that ``s.keep`` names: a result
    that is still to be computed reads them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.kept = spark, [], set()

    def keep(self, df: DataFrame) -> DataFrame:
        self.kept.add(df._nf_path)
        return df

    def __enter__(self) -> Scratch:
        _scratch.append(self)
        return self

    def __exit__(self, kind, *_) -> None:
        _scratch.remove(self)
        for path in self.paths:
            if kind is not None or path not in self.kept:
                delete(self.spark, path)
            else:
                for outer in _scratch[-1:]:
                    outer.paths.append(path)


_scratch: list[Scratch] = []


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def sample(rows: DataFrame, most: int, draw: Column, by: str | None = None) -> DataFrame:
    """At most ``most`` rows, or as many of each value of ``by``: those with
    the smallest hash ``draw``. Rows of one hash count once, so copies can't
    exceed the bound. About a third more than the bound is picked where the
    rows lie, and only that is sorted; ``by`` has few values."""
    marked = rows.withColumn("__draw", draw)
    parts = 1_000_003
    place = F.pmod("__draw", F.lit(parts))
    share = lambda n: min(parts, int(1.35 * most / max(1, n) * parts) + 1)
    if by is None:
        near = marked.where(place < share(rows.count()))
        order = Window.orderBy("__draw")
    else:
        counts = [(r[by], r["count"]) for r in rows.where(F.col(by).isNotNull()).groupBy(by).count().collect()]
        if not counts:
            return rows.limit(0)
        limits = F.create_map(*(F.lit(v) for k, n in counts for v in (k, share(n))))
        near = marked.where(place < limits[F.col(by)])
        order = Window.partitionBy(by).orderBy("__draw")
    once = near.dropDuplicates([*([by] if by else []), "__draw"])
    return once.withColumn("__place", F.row_number().over(order)).where(F.col("__place") <= most).select(*rows.columns)


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % parts, F.lit(-1)).cast("int")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each, without a copy where Arrow
    allows. A null text is an empty one."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    n = len(texts)
    if not n or data is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes, one document at least."""
    runs, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        runs.append((lo, min(hi, n)))
        lo = min(hi, n)
    return runs
