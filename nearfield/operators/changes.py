"""Inserts, upserts, removals and updates as joins. Each returns the new rows
and, where the caller wants a report, a DataFrame of it.

Rows are (id, pos, vector, meta); ``pos`` is the order of insertion. Incoming
rows have (id, vector, meta) and an ``ord`` column with their order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import stored
from ..plans.placement import numbered
from ..types import Metric, u32_col


def validated(new: DataFrame, dim: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the right length, and (id, error) of the others."""
    new = new.withColumn("id", u32_col(F.col("id")))
    fine = F.coalesce(F.size("vector") == dim, F.lit(False))
    got = F.coalesce(F.size("vector"), F.lit(0))
    wrong = new.where(~fine).select("id", F.format_string(f"dim mismatch: got %d, want {dim}", got).alias("error"))
    return new.where(fine), wrong


def _ordered(new: DataFrame, keep: str) -> DataFrame:
    """One row for each id: its first or its last."""
    order = F.col("ord") if keep == "first" else F.col("ord").desc()
    return new.withColumn("__r", F.row_number().over(Window.partitionBy("id").orderBy(order))).where("__r = 1").drop("__r")


def _appended(rows: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with positions behind those of ``rows``."""
    last = rows.agg(F.coalesce(F.max("pos"), F.lit(-1)).alias("__last"))
    return numbered(new, "ord").crossJoin(F.broadcast(last)).withColumn("pos", F.col("__last") + 1 + F.col("__n"))  # one row


def insert_only(rows: DataFrame, new: DataFrame, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """New ids come in, the first row of each; the report says created or
    skipped for every incoming row."""
    known = new.join(rows.select("id", F.lit(True).alias("__known")), "id", "left")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("ord"))
    known = known.withColumn("outcome", F.when(F.col("__known").isNull() & (rank == 1), "created").otherwise("skipped"))
    fresh = _appended(rows, known.where("outcome = 'created'"))
    out = rows.unionByName(fresh.select("id", "pos", stored(F.col("vector"), metric).alias("vector"), "meta"))
    return out, known.select("id", "ord", "outcome")


def insert_strict(rows: DataFrame, new: DataFrame, metric: Metric) -> DataFrame:
    """Like ``insert_only``, but a duplicate id is an error."""
    out, report = insert_only(rows, new, metric)
    bad = report.where("outcome = 'skipped'").agg(F.min("id")).first()[0]
    if bad is not None:
        raise ValueError(f"id {bad} already exists")
    return out


def upsert(rows: DataFrame, new: DataFrame, metric: Metric) -> tuple[DataFrame, DataFrame]:
    """The last row of an id counts. A known id keeps its position and gets
    vector and meta; the report says created or updated for each id."""
    last = _ordered(new, "last").withColumn("vector", stored(F.col("vector"), metric))
    known = last.join(rows.select("id", F.col("pos").alias("__pos")), "id", "left")
    report = known.select("id", F.when(F.col("__pos").isNull(), "created").otherwise("updated").alias("outcome"))
    changed = known.where("__pos is not null").select("id", F.col("__pos").alias("pos"), "vector", "meta")
    fresh = _appended(rows, known.where("__pos is null")).select("id", "pos", "vector", "meta")
    return rows.join(last.select("id"), "id", "left_anti").unionByName(changed).unionByName(fresh), report


def remove_many(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``ids``: (id). The report says removed or missing for each id."""
    ids = ids.select(u32_col(F.col("id")).alias("id")).distinct()
    report = ids.join(rows.select("id", F.lit(True).alias("__known")), "id", "left").select("id", F.when(F.col("__known"), "removed").otherwise("missing").alias("outcome"))
    return rows.join(ids, "id", "left_anti"), report


def set_meta(rows: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``new``: (id, meta, ord). Metadata is replaced, not merged; ids that
    aren't there are reported as missing."""
    last = _ordered(new.withColumn("id", u32_col(F.col("id"))), "last").select("id", F.struct("meta").alias("__new"))
    out = rows.join(last, "id", "left").withColumn("meta", F.when(F.col("__new").isNotNull(), F.col("__new.meta")).otherwise(F.col("meta"))).select("id", "pos", "vector", "meta")
    report = last.join(rows.select("id", F.lit(True).alias("__known")), "id", "left")
    return out, report.select("id", F.when(F.col("__known"), "updated").otherwise("missing").alias("outcome"))


def set_vector(rows: DataFrame, new: DataFrame, metric: Metric) -> DataFrame:
    """``new``: (id, vector, ord). Vectors are replaced, metadata stays."""
    last = _ordered(new.withColumn("id", u32_col(F.col("id"))), "last").select("id", stored(F.col("vector"), metric).alias("__new"))
    return rows.join(last, "id", "left").withColumn("vector", F.coalesce("__new", "vector")).select("id", "pos", "vector", "meta")
