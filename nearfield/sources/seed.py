"""Rows to try things with: one-hot vectors with grouped metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def seed_rows(spark: SparkSession, count: int = 500, dim: int = 64, first_id: int = 1) -> DataFrame:
    """(id, pos, vector, key, idx, group, bucket)."""
    df = spark.range(count).withColumnRenamed("id", "idx")
    axis = F.pmod("idx", F.lit(dim))
    one = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda d: (d == axis).cast("float"))
    id_ = F.col("idx") + first_id
    return df.select(
        id_.alias("id"),
        F.col("idx").alias("pos"),
        one.alias("vector"),
        F.concat(F.lit("item-"), id_.cast("string")).alias("key"),
        "idx",
        F.concat(F.lit("g"), axis.cast("string")).alias("group"),
        F.concat(F.lit("b"), base36(F.pmod("idx", F.lit(min(max(1, count), 64))))).alias("bucket"),
    )
