"""Posting lists over attributes, and candidates taken from them.

Candidates only ever narrow a scan: they are used where they surely hold every
row that the filter lets through, and the filter runs afterwards all the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..types import u32

#: Type tags keep 1, "1" and true apart.
_TAG = "CASE WHEN kind RLIKE '^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL)' THEN 'number' WHEN kind = 'BOOLEAN' THEN 'boolean' WHEN kind = 'STRING' THEN 'string' WHEN kind = 'VOID' THEN 'null' END"


def postings(attrs: DataFrame) -> DataFrame:
    """``attrs``: (id, attrs VARIANT object). One row for each scalar, array
    elements each: (key, vtype, sval, nval, id), vtype null for a null value."""
    flat = attrs.select("id", F.explode(F.expr("CAST(attrs AS MAP<STRING, VARIANT>)")).alias("key", "v"))
    kind = F.schema_of_variant("v")
    items = F.when(kind.startswith("ARRAY"), F.try_variant_get("v", "$", "array<variant>")).otherwise(F.array("v"))
    each = flat.select("id", "key", F.explode_outer(items).alias("v")).withColumn("kind", F.schema_of_variant("v")).withColumn("vtype", F.expr(_TAG))
    return each.where("vtype is not null").select(
        "key",
        "vtype",
        F.when(F.col("vtype") != "null", F.try_variant_get("v", "$", "string")).alias("sval"),
        F.when(F.col("vtype") == "number", F.try_variant_get("v", "$", "double")).alias("nval"),
        "id",
    )


class AttrIndex:
    """``basic`` answers ranges, ``bitmap`` doesn't; both give the same ids."""

    def __init__(self, table: DataFrame, strategy: str = "basic"):
        if strategy not in ("basic", "bitmap"):
            raise ValueError(f"unknown attribute index {strategy!r}")
        self.table, self.strategy = table, strategy

    @classmethod
    def build(cls, attrs: DataFrame, strategy: str = "basic") -> AttrIndex:
        return cls(postings(attrs), strategy)

    def set_attrs(self, attrs: DataFrame) -> AttrIndex:
        """Replaces all attributes of the ids in ``attrs``."""
        rest = self.table.join(attrs.select("id").distinct(), "id", "left_anti")
        return AttrIndex(rest.unionByName(postings(attrs)), self.strategy)

    def remove(self, ids: DataFrame) -> AttrIndex:
        return AttrIndex(self.table.join(ids.select("id").distinct(), "id", "left_anti"), self.strategy)

    def save(self, path: str) -> None:
        """By key, in order of value: ranges skip row groups."""
        self.table.repartitionByRange("key", "nval", "sval").sortWithinPartitions("key", "nval", "sval").write.mode("overwrite").partitionBy("key").parquet(path)

    def eq(self, key: str, value) -> DataFrame:
        """Ids (distinct) with the value, in an array or alone."""
        tag = "null" if value is None else "boolean" if isinstance(value, bool) else "number" if isinstance(value, int | float) else "string"
        found = self.table.where((F.col("key") == key) & (F.col("vtype") == tag))
        if tag == "number":
            found = found.where(F.col("nval") == F.lit(float(value)))
        elif tag != "null":
            found = found.where(F.col("sval") == F.lit(str(value).lower() if tag == "boolean" else value))
        return found.select("id").distinct()

    def exists(self, key: str) -> DataFrame:
        """Ids that have the key, null values among them."""
        return self.table.where(F.col("key") == key).select("id").distinct()

    def range(self, key: str, bounds: dict) -> DataFrame | None:
        if self.strategy == "bitmap":
            return None
        found = self.table.where((F.col("key") == key) & (F.col("vtype") == "number"))
        for name, op in (("gt", ">"), ("gte", ">="), ("lt", "<"), ("lte", "<=")):
            if bounds.get(name) is not None:
                found = found.where(f"nval {op} {float(bounds[name])!r}D")
        return found.select("id").distinct()

    def candidates(self, expr: dict) -> DataFrame | None:
        """Ids that hold all rows the filter can let through, or None where
        that isn't known. ``must`` intersects what is known; ``should`` needs
        every member; negations say nothing."""
        if "has_id" in expr:
            spark = self.table.sparkSession
            return spark.createDataFrame([(v,) for v in sorted({u32(v) for v in expr["has_id"]["values"]})], "id long")
        if any(k in expr for k in ("match", "exists", "is_null", "range")):
            return self._leaf(expr)
        known = [c for e in expr.get("must") or [] if (c := self.candidates(e)) is not None]
        should = expr.get("should") or []
        least = expr.get("should_min")
        if should and (1 if least is None else least) > 0:
            each = [self.candidates(e) for e in should]
            if all(c is not None for c in each):
                known.append(reduce(DataFrame.union, each).distinct())
        return reduce(lambda a, b: a.join(b, "id", "left_semi"), known) if known else None

    def _leaf(self, expr: dict) -> DataFrame | None:
        key = expr.get("key")
        # dotted paths lead into objects, which postings don't hold
        if (expr.get("scope") or "attrs") != "attrs" or not key or "." in key:
            return None
        if "match" in expr:
            wanted = expr["match"] if isinstance(expr["match"], list | tuple) else [expr["match"]]
            if not wanted:
                return self.table.where(F.lit(False)).select("id")
            return reduce(DataFrame.union, (self.eq(key, w) for w in wanted)).distinct()
        if "exists" in expr:
            return self.exists(key) if expr["exists"] else None
        if "is_null" in expr:
            return None
        return self.range(key, expr["range"])
