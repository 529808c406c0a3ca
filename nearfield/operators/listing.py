"""Lists of rows as people look at them: by text, by value, by likeness, by page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..types import Metric
from .search import knn

#: Hits that lead a list in order of likeness; characters of shown metadata.
LEADING, SHOWN = 500, 40


def meta_text(meta: Column, most: int = SHOWN) -> Column:
    """Metadata as JSON, cut to ``most`` characters with an ellipsis."""
    text = F.to_json(meta)
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def containing(rows: DataFrame, part: str) -> DataFrame:
    """Rows (id, meta) whose id, or whose metadata as it is shown, holds a text;
    capitals don't count."""
    low = part.lower()
    return rows.where(F.col("id").cast("string").contains(low) | F.lower(meta_text(F.col("meta"))).contains(low)) if low else rows


def with_value(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Rows whose metadata has a value, as text, under a key; a missing one is
    the text ``undefined``."""
    found = F.coalesce(F.try_variant_get("meta", f"$['{key}']" if "'" not in key else f'$["{key}"]', "string"), F.lit("undefined"))
    return rows.where(found == F.lit(value))


def by_likeness(rows: DataFrame, query, dim: int, metric: Metric, leading: int = LEADING) -> DataFrame:
    """All rows with rank: up to ``leading`` hits first, the others behind in
    their order (rank null)."""
    hits = knn(rows, query, dim, metric, leading).select("id", "score")
    ranked = hits.withColumn("rank", F.row_number().over(Window.orderBy(F.col("score").desc(), "id")).cast("long"))  # at most ``leading`` rows
    return rows.join(F.broadcast(ranked.select("id", "rank")), "id", "left").orderBy(F.col("rank").asc_nulls_last(), "pos")


def page(rows: DataFrame, number: int, size: int = 30) -> DataFrame:
    """A page (from 0) of the rows in their order."""
    return rows.orderBy("pos").offset(max(0, number) * size).limit(size)


def vector_preview(vector: Column, components: int = 3) -> Column:
    first = F.transform(F.slice(vector, 1, components), lambda x: F.format_string("%.3f", x.cast("double")))
    return F.array_join(first, ", ")
