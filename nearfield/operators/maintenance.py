"""Statistics, diagnosis, alert rules, consistency and compaction."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Limits of suggestions and alerts.
LARGE_ROWS, LOW_DEGREE, HIGH_TOMBSTONES, IMBALANCE, SMALL_ROWS, LOW_RECALL = 10_000, 4, 0.3, 2.0, 1_000, 0.6


def list_sizes(assigned: DataFrame, nlist: int) -> DataFrame:
    """(list_id, size) of every list, empty ones too."""
    spark = assigned.sparkSession
    counts = assigned.groupBy("list_id").agg(F.count("*").alias("size"))
    lists = spark.range(nlist).select(F.col("id").cast("int").alias("list_id"))
    return lists.join(counts, "list_id", "left").select("list_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"))


def ivf_stats(sizes: DataFrame) -> DataFrame:
    """One row: n, nlist, avg_size, max_size, hotspot (the first largest list)."""
    return sizes.agg(F.sum("size").alias("n"), F.count("*").alias("nlist"), F.avg("size").alias("avg_size"), F.max("size").alias("max_size"), (-F.max(F.struct("size", (-F.col("list_id")).alias("k")))["k"]).alias("hotspot"))


def hnsw_stats(graphs: DataFrame, deleted: int = 0) -> DataFrame:
    n = F.sum("n")
    return graphs.agg(n.alias("n"), F.max("levels").alias("levels"), (F.sum("links") / F.greatest(n, F.lit(1))).alias("avg_degree"), (F.lit(float(deleted)) / F.greatest(n, F.lit(1))).alias("tombstone_ratio"))


@dataclass(frozen=True)
class StatsView:
    n: int
    dim: int
    metric: str
    strategy: str
    levels: int | None = None
    avg_degree: float | None = None
    tombstone_ratio: float | None = None
    list_sizes: tuple[int, ...] | None = None


@dataclass(frozen=True)
class Alert:
    code: str
    severity: str
    message: str


Rule = Callable[[StatsView], "Alert | list[Alert] | None"]


def large_dataset(s: StatsView):
    if s.strategy == "bruteforce" and s.n >= LARGE_ROWS:
        return Alert("bf.large-dataset", "warn", f"{s.n} rows: an index would pay")


def low_degree(s: StatsView):
    if s.strategy == "hnsw" and s.avg_degree is not None and s.avg_degree < LOW_DEGREE:
        return Alert("hnsw.low-avg-degree", "info", f"average degree {s.avg_degree:.2f}")


def imbalance(s: StatsView):
    sizes = s.list_sizes or ()
    if s.strategy == "ivf" and sizes and max(sizes) > IMBALANCE * sum(sizes) / len(sizes):
        return Alert("ivf.imbalance", "info", f"ivf.list[{sizes.index(max(sizes))}] size={max(sizes)}")


def tombstones(s: StatsView):
    if s.strategy == "hnsw" and s.tombstone_ratio is not None and s.tombstone_ratio > HIGH_TOMBSTONES:
        return Alert("hnsw.tombstone-high", "warn", f"tombstone ratio {s.tombstone_ratio:.2f}: compact")


BUILT_IN: tuple[Rule, ...] = (large_dataset, low_degree, imbalance, tombstones)


class Rules:
    """A registry of rules; each gives an alert, several, or none."""

    def __init__(self, rules: tuple[Rule, ...] = BUILT_IN):
        self.rules = list(rules)

    def register(self, *rules: Rule) -> None:
        self.rules += rules

    def clear(self) -> None:
        self.rules = []

    def evaluate(self, stats: StatsView) -> list[Alert]:
        found: list[Alert] = []
        for rule in self.rules:
            got = rule(stats)
            found += got if isinstance(got, list) else [got] if got else []
        return found


def diagnose(stats: StatsView, recall: float | None = None) -> dict:
    """Suggestions, hot spots, and the recall measured against the exact search."""
    alerts = Rules().evaluate(stats)
    spots = [a.message for a in alerts if a.code == "ivf.imbalance"]
    if recall is not None and recall < LOW_RECALL:
        alerts.append(Alert("recall.low", "warn", f"recall {recall:.2f}"))
    if stats.strategy == "hnsw" and stats.n < SMALL_ROWS:
        alerts.append(Alert("hnsw.small", "info", f"{stats.n} rows: the exact search is often better"))
    return {"suggestions": alerts, "hotspots": spots, "recall": recall}


def recommendations(per_query: DataFrame, n: int, strategy: str) -> list[str]:
    """From (query_id, recall): what to change."""
    r = per_query.agg(F.avg("recall").alias("avg"), F.sum((F.col("recall") == 0).cast("int")).alias("zero")).first()
    out = []
    if strategy == "bruteforce" and n >= LARGE_ROWS:
        out.append("use an index")
    if strategy == "hnsw" and n < SMALL_ROWS:
        out.append("use the exact search")
    if r["avg"] is not None and r["avg"] < LOW_RECALL:
        out.append("raise ef_search or nprobe")
    if r["zero"]:
        out.append(f"{r['zero']} queries found nothing right")
    return out


def check_consistency(rows: DataFrame, assigned: DataFrame) -> DataFrame:
    """(id, problem): rows without a list, and assignments without a row."""
    lost = rows.select("id").join(assigned.where("list_id is not null").select("id"), "id", "left_anti").withColumn("problem", F.lit("missing_in_index"))
    stray = assigned.select("id").join(rows.select("id"), "id", "left_anti").withColumn("problem", F.lit("missing_in_store"))
    return lost.unionByName(stray)


def compacted(rows: DataFrame, deleted: DataFrame, ratio: float | None = None) -> tuple[DataFrame, int]:
    """Rows without tombstoned ones and how many went. With ``ratio``, only
    if more than that share is dead."""
    dead = rows.join(deleted.select("id").distinct(), "id", "left_semi").count()
    if ratio is not None and dead <= ratio * max(1, rows.count()):
        return rows, 0
    return rows.join(deleted.select("id").distinct(), "id", "left_anti"), dead
