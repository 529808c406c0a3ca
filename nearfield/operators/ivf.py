"""Inverted-file index: centroids, assignments, training, probing.

Centroids are few (``nlist``) and travel in the plan or in closures; the size
is checked. Rows never leave their partitions for an assignment; training
moves one partial sum for each list and task.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import np_normalized, np_scores, query_vector
from ..sources.scratch import shared_path
from ..types import IvfParams, Metric
from .search import QUERY_BLOCK, ROW_SHARD, knn, knn_batch, recall, top_per_query

#: Components of all centroids together that may travel with the plan.
MOST_CENTROID_VALUES = 50_000_000
#: Rows that training looks at; a documented sample, all rows are assigned.
TRAIN_ROWS = 100_000


@dataclass
class IvfIndex:
    """``centroids``: (nlist, dim) floats; ``assigned``: rows with list_id."""

    centroids: np.ndarray
    assigned: DataFrame
    metric: Metric
    params: IvfParams


def _checked(centroids: np.ndarray) -> np.ndarray:
    if centroids.size > MOST_CENTROID_VALUES:
        raise ValueError(f"{len(centroids)} centroids of {centroids.shape[1]} components are too many to send to every task")
    return centroids


def leaders(rows: DataFrame, nlist: int) -> list[tuple[int, list[float]]]:
    """(id, vector) of the first rows by position; they become centroids."""
    return [(r.id, list(r.vector)) for r in rows.select("id", "pos", "vector").orderBy("pos").limit(nlist).collect()]


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def assigned(rows: DataFrame, centroids: np.ndarray, metric: Metric, own: dict[int, int] | None = None) -> DataFrame:
    """``rows`` with list_id: the nearest centroid, the first of equal ones.
    ``own``: ids of leaders, which stay in the list they stand for."""
    centroids, own = _checked(centroids), own or {}

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column(1), centroids.shape[1])
            best = np.concatenate([np_scores(x[at : at + 4096], centroids, metric).argmax(axis=1) for at in range(0, len(x), 4096)]) if len(x) else np.zeros(0, int)
            if own:
                best = np.array([own.get(i, b) for i, b in zip(batch.column(0).to_pylist(), best.tolist())], np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(best.astype(np.int32))], names=[*batch.schema.names, "list_id"])

    rest = [c for c in rows.columns if c not in ("id", "vector")]
    plain = rows.select("id", "vector", *(F.to_json(c).alias(c) if rows.schema[c].dataType.simpleString() == "variant" else F.col(c) for c in rest))
    out = plain.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields), "list_id int"]))
    back = [F.parse_json(c).alias(c) if rows.schema[c].dataType.simpleString() == "variant" else F.col(c) for c in rest]
    return out.select("id", "vector", *back, "list_id")


def seeded(rows: DataFrame, params: IvfParams, metric: Metric) -> IvfIndex:
    """The first ``nlist`` rows are the centroids; all others join the nearest."""
    first = leaders(rows, params.nlist)
    centroids = np.array([v for _, v in first], np.float32).reshape(len(first), -1)
    if not len(first):
        return IvfIndex(centroids, rows.withColumn("list_id", F.lit(None).cast("int")), metric, params)
    return IvfIndex(centroids, assigned(rows, centroids, metric, {i: k for k, (i, _) in enumerate(first)}), metric, params)


def kmeans_step(rows: DataFrame, centroids: np.ndarray, metric: Metric) -> DataFrame:
    """(list_id, n, vector) with the sums of each list: one partial sum for
    each list and task, added up by list."""
    centroids = _checked(centroids)
    n, dim = centroids.shape

    def run(batches):
        total, count = np.zeros((n, dim)), np.zeros(n, np.int64)
        for batch in batches:
            x = _matrix(batch.column(0), dim)
            for at in range(0, len(x), 4096):
                part = x[at : at + 4096].astype(np.float64)
                best = np_scores(part, centroids, metric).argmax(axis=1)
                np.add.at(total, best, part)
                count += np.bincount(best, minlength=n)
        full = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({"list_id": pa.array(full.astype(np.int32)), "n": pa.array(count[full]), "sums": pa.array(list(total[full]), pa.list_(pa.float64()))})

    parts = rows.select("vector").mapInArrow(run, "list_id int, n long, sums array<double>")
    each = parts.select("list_id", "n", F.posexplode("sums").alias("d", "x")).groupBy("list_id", "d").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return each.groupBy("list_id").agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("sums"))


def trained(rows: DataFrame, params: IvfParams, metric: Metric, iters: int = 10, seed: int = 42, start: np.ndarray | None = None, most_rows: int = TRAIN_ROWS) -> np.ndarray:
    """Lloyd's centroids. Starts from distinct random rows unless ``start`` is
    given; above ``most_rows`` rows it learns from a random sample of about so
    many. Lists that stay empty keep their centroid; spherical unless l2."""
    n = rows.count()
    learn = rows.select("id", "vector")
    if n > most_rows:
        learn = learn.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < int(most_rows / n * 1_000_003))
    learn = learn.persist()
    try:
        if start is None:
            first = learn.orderBy(F.xxhash64("id", F.lit(seed + 1)), "id").limit(params.nlist).collect()
            start = np.array([list(r.vector) for r in first], np.float32).reshape(len(first), -1)
            if 0 < len(start) < params.nlist:
                start = start[np.arange(params.nlist) % len(start)]
        centroids = start.astype(np.float32)
        for _ in range(iters if len(centroids) else 0):
            new = centroids.copy()
            for r in kmeans_step(learn, centroids, metric).collect():  # nlist rows
                mean = (np.array(r.sums) / r.n).astype(np.float32)
                new[r.list_id] = mean if metric == Metric.L2 else np_normalized(mean)
            if np.array_equal(new, centroids):
                break
            centroids = new
        return centroids
    finally:
        learn.unpersist()


def build(rows: DataFrame, params: IvfParams, metric: Metric, iters: int = 10, seed: int = 42) -> IvfIndex:
    """Trained centroids, every row assigned; the lists are written once, by
    list, in the shared folder, so a search reads those it probes."""
    centroids = trained(rows, params, metric, iters, seed)
    if not len(centroids):
        return seeded(rows, params, metric)
    path = shared_path(rows.sparkSession, "lists")
    save(IvfIndex(centroids, assigned(rows, centroids, metric), metric, params), path)
    return IvfIndex(centroids, rows.sparkSession.read.parquet(f"{path}/lists"), metric, params)


def probes(index: IvfIndex, query, nprobe: int | None = None) -> list[int]:
    """The lists nearest to a query, the first of equal ones."""
    q = np.array([query_vector(query, index.centroids.shape[1], index.metric)], np.float32)
    s = np_scores(q, index.centroids, index.metric)[0]
    return [int(k) for k in np.argsort(-s, kind="stable")[: min(nprobe or index.params.nprobe, len(s))]]


def search(index: IvfIndex, query, k: int | None = None, where: Column | None = None, nprobe: int | None = None) -> DataFrame:
    """Scans the probed lists only: a filter on ``list_id``, which prunes
    partitions where the index was written by list."""
    return knn(rows_of(index, query, nprobe), query, index.centroids.shape[1], index.metric, k, where)


def repaired(index: IvfIndex, rows: DataFrame) -> IvfIndex:
    """Rows that no list has are assigned, assignments without a row go; all
    others stay where they are."""
    kept = index.assigned.where("list_id is not null").join(rows.select("id"), "id", "left_semi")
    lost = rows.select(*(c for c in index.assigned.columns if c != "list_id")).join(kept.select("id"), "id", "left_anti")
    return replace(index, assigned=kept.unionByName(assigned(lost, index.centroids, index.metric)))


def rows_of(index: IvfIndex, query, nprobe: int | None = None) -> DataFrame:
    """The rows of the lists that a query probes."""
    return index.assigned.where(F.col("list_id").isin(probes(index, query, nprobe)))


def search_batch(index: IvfIndex, queries: DataFrame, k: int, nprobe: int | None = None, with_self: bool = True, slice_rows: int = ROW_SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """Many queries: each goes to its probed lists only; lists are cut in
    slices and queries in blocks, so a large list is many tasks."""
    blocks = max(1, -(-queries.count() // query_block))
    centroids, metric = _checked(index.centroids), index.metric
    many = min(nprobe or index.params.nprobe, len(centroids))

    def route(batches):
        for batch in batches:
            x = _matrix(batch.column(1), centroids.shape[1])
            lists = np.argsort(-np_scores(x, centroids, metric), axis=1, kind="stable")[:, :many] if len(x) else np.zeros((0, many), int)
            at = np.repeat(np.arange(len(x)), many)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(lists.ravel().astype(np.int32))], names=["id", "vector", "list_id"])

    sizes = index.assigned.groupBy("list_id").count().withColumn("slices", F.ceil(F.col("count") / slice_rows).cast("int")).select("list_id", "slices")
    sizes = F.broadcast(sizes)  # one row for each list
    rows = index.assigned.select("id", "vector", "list_id").join(sizes, "list_id")
    left = rows.select("list_id", F.pmod(F.xxhash64("id"), "slices").cast("int").alias("slice"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("query"), "id", "vector")
    asked = queries.select("id", "vector").mapInArrow(route, "id long, vector array<float>, list_id int").join(sizes, "list_id")
    right = asked.select("list_id", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("query"), "id", "vector")
    from .search import _best

    found = left.union(right).groupBy("list_id", "slice", "block").applyInArrow(lambda t: _best(t, metric, k, with_self), "query_id long, id long, score double")
    return top_per_query(found, k)


def evaluate(index: IvfIndex, queries: DataFrame, k: int, nprobe: int | None = None) -> DataFrame:
    """(query_id, recall) against the exact search."""
    truth = knn_batch(index.assigned, queries, index.metric, k)
    return recall(search_batch(index, queries, k, nprobe), truth, k)


def centroid_frame(spark: SparkSession, centroids: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(k, [float(x) for x in c]) for k, c in enumerate(centroids)], "list_id int, vector array<float>")


def save(index: IvfIndex, path: str) -> None:
    """Centroids, and the rows partitioned by list; a large list is several
    files, none is one task's alone."""
    centroid_frame(index.assigned.sparkSession, index.centroids).write.mode("overwrite").parquet(f"{path}/centroids")
    index.assigned.hint("rebalance", "list_id").write.mode("overwrite").partitionBy("list_id").parquet(f"{path}/lists")


def load(spark: SparkSession, path: str, metric: Metric, params: IvfParams) -> IvfIndex:
    rows = spark.read.parquet(f"{path}/centroids").orderBy("list_id").collect()
    return IvfIndex(np.array([list(r.vector) for r in rows], np.float32).reshape(len(rows), -1), spark.read.parquet(f"{path}/lists"), metric, params)
