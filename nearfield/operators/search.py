"""Exact nearest neighbours: one query, many queries, sharded, filtered.

One query is a projection and a top-k; Catalyst filters before it scores and
plans ``TakeOrderedAndProject``. Many queries meet the rows in a grid of
shards and query blocks of fixed size, scored by NumPy in the same order of
addition; nothing is broadcast, so either side may grow.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kernels import literal_vector, np_candidates, query_vector, score
from ..types import Metric

#: Cells of the grid are large: a row moves once for each block, a query for each shard.
ROW_SHARD, QUERY_BLOCK = 16384, 16384


def k_of(k: int | None) -> int:
    return max(1, 5 if k is None else int(k))


def knn(rows: DataFrame, query, dim: int, metric: Metric, k: int | None = None, where: Column | None = None, id_col: str = "id") -> DataFrame:
    """Hits of one query, best first; ties by id. ``where`` applies before scoring."""
    q = literal_vector(query_vector(query, dim, metric))
    found = rows if where is None else rows.where(where)
    meta = [c for c in ("meta",) if c in rows.columns]
    return found.select(id_col, score(F.col("vector"), q, metric).alias("score"), *meta).orderBy(F.col("score").desc(), id_col).limit(k_of(k))


def find(rows: DataFrame, query, dim: int, metric: Metric, where: Column | None = None) -> DataFrame:
    return knn(rows, query, dim, metric, 1, where)


def post_filtered(hits: DataFrame, keep: Column | Callable) -> DataFrame:
    """A caller's own test after top-k: a Column, or a Python function of
    (id, meta as JSON) that runs on the few hits."""
    if isinstance(keep, Column):
        return hits.where(keep)
    test = F.udf(lambda i, m: bool(keep(i, m)), "boolean")
    return hits.where(test(F.col("id"), F.to_json("meta")))


def _best(table: pa.Table, metric: Metric, k: int, with_self: bool, step: int = 256) -> pa.Table:
    """The k best rows of each query. Equal vectors are scored once; of those
    that are hits the smallest ids come first."""
    ids, is_query = table.column("id").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
    vectors = table.column("vector").combine_chunks()
    size = len(vectors[0]) if len(vectors) else 0
    x = vectors.flatten().to_numpy().reshape(len(ids), size)
    q, r = np.flatnonzero(is_query), np.flatnonzero(~is_query)
    r = r[np.argsort(ids[r], kind="stable")]
    out_q, out_i, out_s = [], [], []
    if len(q) and len(r):
        same = np.ascontiguousarray(x[r]).view(np.dtype((np.void, x.itemsize * size))).ravel() if size else np.zeros(len(r), int)
        _, first, own = np.unique(same, return_index=True, return_inverse=True)
        many = np.bincount(own)
        members, begin = r[np.argsort(own, kind="stable")], np.cumsum(many) - many
        # a query's own rows may be among its best and are left out after
        most = k if with_self else k + int(np.unique(ids[r], return_counts=True)[1].max())
        for at in range(0, len(q), step):
            part = q[at : at + step]
            i, c, s = np_candidates(x[part], x[r[first]], metric, most)
            n = np.minimum(many[c], most)
            j = members[np.repeat(begin[c] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            i, s = np.repeat(i, n), np.repeat(s, n)
            if not with_self:
                i, j, s = (v[ids[part][i] != ids[j]] for v in (i, j, s))
            order = np.lexsort((ids[j], -s, i))
            i, j, s = i[order], j[order], s[order]
            fine = np.arange(len(i)) - np.searchsorted(i, i) < k
            out_q.append(ids[part][i[fine]])
            out_i.append(ids[j[fine]])
            out_s.append(s[fine])
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else np.zeros(0, kind))
    return pa.table({"query_id": join(out_q, np.int64), "id": join(out_i, np.int64), "score": join(out_s, np.float64)})


def knn_batch(rows: DataFrame, queries: DataFrame, metric: Metric, k: int, with_self: bool = True, row_shard: int = ROW_SHARD, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``rows``, ``queries``: (id, vector) in stored form. query_id, rank, id,
    score. Every (shard, block) gives its k best; a query's are merged."""
    rows, queries = rows.select("id", "vector"), queries.select("id", "vector")
    shards, blocks = max(1, -(-rows.count() // row_shard)), max(1, -(-queries.count() // query_block))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    left = rows.select(own(shards).alias("shard"), every(blocks).alias("block"), F.lit(False).alias("query"), "id", "vector")
    right = queries.select(every(shards).alias("shard"), own(blocks).alias("block"), F.lit(True).alias("query"), "id", "vector")
    found = left.union(right).groupBy("shard", "block").applyInArrow(lambda t: _best(t, metric, k, with_self), "query_id long, id long, score double")
    return top_per_query(found, k)


def top_per_query(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def knn_sharded(sharded: DataFrame, query, dim: int, metric: Metric, k: int | None = None, where: Column | None = None) -> DataFrame:
    """``sharded``: rows with a shard column. The best of each shard, then of
    those; the shard of each hit is kept."""
    q = literal_vector(query_vector(query, dim, metric))
    found = sharded if where is None else sharded.where(where)
    found = found.select("shard", "id", score(F.col("vector"), q, metric).alias("score"))
    local = Window.partitionBy("shard").orderBy(F.col("score").desc(), "id")
    return found.withColumn("__r", F.row_number().over(local)).where(F.col("__r") <= k_of(k)).drop("__r").orderBy(F.col("score").desc(), "id").limit(k_of(k))


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall): hits among the true ones, over k."""
    hit = found.select("query_id", "id", F.lit(1).alias("hit"))
    joined = truth.select("query_id", "id").join(hit, ["query_id", "id"], "left")
    return joined.groupBy("query_id").agg((F.sum(F.coalesce("hit", F.lit(0))) / F.lit(float(max(1, k)))).alias("recall"))


def recall_report(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, missing, extra): with the ids in question."""
    a = found.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("got"))
    b = truth.groupBy("query_id").agg(F.sort_array(F.collect_set("id")).alias("want"))
    none = F.array().cast("array<long>")
    df = b.join(a, "query_id", "left").withColumn("got", F.coalesce("got", none))
    return df.select("query_id", (F.size(F.array_intersect("got", "want")) / F.lit(float(max(1, k)))).alias("recall"), F.array_except("want", "got").alias("missing"), F.array_except("got", "want").alias("extra"))
