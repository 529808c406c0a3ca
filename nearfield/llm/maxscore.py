"""Exact top-k by inner product with MaxScore over inverted lists.

Vectors are cut into shards, queries into blocks; each task holds one shard's
lists (one for each component) and answers one block. For a query, each
component has a score bound: the most that any vector of the shard gains from
it. Components in order of bound split into non-essential ones, whose bounds
together stay below the k-th best score so far, and essential ones. Essential
lists are traversed; the most promising vectors are then scored in full, which
raises the k-th best; vectors that could still reach it are probed for the
other components, a few lists at a time, for as long as they can. The first
shard is answered first: the k-th best it has is where the others start. The
shards' results are merged by query. Ties go to the smaller id; bounds cut
only what scores below the k-th best, so the result is exact.

Vectors that are null, or hold a null or a component that isn't finite, take
no part, nor do rows without an id. A vector shorter than others counts as
zero in the components it lacks, an empty one in all. Rows of the query's own id are no candidates.
Repeated rows are candidates each. Scores must fit 53 bits in sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARD, BLOCK = 4096, 1024
#: Vectors scored in full to get a first k-th best; lists probed at a time.
SEED, PROBE = 64, 8


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; null where the vector takes no part."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


class Shard:
    """Lists of one shard: for each component the values of all its vectors."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.lists = ids[order], np.ascontiguousarray(rows[order].T.astype(np.float64))
        self.high, self.low = self.lists.max(axis=1), self.lists.min(axis=1)

    def top(self, query: np.ndarray, own: int, k: int, least: float = -np.inf) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores. ``least``: what a k-th best has at least."""
        bound = np.maximum(query * self.high, query * self.low)
        order = np.argsort(bound, kind="stable")  # least first
        other = self.ids != own
        if least == -np.inf:
            least = self._kth(query, np.flatnonzero(other)[:SEED], k, least)
        # the longest beginning whose bounds stay below the k-th best
        upto = np.cumsum(bound[order])
        split = int(np.searchsorted(np.maximum.accumulate(upto), least)) if least > 0 else 0
        split = min(split, len(order) - 1)
        essential, others = order[split:], order[:split][::-1]
        score = query[essential] @ self.lists[essential]
        rest = bound[others].sum()
        live = np.flatnonzero(other & (score + rest >= least))
        if len(others) and len(live) > SEED:
            best = live[np.argpartition(score[live], len(live) - SEED)[-SEED:]]
            least = self._kth(query, best, k, least)
        fit = score[live] + rest >= least
        live, score = live[fit], score[live[fit]]
        for at in range(0, len(others), PROBE):
            part = others[at : at + PROBE]
            score = score + query[part] @ self.lists[np.ix_(part, live)]
            rest -= bound[part].sum()
            fit = score + rest >= least
            live, score = live[fit], score[fit]
        if len(live) > k:
            cut = np.partition(score, len(score) - k)[len(score) - k]
            fit = score >= cut
            live, score = live[fit], score[fit]
        first = np.lexsort((self.ids[live], -score))[:k]
        return self.ids[live[first]], score[first]

    def _kth(self, query: np.ndarray, rows: np.ndarray, k: int, least: float) -> float:
        if len(rows) < k:
            return least
        return max(least, float(np.sort(query @ self.lists[:, rows])[-k]))


def _dense(column: pa.ChunkedArray) -> np.ndarray:
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.repeat(np.arange(len(size)), size), np.concatenate([np.arange(s) for s in size]) if len(size) else np.zeros(0, int)] = lists.flatten().to_numpy()
    return out


def _answer(table: pa.Table, k: int) -> pa.Table:
    rows, ids, query = _dense(table.column("v")), table.column("id").to_numpy(), table.column("query").to_numpy(zero_copy_only=False)
    least = table.column("least").fill_null(-np.inf).to_numpy()
    rows = rows if rows.shape[1] else np.zeros((len(ids), 1))
    out: list[tuple] = []
    if not query.all():
        shard = Shard(ids[~query], rows[~query])
        for q in np.flatnonzero(query):
            found, score = shard.top(rows[q], ids[q], k, least[q])
            out += zip([ids[q]] * len(found), found, score)
    return pa.table({n: pa.array([int(r[i]) for r in out], pa.int64()) for i, n in enumerate(("query_id", "id", "score"))})


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """``vectors``, ``queries``: (id long, v array<long>) and more. Returns
    query_id, rank (from 1), id, score: for each query its ``k`` best vectors."""
    vectors, queries = written(vectors.select("id", "v").where("id is not null and v is not null")), written(queries.select("id", "v").where("id is not null and v is not null"))
    shards, blocks = max(1, -(-vectors.count() // shard)), max(1, -(-queries.count() // block))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    none = F.lit(None).cast("double").alias("least")

    def met(parts: list[int], asked: DataFrame) -> DataFrame:
        """The answers of some shards."""
        every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        left = vectors.select(own(shards).alias("shard"), every.alias("block"), F.lit(False).alias("query"), "id", "v", none).where(F.col("shard").between(parts[0], parts[-1]))
        right = asked.select(F.explode(F.sequence(F.lit(parts[0]), F.lit(parts[-1]))).alias("shard"), own(blocks).alias("block"), F.lit(True).alias("query"), "id", "v", "least")
        return left.union(right).groupBy("shard", "block").applyInArrow(lambda t: _answer(t, k), "query_id long, id long, score long")

    found = met([0], queries.select("id", "v", none))
    if shards > 1:
        found = written(found)
        # repeated rows answer for each query of their id; any k of them are a bound
        kth = F.element_at(F.sort_array(F.collect_list("score"), asc=False), k)
        floor = found.groupBy("query_id").agg(F.count("*").alias("n"), kth.cast("double").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("id"), "least")
        rest = met([1, shards - 1], queries.join(floor, "id", "left").select("id", "v", "least"))
        found = found.union(rest)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
