"""Steps whose work has to stay small on large tables."""

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield import queries
from nearfield.functions.kernels import np_scores
from nearfield.operators import hnsw, search
from nearfield.types import HnswParams, Metric


def vectors(n, dim=64, seed=0):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("metric", list(Metric))
@pytest.mark.parametrize("kind", ["plain", "copies", "huge", "not finite", "zero"])
@pytest.mark.parametrize("with_self", [True, False])
def test_exact_search_scores_few_pairs_and_finds_all(metric, kind, with_self):
    from nearfield.functions.kernels import np_candidates

    x, ids = vectors(600), np.random.default_rng(1).permutation(600)
    if kind == "copies":
        x[200:500] = x[0]
    if kind == "huge":
        x *= np.float32(1e18)
    if kind == "zero":
        x[:40] = 0
    if kind == "not finite":
        x[5], x[6] = np.nan, np.inf
    if kind == "plain":
        assert len(np_candidates(x[:100], x, metric, 10)[0]) < 1100  # of 60,000
    table = pa.table({"id": pa.array(np.r_[ids, ids[:60]]), "query": pa.array(np.arange(660) >= 600), "vector": pa.array(list(np.r_[x, x[:60]]), pa.list_(pa.float32()))})
    got = search._best(table, metric, 10, with_self).to_pydict()
    want = []
    for i in range(60):
        s = np_scores(x[i : i + 1], x, metric)[0]
        fine = (s > -np.inf) & (with_self | (ids != ids[i]))
        best = sorted((-s[j], ids[j]) for j in np.flatnonzero(fine))[:10]
        want += [(ids[i], j, -t) for t, j in best]
    assert list(zip(got["query_id"], got["id"], got["score"])) == want


@pytest.mark.parametrize("metric", list(Metric))
def test_graph_links_to_the_nearest_and_walks_in_step_find_them(metric):
    x = vectors(900, 16)
    x[300:420] = x[0]
    g = hnsw.Graph.build(np.arange(900), x, HnswParams(), metric)
    s = np_scores(x, x, metric)
    for i in (20, 250, 350, 899):
        near = set(sorted(range(i), key=lambda j: (-s[i, j].round(5), j))[:16])
        last = min(s[i, j] for j in near)
        assert all(s[i, j] >= last - 1e-5 for j in g.layers[0].near[i])
    rows, nodes = g.walk(x[500:], 10)
    scores = g.scores(x[500:], rows, nodes)
    assert len(set(zip(rows, nodes))) == len(rows) == 4000
    best = -np.sort(-s[500:], axis=1)[:, :10]
    assert np.mean([np.isin(best[i].round(9), scores[rows == i].round(9)).mean() for i in range(400)]) >= 0.9
    one = [set(i for i, _ in g.search(q, 10)) for q in x[500:550]]
    assert np.mean([len(one[i] & set(nodes[rows == i])) / 10 for i in range(50)]) >= 0.9


def test_a_full_graph_is_built_and_searched_in_seconds():
    x = vectors(hnsw.SHARD_ROWS)
    began = time.perf_counter()
    g = hnsw.Graph.build(np.arange(len(x)), x, HnswParams(), Metric.COSINE)
    assert time.perf_counter() - began < 15  # 80 when each row walked
    back = hnsw.Graph.restore(g.dump())
    rows, nodes = back.walk(x[:500], 10)
    assert all(np.array_equal(a, b) for a, b in zip((rows, nodes), g.walk(x[:500], 10)))
    truth = np.argsort(-(x[:500] @ x.T), axis=1)[:, :10]
    assert np.mean([len(set(truth[i]) & set(nodes[rows == i])) / 10 for i in range(500)]) >= 0.85


def test_graphs_of_the_shards_query_stay_small(spark, tmp_path, monkeypatch):
    x = vectors(1000)
    rows = spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    monkeypatch.setattr(hnsw, "SHARD_ROWS", 50)
    made, build = [], hnsw.build
    monkeypatch.setattr(hnsw, "build", lambda *a: made.append(build(*a)) or made[-1])
    assert queries.hnsw_shards_recall(spark, str(tmp_path)).agg(F.avg("recall")).first()[0] >= 0.9
    assert made[0].count() == 20
