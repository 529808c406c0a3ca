"""Small cases with known answers, end to end."""

import json
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions.hashes import fnv1a, hash32, hash_embed
from nearfield.functions.kernels import np_normalized
from nearfield.operators import hnsw, ivf, maintenance, search
from nearfield.operators.attr_index import AttrIndex
from nearfield.operators.collection import Collection, connect
from nearfield.plans.placement import PlacementMap, located, numbered, rebalance_plan, segments, shard_plan
from nearfield.sources import codec, snapshot, storage, text
from nearfield.sources.seed import seed_rows
from nearfield.streaming import wal
from nearfield.types import DimMismatch, HnswParams, IvfParams, Metric, Strategy, from_code, u32


def rows_of(spark, vectors, metas=None, ids=None):
    ids = ids or list(range(1, len(vectors) + 1))
    data = [(i, [float(x) for x in v], json.dumps(m) if m is not None else None, k) for k, (i, v, m) in enumerate(zip(ids, vectors, metas or [None] * len(ids)))]
    df = spark.createDataFrame(data, "id long, vector array<float>, m string, ord long")
    return df.select("id", "vector", F.parse_json("m").alias("meta"), "ord")


def collection(spark, vectors, metas=None, ids=None, metric="cosine", **more):
    c = Collection.create(spark, len(vectors[0]), metric, **more)
    return c.add(rows_of(spark, vectors, metas, ids))


def clusters(n=60, dim=4, seed=1):
    rng = np.random.default_rng(seed)
    return [np.eye(dim)[k % 3] + rng.uniform(-0.05, 0.05, dim) for k in range(n)]


def test_types():
    assert u32(-1) == 2**32 - 1 and u32(2**32 + 5) == 5
    assert from_code(Metric, 1) is Metric.L2 and from_code(Strategy, 2) is Strategy.IVF
    with pytest.raises(ValueError):
        from_code(Metric, 9)
    assert IvfParams().nprobe == 8 and IvfParams(10, 99).nprobe == 10 and IvfParams(0).nlist == 1


def test_search_filters_first(spark):
    c = collection(spark, [[1, 0], [0.9, 0.1]], [{"g": "a"}, {"g": "b"}])
    assert [r.id for r in c.find_many([1, 0], 2, keep=F.col("id") != 2).collect()] == [1]
    with pytest.raises(DimMismatch, match="got 3, want 2"):
        c.find_many([1, 0, 0])


def test_metrics(spark):
    for metric, want in (("dot", [(1, 2.0), (2, 0.0)]), ("l2", [(1, -1.0), (2, -5.0)]), ("cosine", [(1, 1.0), (2, 0.0)])):
        c = collection(spark, [[2, 0], [0, 2]], metric=metric)
        assert [(r.id, r.score) for r in c.find_many([1, 0], 5).collect()] == want
    zero = collection(spark, [[0, 0]])
    assert list(zero.get(1).vector) == [0, 0]


def test_expr_and_attrs(spark):
    c = collection(spark, [[1, 0, 0], [0, 1, 0], [0.9, 0.1, 0]])
    attrs = spark.createDataFrame([(1, '{"color":"red","price":10}'), (2, '{"color":"blue","price":20}'), (3, '{"color":"red","price":15}')], "id long, a string").select("id", F.parse_json("a").alias("attrs"))
    from dataclasses import replace

    c = replace(c, attrs=attrs)
    expr = {"must": [{"key": "color", "match": "red"}, {"key": "price", "range": {"gte": 10, "lt": 20}}]}
    for index in (None, AttrIndex.build(attrs), AttrIndex.build(attrs, "bitmap")):
        assert {r.id for r in c.find_many([1, 0, 0], 5, expr, attr_index=index).collect()} == {1, 3}
    ix = AttrIndex.build(attrs)
    assert {r.id for r in ix.eq("color", "red").collect()} == {1, 3} and ix.eq("price", "10").count() == 0
    gone = ix.remove(spark.createDataFrame([(1,)], "id long"))
    assert {r.id for r in gone.eq("color", "red").collect()} == {3}
    swapped = ix.set_attrs(attrs.where("id = 2").select("id", F.parse_json(F.lit('{"color":["red","x"]}')).alias("attrs")))
    assert {r.id for r in swapped.eq("color", "red").collect()} == {1, 2, 3} and swapped.eq("color", "blue").count() == 0
    assert ix.candidates({"must_not": [{"key": "color", "match": "red"}]}) is None
    with pytest.raises(ValueError):
        AttrIndex.build(attrs, "tree")


def test_changes(spark):
    c = collection(spark, [[1, 0], [0, 1]], [{"x": 1}, {"x": 2}])
    with pytest.raises(ValueError, match="already exists"):
        c.add(rows_of(spark, [[1, 1]], ids=[2]))
    c2, report = c.push(rows_of(spark, [[1, 1], [1, 2], [2, 2]], ids=[2, 3, 3]))
    assert sorted((r.id, r.ord, r.outcome) for r in report.collect()) == [(2, 0, "skipped"), (3, 1, "created"), (3, 2, "skipped")] and c2.size() == 3
    c3, report = c2.upsert(rows_of(spark, [[5, 0], [0, 5]], [{"x": 9}, None], ids=[1, 7]))
    assert {r.id: r.outcome for r in report.collect()} == {1: "updated", 7: "created"}
    assert {(r.id, r.pos) for r in c3.rows.collect()} == {(1, 0), (2, 1), (3, 2), (7, 3)}
    bad = rows_of(spark, [[1, 0], [1, 0, 0]], ids=[1, 2])
    c4, report, wrong = c.upsert_valid(bad)
    assert report.count() == 1 and [r.error for r in wrong.collect()] == ["dim mismatch: got 3, want 2"]
    assert c.upsert_valid(bad, all_or_nothing=True)[1].count() == 0
    c5, report = c.remove(spark.createDataFrame([(1,), (3,)], "id long"))
    assert {r.id: r.outcome for r in report.collect()} == {1: "removed", 3: "missing"} and not c5.has(1) and c5.get(1) is None
    meta = spark.createDataFrame([(1, '{"y":3}', 0), (1, "null", 1), (9, "1", 2)], "id long, m string, ord long").select("id", F.parse_json("m").alias("meta"), "ord")
    c6, report = c.set_meta(meta)
    assert {r.id: r.outcome for r in report.collect()} == {1: "updated", 9: "missing"} and c6.get_meta(1).toJson() == "null"
    assert list(c.set_vector(rows_of(spark, [[0, 3]], ids=[1])).get(1).vector) == [0, 1]


def test_ivf(spark):
    vs = clusters(100)
    c = collection(spark, vs, strategy="ivf", params=IvfParams(8, 4)).with_index()
    found = [r.id for r in c.find_many(vs[0], 5).collect()]
    truth = [r.id for r in c.with_index("bruteforce").find_many(vs[0], 5).collect()]
    assert len(set(found) & set(truth)) >= 4
    asked = c.rows.where("id % 10 = 0").select("id", "vector")
    assert ivf.evaluate(c.index, asked, 10).agg(F.avg("recall")).first()[0] >= 0.9
    gone, _ = c.remove(spark.createDataFrame([(1,)], "id long"))
    assert 1 not in [r.id for r in gone.find_many(vs[0], 5).collect()]
    assert len(c.stats().list_sizes) == 8 and sum(c.stats().list_sizes) == 100
    lost = c.index.assigned.where("id > 2")
    assert {r.id for r in maintenance.check_consistency(c.rows, lost).collect()} == {1, 2}


def test_ivf_round_trip(spark, tmp_path):
    c = collection(spark, clusters(30), strategy="ivf", params=IvfParams(4, 2)).with_index()
    ivf.save(c.index, str(tmp_path / "i"))
    back = ivf.load(spark, str(tmp_path / "i"), Metric.COSINE, IvfParams(4, 2))
    assert np.array_equal(back.centroids, c.index.centroids)
    one = ivf.search(back, clusters(30)[0], 5)
    assert [r.id for r in one.collect()] == [r.id for r in ivf.search(c.index, clusters(30)[0], 5).collect()]
    assert "PartitionFilters: [list_id" in one._jdf.queryExecution().explainString(one._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).replace("isnotnull(list_id), ", "")


def test_hnsw(spark):
    four = collection(spark, [[1, 0, 0, 0], [0.9, 0, 0, 0], [0, 1, 0, 0], [0, 0.9, 0, 0]], strategy="hnsw", params=HnswParams(8, 32, 16, 123)).with_index()
    assert len(four.find_many([0.95, 0, 0, 0], 2).collect()) == 2
    gone, _ = four.remove(spark.createDataFrame([(1,)], "id long"))
    assert [r.id for r in gone.find_many([1, 0, 0, 0], 1).collect()] == [2] and gone.size() == 3
    packed, n = gone.compacted(0.2)
    assert n == 1 and packed.get(1) is None and [r.id for r in packed.find_many([1, 0, 0, 0], 1).collect()] == [2]
    assert gone.stats().tombstone_ratio == 0.25


def test_hnsw_recall_and_dump():
    x = np.random.default_rng(0).normal(size=(600, 16))
    x = np.array([np_normalized(v) for v in x])
    g = hnsw.Graph.build(np.arange(600), x, HnswParams(), Metric.COSINE)
    back = hnsw.Graph.restore(g.dump())
    hits = 0
    for q in x[:30]:
        truth = set(np.argsort(-(x.astype(float) @ q), kind="stable")[:10].tolist())
        found = g.search(q, 10)
        assert found == back.search(q, 10)
        hits += len(truth & {i for i, _ in found})
    assert hits / 300 >= 0.9
    masked = g.search(x[0], 5, control=hnsw.Control(mode="hard", mask=tuple(range(0, 600, 2))))
    assert masked and all(i % 2 == 0 for i, _ in masked)
    assert all(i % 2 == 0 for i, _ in g.search(x[0], 5, control=hnsw.Control(mode="soft", mask=tuple(range(0, 600, 2)), bridge_budget=200)))


@pytest.mark.parametrize("n,seeds,want", [(0, "auto", 1), (4, "auto", 2), (100, "auto", 8), (10, 0, 1), (10, 5, 5), (10, 100, 32)])
def test_num_seeds(n, seeds, want):
    assert hnsw.num_seeds(n, seeds) == want


def test_batch_blocks(spark):
    c = collection(spark, clusters(50), metric="l2")
    whole = search.knn_batch(c.rows, c.rows, Metric.L2, 4)
    cut = search.knn_batch(c.rows, c.rows, Metric.L2, 4, row_shard=7, query_block=9)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(whole) == key(cut) and whole.count() == 200
    assert search.knn_batch(c.rows, c.rows, Metric.L2, 4, with_self=False).where("query_id = id").count() == 0


def test_shards(spark):
    df = spark.createDataFrame([(i,) for i in (3, 1, 2, 5, 4)], "id long")
    got = {r.id: r.shard for r in shard_plan(df, 2, "range").collect()}
    assert {i for i, s in got.items() if s == 0} == {1, 3, 5}
    assert {r.id: r.shard for r in shard_plan(df, 2).collect()} == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}
    many = spark.range(1000).select((F.col("id") * 37 % 1000).alias("id"))
    assert numbered(many, "id", 7).where("id <> __n").count() == 0


def test_placement(spark):
    df = spark.createDataFrame([(i,) for i in (0, 1, 2, 3, 4, 5, 42, 1000)], "id long")
    h = {r.id: r.h for r in df.select("id", hash32(F.col("id")).alias("h")).collect()}
    assert h == {0: 0, 1: 1753845897, 2: 3507691795, 3: 1408364529, 4: h[4], 5: h[5], 42: 388448039, 1000: 1407128543}
    at = {r.id: (r.pg, r.primaries) for r in located(df, PlacementMap(64, 2, ("0", "1", "2"))).collect()}
    assert {i: at[i] for i in range(1, 6)} == {1: (9, ["0", "1"]), 2: (19, ["1", "2"]), 3: (49, ["2", "1"]), 4: (62, ["1", "0"]), 5: (5, ["2", "0"])}
    sized = spark.range(5).selectExpr("id", "id AS pos", "0L AS pg", "40L AS bytes")
    assert [(r.part, r.offset) for r in segments(sized, 64).orderBy("id").collect()] == [(0, 8), (0, 48), (1, 8), (1, 48), (2, 8)]
    manifest = spark.createDataFrame([("db.pg1.part0", "a"), ("odd", "a")], "name string, target string")
    assert rebalance_plan(manifest, PlacementMap(64, 1, ("a",))).count() == 0
    assert [r.target for r in rebalance_plan(manifest, PlacementMap(64, 1, ("b",))).collect()] == ["b"]


def test_text(spark):
    assert text.parse_vector(" 1, 2 3 ", 3) == [1, 2, 3] and text.parse_vector("1 x", 2) is None
    df = spark.createDataFrame([("Hello, hello world-1 ü",), ("",)], "t string")
    got = [list(r[0]) for r in df.select(hash_embed(F.col("t"), 16)).collect()]
    assert got == [text.hash_embed("Hello, hello world-1 ü", 16), [0.0] * 16] and sum(got[0]) == 3
    assert df.select(fnv1a(F.lit("a"))).first()[0] == 0xE40C292C
    short = spark.createDataFrame([([1.0, 2.0, 3.0],)], "v array<float>")
    assert list(short.select(text.fitted(F.col("v"), 2)).first()[0]) == [1, 2] and list(short.select(text.fitted(F.col("v"), 5)).first()[0]) == [1, 2, 3, 0, 0]


def test_seed(spark):
    last = seed_rows(spark, 70, 64).orderBy(F.desc("idx")).first()
    assert (last.id, last.group, last.bucket, last.key) == (70, "g5", "b5", "item-70")


RECORDS = [
    {"type": "upsert", "id": 42, "vector": [1.0, 0.0], "meta": {"t": "x"}}, {"type": "setMeta", "id": 42, "meta": {"t": "y"}}, {"type": "upsert", "id": 1, "vector": [0.0, 1.0], "meta": None},
    {"type": "remove", "id": 42}, {"type": "setMeta", "id": 42, "meta": 5}, {"type": "upsert", "id": 7, "vector": [1.0, 1.0], "meta": {"a": [1]}}, {"type": "setMeta", "id": 1, "meta": None},
]


def log_frame(spark, records, first=0):
    rows = [(first + k, r["type"], r["id"], r.get("vector"), json.dumps(r.get("meta"))) for k, r in enumerate(records)]
    return spark.createDataFrame(rows, "seq long, type string, id long, vector array<float>, m string").select("seq", "type", "id", "vector", F.parse_json("m").alias("meta"))


def test_log_fold(spark):
    got = {r.id: (list(r.vector), r.meta.toJson()) for r in wal.fold(log_frame(spark, RECORDS)).collect()}
    assert got == {1: ([0, 1], "null"), 7: ([1, 1], '{"a":[1]}')}
    part = wal.fold(log_frame(spark, RECORDS[:2]))
    rest = wal.fold_onto(part, log_frame(spark, RECORDS[2:], 2))
    assert {r.id for r in rest.collect()} == {1, 7}


def test_log_binary(spark, tmp_path):
    data = wal.encode(RECORDS[:3]) + wal.encode(RECORDS[3:])
    assert [(r["type"], r["id"]) for r in wal.decode(data)] == [(r["type"], r["id"]) for r in RECORDS]
    assert wal.verify(wal.with_checksum(data)) == {"ok": True, "records": 7, "checksum": True, "error": None}
    for bad, kind in ((b"VLW", "short"), (b"XXXX\x01\0\0\0", "magic"), (struct.pack("<4sI", b"VLWA", 2), "version"), (data[:-1], "truncated"), (data[:8] + b"\x09" + b"\0" * 13, "type")):
        with pytest.raises(wal.LogError) as e:
            list(wal.decode(bad))
        assert e.value.kind == kind
    broken = bytearray(wal.with_checksum(data))
    broken[30] ^= 1
    assert not wal.verify(bytes(broken))["ok"]
    (tmp_path / "log").mkdir()
    (tmp_path / "log/1.wal").write_bytes(wal.encode(RECORDS[:3]))
    (tmp_path / "log/2.wal").write_bytes(wal.encode(RECORDS[3:]))
    assert {r.id for r in wal.fold(wal.read_binary(spark, str(tmp_path / "log"))).collect()} == {1, 7}


def test_log_stream(spark, tmp_path):
    """Batches one after another, and a restart from the checkpoint."""
    out = wal.VersionedRows(spark, str(tmp_path / "rows"))
    plain = log_frame(spark, RECORDS).withColumn("meta", F.to_json("meta"))
    for lo, hi in ((0, 3), (3, 7)):
        plain.where(f"seq >= {lo} and seq < {hi}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        wal.stream_fold(spark.readStream.schema(plain.schema).parquet(str(tmp_path / "log")), out, str(tmp_path / "cp")).awaitTermination()
    assert out.versions() == [0, 1] and {r.id for r in out.read(0).collect()} == {1, 42} and {r.id for r in out.read().collect()} == {1, 7}
    out.drop_before(1)
    assert out.versions() == [1]


def test_snapshots(spark, tmp_path):
    path = str(tmp_path / "db")
    c = collection(spark, clusters(20), [{"k": i} for i in range(20)])
    first = c.save(path, PlacementMap(4, 1, ("a", "b")), segment_bytes=64)
    back = Collection.open(spark, path)
    key = lambda x: sorted((r.id, r.pos, tuple(r.vector), r.meta.toJson()) for r in x.rows.collect())
    assert key(back) == key(c) and back.metric is Metric.COSINE
    store = snapshot.Store(spark, path)
    assert store.entries(first).select("segment").distinct().count() > 4
    smaller, _ = back.remove(spark.createDataFrame([(1,)], "id long"))
    second = smaller.save(path)
    assert second.commit_ts > first.commit_ts and Collection.open(spark, path).size() == 19
    assert Collection.open(spark, path, read_ts=first.commit_ts).size() == 20 and Collection.open(spark, path, read_ts=0) is None
    store.files.write(f"{path}/HEAD.json", "{not json")
    assert Collection.open(spark, path).size() == 19
    lease = snapshot.Lease(snapshot.fixed_clock(10))
    assert lease.acquire(path, 100) == 1 and lease.acquire(path, 100) is None and not lease.release(path, 9)
    with pytest.raises(RuntimeError):
        snapshot.Store(spark, path, lease=lease).save(c.rows, 4, c.metric, c.strategy)
    assert lease.release(path, 1) and lease.acquire(path, 1) == 2 and lease.renew(path, 2, 50)


def test_heads():
    h = snapshot.Head
    assert snapshot.may_replace(None, h("a")) and not snapshot.may_replace(h("a", 2, 5), h("b", 1, 9)) and not snapshot.may_replace(h("a", 1, 5), h("b", 1, 5)) and snapshot.may_replace(h("a", 1, 5), h("b", 2, 0))
    assert snapshot.commit_ts(5, 9, 7) == 10 and snapshot.offset_clock(snapshot.fixed_clock(5), 3)() == 8
    ticks = iter(range(100))
    snapshot.commit_wait(5, 2, lambda: next(ticks), lambda s: None)
    assert next(ticks) > 7


def test_connect_replays(spark, tmp_path):
    path = str(tmp_path / "db")
    assert connect(spark, path, 2).size() == 0
    with pytest.raises(FileNotFoundError):
        connect(spark, str(tmp_path / "none"), 2, on_missing="fail")
    c = connect(spark, path, log=log_frame(spark, RECORDS))
    assert {r.id for r in c.rows.collect()} == {1, 7} and {r.pos for r in c.rows.collect()} == {0, 1}


def test_codec(spark, tmp_path):
    rows = [(1, [1.0, 2.0], {"a": 1}), (2, [0.5, 0.25], None)]
    data, places = codec.encode_segment(rows)
    assert [(o, n) for o, n, *_ in codec.rows_of_segment(data)] == places and len(list(codec.rows_of_segment(data[:-1]))) == 1
    for bad in (b"VL", b"XXXX\1\0\0\0", struct.pack("<4sI", b"VLDT", 3)):
        with pytest.raises(codec.FormatError):
            list(codec.rows_of_segment(bad))
    (tmp_path / "s").mkdir()
    (tmp_path / "s/db.pg0.part0").write_bytes(data)
    got = codec.read_segments(spark, str(tmp_path / "s")).orderBy("id").collect()
    assert [(r.id, list(r.vector), r.meta.toJson()) for r in got] == [(1, [1, 2], '{"a":1}'), (2, [0.5, 0.25], "null")]


def test_storage(spark):
    r = storage.Resolver({"x": "s3a://bucket/{ns}"})
    assert r.path("x") == "s3a://bucket/x" and storage.Resolver({}, "hdfs://n/{ns}").path("y") == "hdfs://n/y"
    with pytest.raises(KeyError):  # no folder of one machine stands in
        r.path("y")
    with pytest.raises(ValueError):
        storage.Resolver({"x": "ftp://h/{ns}"}).path("x")
    with pytest.raises(ValueError):
        storage.compressed("rar")
    key = F.lit(b"0" * 32)
    df = spark.range(1).select(storage.decrypted(storage.encrypted(F.lit("secret"), key), key).cast("string").alias("x"))
    assert df.first().x == "secret"


def test_rules(spark):
    s = maintenance.StatsView
    rules = maintenance.Rules()
    assert [a.code for a in rules.evaluate(s(12_000, 2, "cosine", "bruteforce"))] == ["bf.large-dataset"]
    assert [a.code for a in rules.evaluate(s(100, 2, "cosine", "hnsw", avg_degree=8, tombstone_ratio=0.4))] == ["hnsw.tombstone-high"]
    found = rules.evaluate(s(23, 2, "cosine", "ivf", list_sizes=(19, 1, 1)))
    assert found[0].code == "ivf.imbalance" and found[0].message == "ivf.list[0] size=19"
    rules.clear()
    rules.register(lambda v: [maintenance.Alert("own", "info", str(v.n))], lambda v: None)
    assert [a.code for a in rules.evaluate(s(1, 2, "dot", "ivf"))] == ["own"]
    d = maintenance.diagnose(s(100, 2, "cosine", "hnsw", avg_degree=1.0, tombstone_ratio=0.0), recall=0.5)
    assert {a.code for a in d["suggestions"]} == {"hnsw.low-avg-degree", "recall.low", "hnsw.small"}
    per = spark.createDataFrame([(1, 0.0), (2, 0.4)], "query_id long, recall double")
    assert len(maintenance.recommendations(per, 10, "hnsw")) == 3


# ---- indexes that are kept


def test_indexes_are_saved_and_opened(spark, tmp_path, monkeypatch):
    metas = [{"k": i} for i in range(60)]
    for strategy, params in (("ivf", IvfParams(6, 6)), ("hnsw", HnswParams(8, 32, 32, 1))):
        path = str(tmp_path / strategy)
        c = collection(spark, clusters(60), metas, strategy=strategy, params=params).with_index()
        c.save(path)
        with monkeypatch.context() as m:
            for module in (ivf, hnsw):
                m.setattr(module, "build", lambda *a, **k: pytest.fail("built anew"))
            back = Collection.open(spark, path)
            q = clusters(60)[7]
            assert [(r.id, r.meta.toJson()) for r in back.find_many(q, 5).collect()] == [(r.id, r.meta.toJson()) for r in c.find_many(q, 5).collect()]
    attrs = spark.createDataFrame([(1, '{"a":1}')], "id long, a string").select("id", F.parse_json("a").alias("attrs"))
    from dataclasses import replace

    replace(collection(spark, clusters(3)), attrs=attrs).save(str(tmp_path / "attrs"))
    assert [r.id for r in Collection.open(spark, str(tmp_path / "attrs")).find_many(clusters(3)[0], 5, {"key": "a", "match": 1}).collect()] == [1]


@pytest.mark.parametrize("strategy", ["bruteforce", "ivf", "hnsw"])
def test_tests_and_metadata_under_every_strategy(spark, strategy):
    params = IvfParams(6, 6) if strategy == "ivf" else None
    c = collection(spark, clusters(60), [{"k": i} for i in range(60)], strategy=strategy, params=params).with_index()
    q = clusters(60)[0]
    exact = [r.id for r in c.with_index("bruteforce").find_many(q, 5, keep=F.col("id") != 1).collect()]
    assert [r.id for r in c.find_many(q, 5, keep=F.col("id") != 1).collect()] == exact and 1 not in exact
    new = spark.createDataFrame([(1, '{"k":"new"}', 0)], "id long, m string, ord long").select("id", F.parse_json("m").alias("meta"), "ord")
    assert {r.id: r.meta.toJson() for r in c.set_meta(new)[0].find_many(q, 5).collect()}[1] == '{"k":"new"}'
    if strategy == "hnsw":
        soft = hnsw.Control(mode="soft", bridge_budget=500)
        assert {r.id % 2 for r in c.find_many(q, 5, {"should": [{"key": "k", "scope": "meta", "match": list(range(0, 60, 2))}]}, control=soft).collect()} == {1}


def test_repair_and_rebuild(spark):
    c = collection(spark, clusters(60), strategy="ivf", params=IvfParams(6, 3)).with_index()
    from dataclasses import replace

    strays = c.index.assigned.where("id < 4").withColumn("id", F.col("id") + 1000)
    broken = replace(c, index=replace(c.index, assigned=c.index.assigned.where("id > 5").unionByName(strays)))
    fixed, lost, gone = broken.repaired()
    assert (lost, gone) == (5, 3) and maintenance.check_consistency(fixed.rows, fixed.index.assigned).count() == 0
    lists = lambda x: sorted((r.id, r.list_id) for r in x.index.assigned.select("id", "list_id").collect())
    assert lists(fixed) == lists(c) and c.repaired()[1:] == (0, 0)
    assert c.rebuilt(params=IvfParams(6, 5)).index.assigned is c.index.assigned and c.rebuilt(params=IvfParams(6, 5)).index.params.nprobe == 5
    assert lists(c.rebuilt(ids=c.rows.where("id < 9").select("id"))) == lists(c)


def test_log_of_writes(spark):
    c = Collection.create(spark, 2).logged().add(rows_of(spark, [[1, 0], [0, 1]], [{"x": 1}, {"x": 2}]))
    c, _ = c.push(rows_of(spark, [[1, 1], [3, 4]], [{"x": 8}, {"x": 3}], ids=[1, 3]))
    c, _ = c.remove(spark.createDataFrame([(2,), (9,)], "id long"))
    c = c.set_vector(rows_of(spark, [[0, 2]], ids=[1]))
    c, _ = c.set_meta(spark.createDataFrame([(3, '{"y":1}', 0)], "id long, m string, ord long").select("id", F.parse_json("m").alias("meta"), "ord"))
    key = lambda x: sorted((r.id, tuple(r.vector), r.meta.toJson()) for r in x.rows.collect())
    again = Collection.create(spark, 2).replayed(c.log)
    assert key(again) == key(c) and [r[0] for r in key(c)] == [1, 3] and c.writes == 5


def test_log_folder_and_auto_save(spark, tmp_path):
    for files, path in ((snapshot.Files(spark), str(tmp_path / "log")), (storage.MemoryFiles(), "log"), (storage.MemoryFiles(), "other")):
        log = wal.LogFolder(files, path)
        names = [log.append(RECORDS[:3]), log.append(RECORDS[3:])]
        assert [r["id"] for r in log.records()] == [r["id"] for r in RECORDS] and names == log.names()
        saves, clock = [], [0]
        auto = wal.AutoSave(lambda: saves.append(1), log, 3, 100, lambda: clock[0])
        assert not auto.wrote(2) and auto.wrote() and len(saves) == 1 and log.names() == []
        clock[0] = 150
        log.append(RECORDS[:1])
        assert auto.wrote() and len(saves) == 2 and log.names() == [] and list(log.records()) == []


def test_index_file():
    entries = [(1, "pg0.part0", 8, 40), (2**32 - 1, "pg1.part0", 8, 44), (3, "pg0.part0", 48, 40)]
    data = codec.encode_index(entries)
    assert codec.decode_index(data) == entries and codec.decode_index(codec.encode_index([])) == []
    for bad in (b"VLIX", b"XXXX" + data[4:], data[:-1], data[:4] + b"\x09" + data[5:], data[:-16] + b"\0\0\0\0\xff\0\0\0" + data[-8:]):
        with pytest.raises(codec.FormatError):
            codec.decode_index(bad)


def test_writers_in_turn(spark, tmp_path):
    """Leases and HEAD lie in the folder: another store sees them."""
    path = str(tmp_path / "db")
    a, b = snapshot.Store(spark, path), snapshot.Store(spark, path)
    assert a.lease.acquire(path, 60_000) == 1 and b.lease.acquire(path, 60_000) is None
    c = collection(spark, clusters(5))
    with pytest.raises(RuntimeError):
        b.save(c.rows, 4, c.metric, c.strategy)
    assert a.lease.release(path, 1)
    one, two = b.save(c.rows, 4, c.metric, c.strategy), a.save(c.rows, 4, c.metric, c.strategy, tries=3)
    assert snapshot.may_replace(one, two) and b.head() == two and len({h.manifest for h in a.versions()}) == 2
    assert a.files.make_new(f"{path}/x", "1") and not b.files.make_new(f"{path}/x", "2") and a.files.read(f"{path}/x") == "1"


def test_segments_are_moved(spark, tmp_path):
    from nearfield.plans.placement import check_placement, move_segments, rebalanced

    files, folders = snapshot.Files(spark), lambda t: str(tmp_path / t)
    manifest = spark.createDataFrame([(f"db.pg{k}.part0", "a") for k in range(6)], "name string, target string")
    for k in range(6):
        files.write(f"{folders('a')}/db.pg{k}.part0", f"data {k}")
    m = PlacementMap(8, 1, ("a", "b"))
    moves = rebalance_plan(manifest, m).persist()
    n = moves.count()
    with pytest.raises(RuntimeError):
        check_placement(manifest, m, "strict")
    told = check_placement(manifest, m, "warn", shown=1)
    assert 0 < n < 6 and not told["ok"] and told["misplaced"] == n and len(told["plan"]) == 1
    assert check_placement(manifest, m, "auto", apply=lambda x: move_segments(files, folders, x))["ok"]
    after = rebalanced(manifest, moves)
    assert check_placement(after, m)["ok"] and check_placement(None, m)["ok"]
    for r in after.collect():
        assert files.read(f"{folders(r.target)}/{r.name}") == f"data {r.name[5]}"
    assert sum(len([x for x in files.names(folders(t)) if not x.endswith(".crc")]) for t in "ab") == 6


def test_keys_and_codings():
    key = storage.derived_key("secret", b"s" * 16)
    assert len(key) == 32 and key == storage.derived_key("secret", b"s" * 16) != storage.derived_key("secret", b"t" * 16)
    with pytest.raises(ValueError):
        storage.derived_key("secret", b"short")
    memory = storage.MemoryFiles()
    zipped = storage.zipped(memory)
    zipped.write("a/b", "x" * 1000)
    assert zipped.read_bytes("a/b") == b"x" * 1000 and len(memory.data["a/b"]) < 100 and zipped.names("a") == ["b"]


def test_typed_filters_reach_the_scan(spark, tmp_path):
    vs = clusters(40)
    spark.createDataFrame([(k, [float(x) for x in v], k % 5) for k, v in enumerate(vs)], "id long, vector array<float>, label int").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    meta = F.parse_json(F.concat(F.lit('{"label":'), F.col("label").cast("string"), F.lit("}")))
    typed, plain = Collection.of(df, 4, meta=meta, typed={"label": "number"}), Collection.of(df, 4, meta=meta)
    for leaf in ({"match": [1, 3, "1"]}, {"match": 2}, {"match": "x"}, {"range": {"gte": 1, "lt": 3}}, {"exists": True}, {"exists": False}, {"is_null": True}):
        expr = {"must": [{"key": "label", "scope": "meta", **leaf}], "must_not": [{"key": "label", "scope": "meta", "match": 3}]}
        found = typed.find_many(vs[0], 50, expr)
        assert [(r.id, r.score) for r in found.collect()] == [(r.id, r.score) for r in plain.find_many(vs[0], 50, expr).collect()]
    found = typed.find_many(vs[0], 5, {"must": [{"key": "label", "scope": "meta", "match": [1, 3]}]})
    plan = found._jdf.queryExecution().explainString(found._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [In(label, [1,3])]" in plan or "In(label" in plan
    assert "Exchange" not in plan
