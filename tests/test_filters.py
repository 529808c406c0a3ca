"""The compiled filter language against a plain evaluator of its rules."""

import json
import random

from pyspark.sql import functions as F

from nearfield.functions.filters import Scope, Typed, compile_filter

MISSING = object()
ROWS = [
    (1, {"color": "red", "price": 10, "tags": ["a", "b"], "user": {"name": "x", "age": 9}, "n": None}),
    (2, {"color": "blue", "price": 20.5, "tags": ["b"], "ok": True}),
    (3, {"color": "red", "price": "15", "tags": [], "user": {"name": None}}),
    (4, {"price": 0, "ok": False, "n": 1, "tags": ["c", 1, None]}),
    (5, {}),
    (6, None),
    (7, {"color": 1, "price": True, "user": "flat", "a b": {"c'd": 2, "e'f\"g": 3}}),
]


def value(attrs, key):
    if not key or attrs is None:
        return MISSING
    for part in key.split("."):
        if not isinstance(attrs, dict) or part not in attrs:
            return MISSING
        attrs = attrs[part]
    return attrs


def same(a, b):
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if isinstance(a, int | float) and isinstance(b, int | float):
        return a == b
    return type(a) is type(b) and a == b


def holds(expr, id_, attrs):
    if "has_id" in expr:
        rest = {k: v for k, v in expr.items() if k != "has_id"}
        return id_ in {v & 0xFFFFFFFF for v in expr["has_id"]["values"]} and (not rest or holds(rest, id_, attrs))
    v = value(attrs, expr.get("key"))
    if "match" in expr:
        wanted = expr["match"] if isinstance(expr["match"], list) else [expr["match"]]
        if isinstance(v, list):
            return any(same(x, w) for x in v for w in wanted)
        return v is not MISSING and any(same(v, w) for w in wanted)
    if "exists" in expr:
        return (v is not MISSING and v is not None) == expr["exists"]
    if "is_null" in expr:
        return (v is None) == expr["is_null"]
    if "range" in expr:
        if isinstance(v, bool) or not isinstance(v, int | float):
            return False
        r = expr["range"]
        return all(k not in r or t(v, r[k]) for k, t in (("gt", lambda a, b: a > b), ("gte", lambda a, b: a >= b), ("lt", lambda a, b: a < b), ("lte", lambda a, b: a <= b)))
    should = expr.get("should") or []
    least = max(0, expr.get("should_min", 1))
    return all(holds(e, id_, attrs) for e in expr.get("must") or []) and not any(holds(e, id_, attrs) for e in expr.get("must_not") or []) and (not should or sum(holds(e, id_, attrs) for e in should) >= least)


def frame(spark):
    df = spark.createDataFrame([(i, None if a is None else json.dumps(a)) for i, a in ROWS], "id long, j string")
    return df.select("id", F.parse_json("j").alias("attrs"))


def check(spark, exprs):
    df, scope = frame(spark), Scope(attrs=F.col("attrs"))
    got = df.select("id", *(compile_filter(e, scope).alias(f"e{k}") for k, e in enumerate(exprs))).collect()
    for row in got:
        for k, e in enumerate(exprs):
            want = holds(e, row.id, dict(ROWS)[row.id])
            assert row[f"e{k}"] is want, (e, row.id, row[f"e{k}"])


def test_leaves(spark):
    check(
        spark,
        [
            {"key": "color", "match": "red"}, {"key": "color", "match": ["red", 1]}, {"key": "color", "match": "1"}, {"key": "color", "match": []},
            {"key": "price", "match": 10}, {"key": "price", "match": 10.0}, {"key": "price", "match": True}, {"key": "n", "match": None}, {"key": "tags", "match": ["b", 1]}, {"key": "tags", "match": None},
            {"key": "price", "range": {"gte": 10, "gt": 5, "lt": 20}}, {"key": "price", "range": {}}, {"key": "price", "range": {"lte": 20.5}},
            {"key": "n", "exists": True}, {"key": "n", "exists": False}, {"key": "n", "is_null": True}, {"key": "n", "is_null": False}, {"key": "user.name", "exists": True},
            {"key": "user.name", "is_null": True}, {"key": "user.age", "range": {"lt": 10}}, {"key": "a b.c'd", "match": 2}, {"key": "a b.e'f\"g", "match": 3}, {"match": "red"}, {"exists": False}, {"key": "color"}, {},
            {"key": "color", "match": "red", "exists": False}, {"key": "color", "match": "red", "must": [{"key": "n", "exists": True}]},
        ],
    )


def test_bool(spark):
    red, cheap, tagged = {"key": "color", "match": "red"}, {"key": "price", "range": {"lt": 12}}, {"key": "tags", "match": "b"}
    check(
        spark,
        [
            {"must": [red, cheap]}, {"must_not": [red]}, {"must_not": [{"key": "n", "match": 1}]}, {"should": [red, cheap]}, {"should": [red, cheap], "should_min": 2}, {"should": [red], "should_min": 0},
            {"should": []}, {"has_id": {"values": [1, 5, 4294967298]}}, {"has_id": {"values": []}}, {"has_id": {"values": [1, 2]}, "must": [tagged], "must_not": [cheap]}, {"must": [{"should": [red, {"must_not": [tagged]}]}]},
        ],
    )


def test_random(spark):
    rng = random.Random(3)

    def leaf():
        key = rng.choice(["color", "price", "tags", "user.name", "user.age", "n", "ok", "zz"])
        kind = rng.choice(["match", "exists", "is_null", "range"])
        if kind == "match":
            return {"key": key, "match": rng.sample(["red", "blue", 1, 10, True, False, "b", None, "15"], rng.randint(0, 3))}
        if kind == "range":
            return {"key": key, "range": {k: rng.randint(0, 25) for k in rng.sample(["gt", "gte", "lt", "lte"], rng.randint(0, 3))}}
        return {"key": key, kind: rng.random() < 0.5}

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return leaf()
        out = {k: [tree(depth - 1) for _ in range(rng.randint(1, 2))] for k in rng.sample(["must", "must_not", "should"], rng.randint(1, 3))}
        if rng.random() < 0.3:
            out["should_min"] = rng.randint(0, 2)
        return {"has_id": {"values": rng.sample(range(9), 4)}, **out} if rng.random() < 0.15 else out

    check(spark, [tree(3) for _ in range(40)])


def test_typed_columns_reach_the_scan(spark, tmp_path):
    spark.range(100).selectExpr("id", "cast(id % 7 as string) AS lang", "id * 10 AS n").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    scope = Scope(typed={("attrs", "lang"): Typed(F.col("lang"), "string"), ("attrs", "n"): Typed(F.col("n"), "number")})
    found = df.where(compile_filter({"must": [{"key": "lang", "match": "3"}, {"key": "n", "range": {"lt": 400}}]}, scope))
    assert [r.id for r in found.orderBy("id").collect()] == [3, 10, 17, 24, 31, 38]
    assert df.where(compile_filter({"key": "n", "match": "30"}, scope)).count() == 0
