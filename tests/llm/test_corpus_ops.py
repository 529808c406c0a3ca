"""Operators over whole tables, against brute force."""

import collections
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import maxscore, mixing, near_dup, packing
from nearfield.llm.queries import tokenizer_path


def docs(spark, texts, ids=None, **columns):
    ids = ids or list(range(len(texts)))
    rows = [(i, t, *(v[k] for v in columns.values())) for k, (i, t) in enumerate(zip(ids, texts))]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in columns)]))


# ---- near-duplicates


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def linked(texts, k, percent=80):
    sets = [shingles(t, k) for t in texts]
    up = list(range(len(texts)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        both = len(sets[i] & sets[j])
        if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            a, b = top(i), top(j)
            up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(texts))], [len(s) for s in sets]


def family(rng, n, words, edits):
    """Copies of a text with a few words changed in each."""
    base = [f"w{x}" for x in rng.integers(0, 5000, words)]
    out = []
    for _ in range(n):
        t = list(base)
        for at in rng.integers(0, words, edits):
            t[at] = f"e{rng.integers(0, 10**6)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, monkeypatch, k):
    monkeypatch.setattr(near_dup, "TILE", 16)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"r{x}" for x in rng.integers(0, 3000, rng.integers(5, 200))) for _ in range(60)]
    # families well above, around and below the threshold
    for edits in (1, 3, 6, 9, 12, 15):
        texts += family(rng, 25, 150, edits)
    texts += [None, "", "  ", "word", "WORD", "two words", "two words", texts[0].upper(), texts[1] + "\n", "a b c " * 5000]
    want, sizes = linked(texts, k)
    got = near_dup.near_duplicates(docs(spark, texts, kept=["x"] * len(texts)), params=near_dup.Params(shingle=k)).orderBy("doc_id").collect()
    assert [r.n_shingles for r in got] == sizes
    assert [r.component_id for r in got] == want
    assert [r.kept for r in got] == [r.doc_id == r.component_id for r in got]


def test_large_family_in_parts(spark, monkeypatch):
    """Many tiles, two halves that only a few bridge, and texts that look
    alike to sketches but aren't linked."""
    monkeypatch.setattr(near_dup, "TILE", 8)
    rng = np.random.default_rng(31)
    base = [f"w{x}" for x in range(120)]
    texts = []
    for k in range(90):  # sliding changes: neighbours are linked, far ones not
        t = list(base)
        t[:k] = [f"x{j}" for j in range(k)]
        texts.append(" ".join(t))
    texts += family(rng, 60, 150, 4) + family(rng, 40, 100, 12)
    order = rng.permutation(len(texts))
    texts = [texts[k] for k in order]
    want, _ = linked(texts, 2)
    got = near_dup.near_duplicates(docs(spark, texts), params=near_dup.Params(shingle=2)).orderBy("doc_id").collect()
    assert [r.component_id for r in got] == want


def test_chain_of_links(spark):
    """Neighbours are linked, ends are not: one component all the same."""
    base = [f"w{k}" for k in range(400)]
    texts = [" ".join(base[8 * k : 8 * k + 200]) for k in range(20)]
    want, _ = linked(texts, 2)
    assert set(want) == {0}
    got = near_dup.near_duplicates(docs(spark, texts), params=near_dup.Params(shingle=2)).collect()
    assert {r.component_id for r in got} == {0}


def test_repeated_rows_and_missing_ids(spark):
    df = docs(spark, ["a b c d e f g"] * 4 + ["other text with more words", None], [7, 7, None, 3, 9, None])
    got = sorted((r.doc_id, r.component_id, r.kept) for r in near_dup.near_duplicates(df).where("doc_id is not null").collect())
    assert got == [(3, 3, True), (7, 3, False), (7, 3, False), (9, 9, True)]
    kept = near_dup.without_near_duplicates(df)
    assert kept.columns == df.columns and sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect()) == [(False, 3), (False, 9), (True, 0), (True, 0)]
    assert near_dup.near_duplicates(df.limit(0)).count() == 0


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(max(a, b), min(a, b)) for a, b in rng.integers(0, 300, (220, 2)).tolist() if a != b] + [(k + 1, k) for k in range(1000, 1100)]
    edges += [(k, 2000) for k in range(2001, 2600)] + [(3000, k) for k in range(2600, 3000)]  # hubs
    got = {r.doc_id: r.comp for r in near_dup.components(spark.createDataFrame(edges, "hi long, lo long")).collect()}
    up = {x: x for e in edges for x in e}
    for _ in range(400):
        for a, b in edges:
            up[a] = up[b] = min(up[a], up[b])
    assert {k: v for k, v in up.items() if k != v} == got


# ---- top-k


def test_max_score(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 12))
    x[:40] = x[0]  # ties
    x[50:60] = 0
    vectors = [list(map(float, v)) for v in x] + [None, [1.0, None], [float("nan")] * 12, [float("inf")] + [0.0] * 11, [0.5] * 5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vectors)] + [(7, vectors[7]), (None, vectors[1])], "id long, e array<double>").select("id", maxscore.quantised(F.col("e"), 256).alias("v"))
    rows = [(i, np.floor(256 * np.array(v))) for i, v in enumerate(vectors) if i < 300] + [(304, np.r_[np.floor(256 * np.array([0.5] * 5)), np.zeros(7)]), (7, np.floor(256 * x[7]))]
    want = {}
    for q, v in rows:
        if q % 3 == 0:
            want[q] = sorted(((-int(v @ w), i) for i, w in rows if i != q))[:5]
    for shard, block in ((4096, 1024), (17, 11)):
        got = collections.defaultdict(list)
        for r in maxscore.top_k(df, df.where("id % 3 = 0"), 5, shard, block).orderBy("query_id", "rank").collect():
            got[r.query_id].append((-r.score, r.id))
        assert dict(got) == want
    assert maxscore.top_k(df.limit(0), df, 5).count() == 0 and maxscore.top_k(df, df.limit(0), 5).count() == 0
    assert maxscore.top_k(df.where("id < 3"), df.where("id < 3"), 5).count() == 6
    empty = spark.createDataFrame([(i, []) for i in range(3)], "id long, e array<double>").select("id", maxscore.quantised(F.col("e"), 256).alias("v"), F.lit("x").alias("least"), F.lit("y").alias("shard"))
    assert sorted(tuple(r) for r in maxscore.top_k(empty, empty, 5).collect()) == [(0, 1, 1, 0), (0, 2, 2, 0), (1, 1, 0, 0), (1, 2, 2, 0), (2, 1, 0, 0), (2, 2, 1, 0)]


# ---- mixing


CELLS = "source string, language string, topic string, tokens long"


def brute_mix(cells, keep, targets, rounds=3000):
    """Factors by bisection, one value after the other, for very many rounds."""
    tokens = np.array([c[3] for c in cells], float)
    budget, ratio, wants = keep * tokens.sum(), np.ones(len(cells)), []
    for k, d in enumerate(mixing.DIMENSIONS):
        names = sorted({c[k] for c in cells})
        rows = {n: np.array([c[k] == n for c in cells]) for n in names}
        given = targets.get(d, {})
        mass = {n: tokens[rows[n]].sum() ** 0.5 for n in names if n not in given}
        share = {n: given[n] if n in given else (1 - sum(given.values())) * mass[n] / sum(mass.values()) for n in names}
        want, full = {}, set()
        while len(full) < len(names):
            left = budget - sum(tokens[rows[n]].sum() for n in full)
            want = {n: tokens[rows[n]].sum() if n in full else left * share[n] / sum(share[m] for m in names if m not in full) for n in names}
            more = {n for n in names if n not in full and want[n] > tokens[rows[n]].sum()}
            if not more:
                break
            full |= more
        wants.append((rows, want))
    for _ in range(rounds):
        was = ratio.copy()
        for rows, want in wants:
            for n, at in rows.items():
                lo, hi = 1e-9, 1e9
                for _ in range(90):
                    mid = (lo * hi) ** 0.5
                    lo, hi = (mid, hi) if (tokens[at] * np.minimum(1, mid * ratio[at])).sum() < want[n] else (lo, mid)
                ratio[at] *= hi
        if np.allclose(np.minimum(1, ratio), np.minimum(1, was), atol=1e-10):
            break
    return np.minimum(1, ratio)


def test_raking_meets_marginals(spark):
    rng = np.random.default_rng(6)
    cells = [(s, lang, t, int(rng.integers(1, 1000))) for s in "abcd" for lang in ("x", "y") for t in "pqr"]
    df = spark.createDataFrame(cells, CELLS)
    targets = {"source": {"a": 0.5, "b": 0.1}, "language": {"x": 0.3, "y": 0.7}}
    for keep in (0.05, 0.4):
        fit = mixing.raked(df, keep, targets)
        got = {tuple(r)[:3]: r.probability for r in fit.cells.collect()}
        assert fit.converged and sum(c[3] * got[c[:3]] for c in cells) == pytest.approx(keep * sum(c[3] for c in cells), rel=1e-4)
        assert np.allclose([got[c[:3]] for c in cells], brute_mix(cells, keep, targets), atol=1e-3)
        marginals = {(r.dimension, r.value): r for r in fit.marginals.collect()}
        assert all(abs(r.attainable - r.expected) < 2e-5 for r in marginals.values()) and marginals["source", "a"].target == 0.5
        mass = {t: sum(c[3] for c in cells if c[2] == t) ** 0.5 for t in "pqr"}
        assert all(marginals["topic", t].target == pytest.approx(mass[t] / sum(mass.values())) for t in "pqr")
        # the way that many cells take gives the same
        assert {tuple(r)[:3]: pytest.approx(r.probability, rel=1e-9) for r in mixing.raked(df, keep, targets, task_cells=0).cells.collect()} == got


def test_sampling(spark):
    texts = ["some words in a row"] * 2000 + [None, "", "a | b | c"]
    df = docs(spark, texts, source=["s1"] * 1500 + ["s2"] * 503, lang=[None] * 2003, probability=["p"] * 2003)
    cols = (F.col("source"), F.col("lang"), mixing.topic_of(F.coalesce("text", F.lit(""))), mixing.n_words(F.col("text")))
    one = mixing.sampled(df, "doc_id", *cols, keep=0.4)
    assert one.columns == df.columns
    ids = {r.doc_id for r in one.collect()}
    assert 600 < len(ids) < 1000 and ids == {r.doc_id for r in mixing.sampled(df, "doc_id", *cols, keep=0.4).collect()} and ids <= {r.doc_id for r in mixing.sampled(df, "doc_id", *cols, keep=0.6).collect()}
    counts = {r.source: r["count"] for r in one.groupBy("source").count().collect()}
    want = 1500**0.5 / (1500**0.5 + 500**0.5)
    assert counts["s1"] / len(ids) == pytest.approx(want, abs=0.05)
    assert mixing.sampled(df.limit(0), "doc_id", *cols).count() == 0


def test_drawn_mix_meets_marginals(spark):
    """Of the final probabilities, where rare cells are taken whole."""
    rows = [(s, lang, "p", n) for s, lang, n in [("a", "x", 9000), ("a", "y", 900), ("b", "x", 600), ("b", "y", 40), ("c", "x", 300), ("c", "y", 500)]]
    df = spark.createDataFrame(rows, CELLS)
    targets = {"source": {"a": 0.8, "b": 0.1, "c": 0.1}, "language": {"x": 0.78, "y": 0.22}}
    fit = mixing.raked(df, 0.5, targets)
    got = fit.cells.toPandas().assign(drawn=lambda t: t.tokens * t.probability)
    assert fit.converged and got.probability.max() == 1 and got.drawn.sum() == pytest.approx(0.5 * got.tokens.sum(), rel=1e-4)
    for d, shares in targets.items():
        for value, share in shares.items():
            assert got[got[d] == value].drawn.sum() / got.drawn.sum() == pytest.approx(share, abs=1e-4)
    one = docs(spark, [" ".join(["w"] * n) for *_, n in rows], source=[r[0] for r in rows], lang=[r[1] for r in rows])
    cols = (F.col("source"), F.col("lang"), F.lit("p"), mixing.n_words(F.col("text")))
    put = {(r.source, r.language): r.probability for r in mixing.with_probability(one, *cols, 0.5, targets).collect()}
    assert put == {(r.source, r.language): r.probability for r in got.itertuples()}


def test_targets_beyond_the_tokens(spark):
    cells = lambda *rows: spark.createDataFrame(rows, CELLS)
    # b and c have less than asked for: whole, the budget is kept, d and a share the rest as 2 to 1
    fit = mixing.raked(cells(("a", "x", "p", 500), ("b", "x", "p", 20), ("c", "x", "p", 80), ("d", "x", "p", 400)), 0.5, {"source": {"a": 0.2, "b": 0.2, "c": 0.2, "d": 0.4}})
    assert fit.converged and [(r.value, round(r.target, 4), round(r.attainable, 4), round(r.expected, 4)) for r in fit.marginals.where("dimension = 'source'").orderBy("value").collect()] == [("a", 0.2, 0.2667, 0.2667), ("b", 0.2, 0.04, 0.04), ("c", 0.2, 0.16, 0.16), ("d", 0.4, 0.5333, 0.5333)]
    # a is only in x: both cannot hold; the budget does, and it is told
    odd = (("a", "x", "p", 600), ("b", "y", "p", 600))
    fit = mixing.raked(cells(*odd), 0.5, {"source": {"a": 0.8, "b": 0.2}, "language": {"x": 0.2, "y": 0.8}})
    p = [r.probability for r in fit.cells.collect()]
    assert not fit.converged and sum(p) * 600 == pytest.approx(600, rel=1e-3) and max(p) <= 1
    rng = np.random.default_rng(8)  # few cells, far apart: never NaN
    for _ in range(3):
        some = [(s, lang, t, int(10 ** rng.uniform(0, 6))) for s in "abcdef" for lang in "xyz" for t in "pqr" if rng.random() < 0.3]
        got = mixing.raked(cells(*some), 0.5).cells.collect()
        assert all(0 <= r.probability <= 1 for r in got) and len(got) == len(some)
        assert sum(r.tokens * r.probability for r in got) == pytest.approx(0.5 * sum(r.tokens for r in got), rel=0.05)
    none = mixing.raked(cells(*odd).limit(0), 0.5)
    assert none.converged and none.cells.count() == 0 and none.marginals.count() == 0


@pytest.mark.parametrize("text", ["a | b", "a|b", "LICENSE", "Warranty of", "copyrIght", "x@y", "in 1999", "199 9", "", "l\u0130cense", "l\u0131cense"])
def test_topics_are_what_their_patterns_say(spark, text):
    import re

    want = next((n for n, p in mixing.TOPICS if re.search(p, text, re.A)), "prose")
    assert docs(spark, [text]).select(mixing.topic_of(F.col("text"))).first()[0] == want


# ---- packing


def test_tokens_equal_the_library():
    """The library as it comes, special tokens' strings included."""
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    texts = ["", " ", "Hello, wörld's  best\n\n\tday 123 ½ 你好 🎉", "a" * 5000, "x  \n y" * 50, "<|endoftext|> it's", "don'T can't x y", "a <|endoftext|> b", "<|endoftext|>" * 3, "<|endof text|> <|other|>", "x<|endoftext|>\n"]
    for text in texts:
        assert packing.token_ids(tokenizer_path(), text).tolist() == [*t.encode(text, add_special_tokens=False).ids, 0]
    assert packing.token_ids(tokenizer_path(), "a <|endoftext|> b").tolist() == [64, 220, 50256, 275, 0]


def test_cuts():
    assert packing.cuts(1, 8) == [(0, 1)] and packing.cuts(8, 8) == [(0, 8)] and packing.cuts(17, 8) == [(0, 1), (1, 8), (9, 8)] and packing.cuts(16, 8) == [(0, 8), (8, 8)]


def fullest_of(left, room):
    """The largest sum of some of the lengths that ``room`` holds, by trying
    all of them."""
    sums = {0}
    for x in left.elements():
        sums |= {s + x for s in sums if s + x <= room}
    return max(sums)


def test_plan_fills_every_bin_as_far_as_can_be():
    """Bin by bin: each takes the longest that is left, and nothing left could
    fill it further."""
    rng = np.random.default_rng(8)
    for _ in range(40):
        counts = {int(k): int(rng.integers(1, 6)) for k in rng.integers(1, 33, 8)}
        steps = packing.plan(counts, 32)
        bins = collections.defaultdict(list)
        for x, first, last, start, many, offset in steps:
            for n in range(last - first):
                bins[start + n // many].append((offset + n % many * x, x))
        left = collections.Counter(counts)
        assert sorted(bins) == list(range(len(bins)))
        for k in sorted(bins):
            places, lengths = zip(*sorted(bins[k]))
            assert places == tuple(np.cumsum([0, *lengths[:-1]])) and max(lengths) == max(+left)
            longest = max(+left)
            left[longest] -= 1
            assert sum(lengths) == longest + fullest_of(+left, 32 - longest)
            left[longest] += 1
            left.subtract(lengths)
            assert min(left.values()) >= 0
        assert not +left


def test_packed(spark):
    rng = np.random.default_rng(9)
    texts = [" ".join(["word"] * int(n)) for n in rng.integers(0, 90, 300)] + [None, "", "long text " * 200] + ["same text here"] * 200
    df = docs(spark, texts, [*range(len(texts) - 1), 0], length=["x"] * len(texts))
    parts = packing.pieces(df, "doc_id", "text", tokenizer_path(), 64, with_ids=True)
    got = packing.packed(parts, 64, salts=5).toPandas()
    assert len(got) == parts.count()
    for _, rows in got.groupby("sequence_id"):
        rows = rows.sort_values("offset")
        assert rows.offset.tolist() == [0, *np.cumsum(rows.length)[:-1]] and rows.length.sum() <= 64
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 64) + 1
    long = got[got.doc_id == 302].sort_values("piece")
    assert long.length.iloc[1:].eq(64).all() and long.start.tolist() == [0, *np.cumsum(long.length)[:-1]]
    ids = np.concatenate([np.frombuffer(x, "<u4") for x in long.ids])
    assert ids.tolist() == packing.token_ids(tokenizer_path(), "long text " * 200).tolist()
    assert packing.packed(packing.pieces(df.limit(0), "doc_id", "text", tokenizer_path(), 64), 64).count() == 0
