"""Operators that look at one text at a time, and the models behind them."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.llm import common, html_text, language_id, linear, quality_rules, tokens, toxicity, url_filter
from nearfield.llm.kneser_ney import KneserNey

ODD = [None, "", " \n\t ", "One", "a\x0bb\x0cc\rd", "ÄÖ Ä ö", "x " * 30000, "same same same same", "x0Bf\nx0Bf\n \t\n", "nul\x00l b", "one two\n\none two\n", "<b>#*$%&|<>", "two words", "two words"]


def docs(spark, texts, **columns):
    rows = [(k, t, *(v[k] for v in columns.values())) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, ", ".join(["doc_id long", "text string", *(f"{c} string" for c in columns)]))


def words(text):
    return (text or "").encode().lower().split()


def test_words_and_buffers():
    texts = [*ODD, "long" * 100000]
    data, offsets = common.text_buffers(pa.array(texts))
    seen = {}
    for lo, hi in common.slices(offsets, 1000):
        h, at = tokens.word_hashes(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        for k in range(lo, hi):
            own = h[at[k - lo] : at[k - lo + 1]]
            assert len(own) == len(words(texts[k]))
            for w, x in zip(words(texts[k]), own):
                assert seen.setdefault(w, x) == x
    assert len(set(seen.values())) == len(seen)
    sliced = pa.array(["a", "bc", "d"])[1:]
    data, offsets = common.text_buffers(sliced)
    assert data.tobytes() == b"bcd" and offsets.tolist() == [0, 2, 3]


# ---- rules


def measures(text):
    text = text or ""
    w = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text).split(" ") if x]
    lines = [x for x in text.split("\n") if x.strip(" \t\x0b\x0c\r")]
    tri = collections.Counter(zip(w, w[1:], w[2:]))
    cover = {i + d for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for d in range(3)}
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(cover), "n_upper": sum(c.isupper() for c in text)}


def test_quality_measures(spark):
    texts = [*ODD, "a b c d a b c e a b", "x y z x y z", "l\nl\n l\nl", "wörter " * 60, "1 2 3 4 5 6 7 1 2 3 9 9 9 9"]
    got = quality_rules.ledger(docs(spark, texts)).orderBy("doc_id").collect()
    for t, r in zip(texts, got):
        assert {k: r[k] for k in quality_rules.MEASURES} == measures(t), t and t[:50]
        assert bool(r.fail_bits & 1) == (r.n_words < 50)


def test_quality_policies(spark):
    good = " ".join(f"word{i}" for i in range(60))
    texts = [good, "# " * 60 + good, "ab cd ef " * 40, good.upper(), None]
    book = quality_rules.ledger(docs(spark, texts, fail_bits=["x"] * 5, n_words=["y"] * 5))
    kept = {r.doc_id for r in book.where(quality_rules.passes("full-1")).collect()}
    assert kept == {0} and {r.doc_id for r in book.where(quality_rules.passes("base-1")).collect()} >= {0, 3}
    rows = {r.rule: r for r in quality_rules.ablations(book, "full-1").collect()}
    assert rows["upper_case"].failing_alone == 1 and rows["upper_case"].passing == 1 and set(rows) == {r.name for r in quality_rules.RULES}
    held = docs(spark, texts, fail_bits=["x"] * 5, __nf_words=["y"] * 5)
    out = quality_rules.keep_good(held)
    assert out.columns == held.columns and [r.fail_bits for r in out.collect()] == ["x"]
    assert quality_rules.ledger(docs(spark, texts).limit(0)).count() == 0


# ---- urls


def judged(url, rules):
    host, path = url_filter.split_url(url)
    best = None
    for verdict, rule in rules:
        h, _, p = rule.partition("/")
        if host and (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            if best is None or len(rule) > len(best[1]):
                best = (verdict, rule)
    return (host, path, best and best[1], best[0] if best else "allow")


RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://COM", "http://x.com/", "HTTP://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "https://b.www.example.com/en/", "http://net/es/", "http://ne.net/fr/q", "http://a.net/en/", "http://example.com#/en/", "http://example.com?/en/", "http://xcom/", "http://a..com/", "ftp://u@h.com:80/en/", "http://example.com/EN/", "http://x.com/a/en/"] * 2
    df = docs(spark, urls, host=["h"] * len(urls)).withColumnRenamed("text", "url")
    for error in (0.01, 0.9):  # at 0.9 the cascade has many levels
        got = url_filter.judge(df, RULES, ["doc_id"], error=error).orderBy("doc_id").collect()
        assert [tuple(r)[1:] for r in got] == [judged(u, RULES) for u in urls]
    assert url_filter.judge(df.limit(0), RULES, ["doc_id"]).count() == 0
    assert {r.verdict for r in url_filter.judge(df, [], ["doc_id"], default="block").collect()} == {"block"}


def test_cascade_is_exact(spark):
    keys = [url_filter.key_hash(f"h{k}", "/") for k in range(3000)]
    signed = np.array(keys, np.uint64).view(np.int64).tolist()
    frame = lambda rows: spark.createDataFrame(rows, "h1 long, h2 long")
    c = url_filter.Cascade.build(frame(signed[:400]), frame(signed), error=0.3)
    assert len(c.levels) > 2
    assert c.holds(np.array(keys, np.uint64)).tolist() == [True] * 400 + [False] * 2600
    with pytest.raises(ValueError):
        url_filter.Bloom.sized(1000, 0.01, 100)


# ---- pages

PAGES = [
    (None, ""), ("", ""), ("plain text &amp; more", "plain text & more"),
    ("<p>One<p>two <b>bold</b>er<br>three", "One two bolder three"),
    ("<html><body><nav><a href=x>Menu</a></nav><article><h1>Title</h1><p>Body text of the page, long enough.</p><p>Second &lt;part&gt;</p></article><footer>foot &copy; me</footer></body></html>", "Title Body text of the page, long enough. Second <part>"),
    ("<body><div class='sidebar'><p>Some side text here that goes on and on for a while</p></div><div id=main><p>Real content with many words in it.</p><p>And more of the real content.</p><div class=\"post-comments\"><p>First!</p></div></div><form>Your name <input></form><script>var x='<p>no</p>'</script><!-- <p>not this</p> --></body>", "Real content with many words in it. And more of the real content."),
    ("<article><p>cut off in the midd", "cut off in the midd"), ("<body><article><header>By me</header><p>Text &#65;&#x42; &nbsp; x</p><aside>ad</aside><p>  y \n z</p></article><div role=contentinfo>c</div>", "Text AB x y z"),
    ("<body><ul><li>one<li>two</ul><table><tr><td>a<td>b</table>", "one two a b"),
]


@pytest.mark.parametrize("page,want", PAGES)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "<p>The whole article is here, with many words in it.</p><p>And it goes on for another paragraph.</p>"
TEXT = "The whole article is here, with many words in it. And it goes on for another paragraph."
WRAPPERS = ['style="overflow:hidden"', 'data-hidden="false"', 'aria-label="hidden treasures"', "class='overflow-hidden'", "class=has-sidebar", 'class="no-sidebar"', 'class="post type-post tag-news"',
    'title="x > hidden"', 'aria-hidden="false"', 'data-class="ad"']


@pytest.mark.parametrize("attrs", WRAPPERS)
def test_wrappers_are_not_lost(attrs):
    assert html_text.main_text(f"<body><nav>Menu</nav><div {attrs}>{LONG}</div><div class=sidebar><p>Side</p></div></body>") == TEXT
    assert html_text.main_text(f"<body><div {attrs}><article>{LONG}</article></div><div><p>{'Other words. ' * 40}</p></div></body>").startswith(TEXT)


def test_hints_and_hidden():
    for gone in ("hidden", "HIDDEN=''", 'aria-hidden="true"', "aria-hidden=TRUE", "class=cookie-notice", "id='comments'", "role=complementary", 'class="x" hidden'):
        assert html_text.main_text(f"<body><div>{LONG}</div><div {gone}><p>Not this text</p></div></body>") == TEXT
    # many posts, each less than half of the text
    posts = "".join(f"<div class='post tag-{k}'>{LONG}</div>" for k in range(5))
    assert html_text.main_text(f"<body>{posts}</body>") == " ".join([TEXT] * 5)
    # a whole name, and the article is elsewhere: however long
    assert html_text.main_text(f"<body><article>{LONG}</article><div class=ad><p>{'Buy this. ' * 90}</p></div></body>") == TEXT
    # a part of a name: the text stays though there is an article elsewhere
    assert html_text.main_text(f"<body><div class='post tag-news'>{LONG}</div><article><p>Teaser</p></article></body>").startswith(TEXT)
    # comments are no articles that keep their list
    assert html_text.main_text(f"<body><article>{LONG}</article><div id=comments><article class=comment><p>First!</p></article></div></body>") == TEXT


def test_pages(spark):
    df = docs(spark, [p for p, _ in PAGES] * 2, n_chars=["c"] * 2 * len(PAGES)).withColumnRenamed("text", "html")
    got = html_text.extract(df, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.text for r in got] == [w for _, w in PAGES] * 2 and all(r.n_chars == len(r.text) for r in got)
    deep = "<div>" * 3000 + "<p>deep inside the page</p>"
    assert html_text.main_text(deep) == "deep inside the page"
    assert html_text.extract(df.limit(0), ["doc_id"]).count() == 0


# ---- language


def speak(rng, letters, n):
    return " ".join("".join(rng.choice(list(letters), rng.integers(2, 8))) for _ in range(n))


def test_language(spark):
    rng = np.random.default_rng(5)
    tongues = {"en": "thewandoris", "de": "deruchnßäzg", "fr": "leauxéiçnod", "es": "losñcióaner", "xx": "qqzzjjkkvvw"}
    texts, langs = zip(*[(speak(rng, tongues[k], 60), k) for k in tongues for _ in range(40)])
    model = language_id.LanguageId.fit(docs(spark, texts, lang=langs))
    assert model.members["romance"] == ["es", "fr"] and model.members["xx"] == ["xx"]
    fresh, want = zip(*[(speak(rng, tongues[k], 40), k) for k in tongues for _ in range(20)])
    got = model.predict(docs(spark, [*fresh, *ODD, "12 34 !!"], score=["s"] * (len(fresh) + len(ODD) + 1))).orderBy("doc_id").collect()
    assert np.mean([r.lang_pred == w for r, w in zip(got, want)]) >= 0.98
    assert all(0 <= r.score <= 1 for r in got) and got[-1].lang_pred == "und" and got[len(fresh)].lang_pred == "und"
    again = model.predict(docs(spark, [fresh[0], fresh[0] + " " + fresh[0]])).collect()
    assert {r.lang_pred for r in again} == {want[0]}
    none = language_id.LanguageId.fit(docs(spark, ["a b"], lang=[None]))
    assert [r.lang_pred for r in none.predict(docs(spark, ["abc"])).collect()] == ["und"]
    assert model.predict(docs(spark, texts).limit(0)).count() == 0


def test_svm_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5)).astype(np.float32)
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1.0, -1.0).astype(np.float32)
    w, b = linear.linear_svm(x, y)
    assert np.mean(np.sign(x @ w + b) == y) > 0.97


# ---- toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(2)
    clean = [speak(rng, "abcdefgh", 80) for _ in range(300)]
    bad = ["vile", "nastyx", "crudest"]
    toxic = [speak(rng, "abcdefgh", 80) + f" {rng.choice(bad)}! " + speak(rng, "abcdefgh", 20) + f" {rng.choice(bad)}ish" for _ in range(120)]
    # half of the toxic texts are hidden among the unlabelled
    model = toxicity.Toxicity.fit(docs(spark, toxic[:60]), docs(spark, clean[:200] + toxic[60:90]), 0.15)
    got = model.predict(docs(spark, clean[200:] + toxic[90:]), ["doc_id"]).orderBy("doc_id").collect()
    assert all(r.score < 0.7 for r in got[:100]) and np.mean([r.score >= 0.7 for r in got[100:]]) >= 0.9
    odd = model.predict(docs(spark, [*ODD, "VILE crudest"], score=["x"] * (len(ODD) + 1)), ["doc_id"]).orderBy("doc_id").collect()
    assert all(0 <= r.score <= 1 for r in odd) and odd[0].score == odd[1].score and odd[-1].score >= 0.7
    nothing = toxicity.Toxicity.fit(docs(spark, toxic).limit(0), docs(spark, clean[:5]), 0.1)
    assert {r.score for r in nothing.predict(docs(spark, clean[:3]), ["doc_id"]).collect()} == {0.0}
    assert model.predict(docs(spark, clean).limit(0), ["doc_id"]).count() == 0


def test_nn_pu_risk_stays_above_zero():
    """Without positives' features in the unlabelled part the correction bites."""
    w, b = toxicity.nn_pu([np.array([0])] * 20, [np.array([], int)] * 80 + [np.array([0])] * 20, 1, 0.2)
    assert linear.sigmoid(w[0] + b) > 0.7 > 0.3 > linear.sigmoid(b)


# ---- language model


def brute(train, texts, order):
    """The formulas, n-gram by n-gram."""
    tok = lambda t: [*words(t), b"</s>"]
    count = collections.Counter(w for t in train for w in tok(t))
    n, v = sum(count.values()), len(count)
    padded = lambda t, k: [b"<s>"] * (k - 1) + tok(t)
    grams = {order: collections.Counter(tuple(padded(t, order)[i : i + order]) for t in train for i in range(len(tok(t))))}
    for k in range(order - 1, 0, -1):
        grams[k] = collections.Counter(g[1:] for g in grams[k + 1])

    def discounts(values):
        k = collections.Counter(values)
        if min(k[1], k[2], k[3], k[4]) == 0:
            return [0.5] * 3
        y = k[1] / (k[1] + 2 * k[2])
        return [min(max(d, 0), i + 1) for i, d in enumerate((1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]))]

    d = {k: discounts(g.values()) for k, g in grams.items()}
    total, kinds = collections.Counter(), collections.defaultdict(lambda: [0, 0, 0])
    for k, g in grams.items():
        for x, c in g.items():
            total[k, x[:-1]] += c
            kinds[k, x[:-1]][min(c, 3) - 1] += 1
    of = lambda k, c: d[k][min(c, 3) - 1] if c else 0

    def p(x):
        k = len(x)
        low = p(x[1:]) if k > 1 else 1 / (v + 1)
        if not total[k, x[:-1]]:
            return low
        return (grams[k][x] - of(k, grams[k][x]) + sum(a * b for a, b in zip(d[k], kinds[k, x[:-1]])) * low) / total[k, x[:-1]]

    out = []
    for t in texts:
        w, full = tok(t), padded(t, order)
        out.append((len(w), sum(x in count for x in w), sum(math.log10((count[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), sum(math.log10(p(tuple(full[i : i + order]))) for i in range(len(w)))))
    context = (b"of",) * (order - 2) + (b"the",)
    return out, n, sum(p((*context, w)) for w in count) + p((*context, b"unseen"))


@pytest.mark.parametrize("buckets,order", [(1, 2), (16, 2), (1, 3), (16, 3), (4, 4)])
def test_kneser_ney(spark, tmp_path, buckets, order):
    rng = np.random.default_rng(1)
    vocabulary = ["the", "The", "of", "and", *(f"w{k}" for k in range(60))]
    share = 1 / np.arange(1, len(vocabulary) + 1)
    texts = [" ".join(rng.choice(vocabulary, rng.integers(0, 40), p=share / share.sum())) for _ in range(120)] + ODD
    train = [t for k, t in enumerate(texts) if zlib.crc32(str(k).encode()) % 5 != 1]
    want, n, total = brute(train, texts, order)
    assert abs(total - 1) < 1e-9
    df = docs(spark, texts, score=["x"] * len(texts))
    model = KneserNey.fit(df.where(common.fold(F.col("doc_id"), 5) != 1), model_dir=str(tmp_path), buckets=buckets, order=order)
    got = model.score(df, ["doc_id"]).orderBy("doc_id").collect()
    model.close()
    assert model.shape.tokens == n and (len(model.shape.hot) or buckets == 1) and not any(tmp_path.iterdir())
    for r, w in zip(got, want):
        assert (r.n_tokens, r.n_known) == w[:2] and r.base_score == pytest.approx(w[2], rel=1e-9) and r.score == pytest.approx(w[3], rel=1e-9)


def test_tables_of_the_model(tmp_path):
    """Counts beyond a byte, keys that are not there, one key, none."""
    from nearfield.llm import kneser_ney as kn

    rng = np.random.default_rng(5)
    for n in (0, 1, 17, 5000):
        keys = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64, endpoint=False))
        counts = rng.choice(np.array([1, 2, 254, 255, 256, 2**33], np.uint64), len(keys))
        kn._save_table(f"{tmp_path}/{n}-00000", keys, {"count": counts})
        arrays = kn._Arrays(kn.Shape(str(tmp_path), 0))
        asked = np.r_[keys, keys + np.uint64(1 << 40), rng.integers(0, 2**64, 50, dtype=np.uint64, endpoint=False)]
        got = arrays.find(f"{n}-", np.zeros(len(asked), np.int64), asked, ("count",))[0]
        assert got.tolist() == [*counts.tolist(), *[0] * (len(asked) - len(keys))]


def test_kneser_ney_without_training(spark, tmp_path):
    df = docs(spark, ["a b", None])
    model = KneserNey.fit(df.limit(0), model_dir=str(tmp_path))
    got = model.score(df, ["doc_id"]).orderBy("doc_id").collect()
    assert model.shape.tokens == 0 and [r.n_tokens for r in got] == [3, 1] and all(r.score == 0 for r in got)


def test_copies_are_drawn_each_by_itself(spark, monkeypatch):
    """A third of a language's rows is one text: neither all copies nor none."""
    rng = np.random.default_rng(21)
    texts = ["one and the same text"] * 300 + [speak(rng, "abcdefg", 30) for _ in range(600)] + [speak(rng, "uvwxyz", 30) for _ in range(900)]
    df = docs(spark, texts, lang=["aa"] * 900 + ["bb"] * 900, note=[None] * 1800).withColumn("m", F.create_map(F.lit("k"), "text"))
    seen = []
    duels = language_id._duels
    monkeypatch.setattr(language_id, "_duels", lambda x, y, names: (seen.append((x, y)), duels(x, y, names))[1])
    language_id.LanguageId.fit(df, per_language=90)
    x, y = seen[0]
    drawn = x[y == language_id._FAMILY.get("aa", "aa")]
    copies = max(np.unique(drawn, axis=0, return_counts=True)[1])
    assert 10 <= copies <= 60 and 60 <= len(drawn) <= 130


@pytest.mark.parametrize("rare", [10, 30])
def test_rare_toxic_words(spark, rare):
    """A vocabulary in 0.5 or 1.5 % of the positives is learned."""
    rng = np.random.default_rng(22)
    clean = lambda n: [f"{speak(rng, 'abcdefgh', 12)}" for _ in range(n)]
    positives = [f"{t} vilest scum" for t in clean(2000 - rare)] + [f"{t} zurrik moxtan" for t in clean(rare)]
    model = toxicity.Toxicity.fit(docs(spark, positives), docs(spark, clean(4000)), 0.2)
    got = model.predict(docs(spark, ["abc zurrik moxtan abd", "abc abd bca", "abc vilest scum abd"]), ["doc_id"]).orderBy("doc_id").collect()
    assert got[0].score >= 0.7 > got[1].score and got[2].score >= 0.7


def test_samples_keep_their_bound(spark):
    """A third of the rows is one text, and some rows repeat as a whole."""
    df = spark.createDataFrame([(k % 40_000 if k % 5 else 7, "same text" if k % 3 == 0 else f"text {k}", "aa" if k % 2 else "bb") for k in range(60_000)], "doc_id long, text string, lang string")
    draw = F.xxhash64("doc_id", "text")
    for most in (10, 500):
        assert most / 2 <= common.sample(df, most, draw).count() <= most
        got = common.sample(df, most, draw, "lang")
        assert got.columns == df.columns and all(most / 2 <= r["count"] <= most for r in got.groupBy("lang").count().collect())
        assert got.where("doc_id = 7 and text = 'same text'").count() <= 2
    nulls = df.select(F.lit(None).cast("long").alias("doc_id"), F.lit("x").alias("text"), "lang")
    assert common.sample(nulls, 100, draw).count() <= 1 and common.sample(df.limit(0), 5, draw, "lang").count() == 0 and common.sample(df.limit(0), 5, draw).count() == 0


def test_prior_may_be_high(spark):
    """More toxic texts than others: the share is used as it is."""
    rng = np.random.default_rng(23)
    toxic = [speak(rng, "abcdefgh", 20) + " vile scum" for _ in range(300)]
    clean = [speak(rng, "abcdefgh", 20) for _ in range(100)]
    model = toxicity.Toxicity.fit(docs(spark, toxic[:150]), docs(spark, clean + toxic[150:]), 0.6)
    got = model.predict(docs(spark, [clean[0], toxic[0]]), ["doc_id"]).orderBy("doc_id").collect()
    assert got[0].score < 0.7 <= got[1].score
    with pytest.raises(ValueError):
        toxicity.Toxicity.fit(docs(spark, toxic), docs(spark, clean), 0.0)


def test_deep_and_wide_pages_take_linear_time():
    import time

    took = []
    for n in (4000, 16000):
        began = time.process_time()
        assert html_text.main_text("<div>" * n + "<p>deep inside the page</p>" + "</i>" * n) == "deep inside the page"
        wide = html_text.main_text("<body>" + "".join(f"<div><p>Part {k} of a page with many parts.</p></div></b>" for k in range(n // 4)) + "</body>")
        assert wide.startswith("Part 0 of") and wide.endswith(f"Part {n // 4 - 1} of a page with many parts.")
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.5  # sixteen times as long, were it quadratic


def plain_density(page):
    """Composite text density, written down node by node without sharing."""
    _, nodes = html_text.parse(page)
    kids = collections.defaultdict(list)
    for n in nodes[1:]:
        kids[n.up].append(n)
    below = lambda n: [n] + [y for x in kids[n] for y in below(x)]
    length = lambda n: sum(len(" ".join(x.split())) for m in below(n) for x in m.parts if isinstance(x, str))
    body = next(n for n in nodes if n.tag == "body")
    links = lambda n: [x for x in below(n) if x.tag == "a"]
    share = sum(map(length, links(body))) / max(1, length(body))
    out = {}
    for n in nodes:
        c, t, lc, lt = length(n), len(below(n)) - 1, sum(map(length, links(n))), len(links(n))
        if c:
            t, lc, lt = max(1, t), max(1, lc), max(1, lt)
            plain = max(1, c - sum(map(length, links(n))))
            base = max(1.1, math.log(c / plain * lc + share * c + math.e))
            out[n.at] = c / t * max(0.0, math.log(c / lc * t / lt + 1e-9, base))
    return out, {n.at: sum(out.get(x.at, 0.0) for x in kids[n]) for n in nodes}


def test_densities_by_brute_force():
    rng = np.random.default_rng(12)

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            text = " ".join(["word"] * int(rng.integers(1, 30)))
            return f"<a href=x>{text}</a>" if rng.random() < 0.3 else f"<p>{text}</p>"
        return "<div>" + "".join(part(depth - 1) for _ in range(rng.integers(1, 4))) + "</div>"

    for _ in range(30):
        page = f"<html><body>{part(4)}{part(3)}</body></html>"
        density, sums = plain_density(page)
        _, nodes = html_text.parse(page)
        html_text._measure(nodes)
        assert {n.at: pytest.approx(n.density) for n in nodes if n.chars} == density
        assert {n.at: pytest.approx(n.sum) for n in nodes} == sums
        body = next(n for n in nodes if n.tag == "body")
        # the best sum is in what is taken
        best = max((n for n in nodes if html_text._inside(n, body)), key=lambda n: sums[n.at])
        assert any(html_text._inside(best, f) for f in html_text.content(nodes, body))
