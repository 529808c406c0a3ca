"""Every stage, and the whole run, against brute force on a small table."""

import collections
import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from nearfield.llm import mixing
from nearfield.llm.queries import MIX_KEEP, MIX_SEED, tokenizer_path

from test_corpus_ops import brute_mix, linked
from test_text_ops import measures, speak

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
TONGUES = {"en": "thewandoris", "de": "deruchnßäzg", "fr": "leauxéiçnod"}


def small_corpus():
    rng = np.random.default_rng(41)
    rows = []
    for k in range(150):
        lang = list(TONGUES)[k % 3]
        rows.append((speak(rng, TONGUES[lang], int(rng.integers(60, 400))), lang, "web" if k % 3 else "news"))
    for k in range(20):  # copies, exact and near
        words = rows[k][0].split(" ")
        words[int(rng.integers(0, len(words)))] = "changed"
        rows += [(rows[k][0], rows[k][1], "web")] * (k % 3) + [(" ".join(words), rows[k][1], "news")]
    rows += [(speak(rng, TONGUES["de"], 200), "fr", "web") for _ in range(3)]  # listed under another language
    rows += [(None, "en", "web"), ("", None, None), ("too short", "en", "web"), ("12 34 " * 40, "en", "web"), ("same words again " * 60, "en", "web"), (speak(rng, TONGUES["en"], 90), None, None), ("in 1999 a | b x@y " + speak(rng, TONGUES["en"], 1200), "en", "web")]
    return [(k, t, lang, source, len(t or "")) for k, (t, lang, source) in enumerate(rows)]


def good(text):
    m = measures(text)
    n, w = m["n_words"], m["word_chars"]
    return not (n < 50 or 100 * m["n_repeat_words"] > 50 * n or 10 * m["n_symbols"] > n or 2 * m["n_dup_lines"] > m["n_lines"] or 2 * m["n_upper"] > w or w < 2 * n or w > 15 * n)


def one_of_each(rows):
    root, _ = linked([r[1] for r in rows], 5)
    return [r for k, r in enumerate(rows) if root[k] == k]


def topic(text):
    import re

    return next((n for n, p in mixing.TOPICS if re.search(p, text or "", re.A)), "prose")


def drawn(rows):
    of = lambda r: (r[3] or "(none)", r[2] or "(none)", topic(r[1]))
    tokens = collections.Counter()
    for r in rows:
        tokens[of(r)] += measures(r[1])["n_words"]
    cells = [(*k, n) for k, n in sorted(tokens.items()) if n]
    p = dict(zip([c[:3] for c in cells], brute_mix(cells, MIX_KEEP, {})))
    place = lambda r: int(hashlib.md5(f"{r[0]}:{MIX_SEED}".encode()).hexdigest()[:13], 16) / 2**52
    return [r for r in rows if place(r) < p.get(of(r), 1.0)], [r for r in rows if abs(place(r) - p.get(of(r), 1.0)) < 0.02]


def check_packed(got, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    ids = {r[0]: [*t.encode(r[1] or "", add_special_tokens=False).ids, 0] for r in rows}
    assert {g.doc_id for g in got} == set(ids)
    bins = collections.defaultdict(list)
    for doc, parts in collections.Counter(g.doc_id for g in got).items():
        mine = sorted((g for g in got if g.doc_id == doc), key=lambda g: g.piece)
        assert [g.piece for g in mine] == list(range(parts)) and sum(g.length for g in mine) == len(ids[doc])
        assert parts == -(-len(ids[doc]) // 2048) and all(g.length == 2048 for g in mine[1:])
        for g in mine:
            assert g.ids_crc32 == zlib.crc32(np.array(ids[doc][g.start : g.start + g.length], "<u4").tobytes())
            bins[g.sequence_id].append((g.offset, g.length))
    for places in bins.values():
        places.sort()
        assert [o for o, _ in places] == np.cumsum([0, *(n for _, n in places[:-1])]).tolist() and sum(n for _, n in places) <= 2048
    assert len(bins) <= -(-sum(map(len, ids.values())) // 2048) + 1


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(small_corpus(), COLUMNS).write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_stages_one_after_another(spark, folder):
    """Each stage on what the one before it really kept; the run gives the
    last one's rows."""
    rows, frame = small_corpus(), lambda rows: spark.createDataFrame(rows, COLUMNS)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["quality rules", "language id", "near duplicates", "mixing", "packing"]
    kept = lambda name, rows: sorted((tuple(r) for r in stages[name](spark, frame(rows), folder).collect()), key=lambda r: r[0])
    fine = kept("quality rules", rows)
    assert fine == [r for r in rows if good(r[1])] and len(fine) < len(rows)
    told = kept("language id", fine)
    gone = {r[0] for r in fine} - {r[0] for r in told}
    wrong = {r[0] for r in fine if r[2] == "fr" and set(r[1]) & set("zß")}  # letters that the French here lacks
    assert len(wrong) == 3 and gone and gone <= wrong and all(r in fine for r in told)
    single = kept("near duplicates", told)
    assert single == one_of_each(told) and len(single) < len(told)
    mixed, near = kept("mixing", single), drawn(single)
    unsure = {r[0] for r in near[1]}
    assert {r[0] for r in mixed} - unsure == {r[0] for r in near[0]} - unsure and 0 < len(mixed) < len(single)
    check_packed(stages["packing"](spark, frame(mixed), folder).collect(), mixed)
    run = pipeline.run(spark, folder).collect()
    key = lambda g: (g.doc_id, g.piece, g.start, g.length, g.ids_crc32)
    assert sorted(map(key, run)) == sorted(map(key, stages["packing"](spark, frame(mixed), folder).collect()))


def test_stages_on_odd_tables(spark, folder):
    """Nulls in every column, clashing names, repeated rows, no rows."""
    rng = np.random.default_rng(42)
    texts = [speak(rng, TONGUES["en"], 80) for _ in range(4)]
    rows = [(k, texts[k % 4], "en", None, None, "x", 1.0, "y") for k in range(4)] + [(None, texts[0], None, None, None, None, None, None)] * 2 + [(9, None, None, "s", 1, "z", None, None), (10, "", "en", None, 0, None, 2.0, None)]
    df = spark.createDataFrame(rows, COLUMNS + ", probability string, score double, kept string")
    for name, stage in pipeline.STAGES:
        out = stage(spark, df, folder)
        if name != "packing":
            assert out.columns == df.columns
        out.collect()
        none = stage(spark, df.limit(0), folder)
        assert none.columns == out.columns and none.count() == 0
    assert stage(spark, df, folder).select("doc_id").distinct().where(F.col("doc_id").isNull()).count() == 1
