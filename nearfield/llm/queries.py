"""The operators of this folder over the tables they are meant for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import html_text, maxscore, mixing, near_dup, packing, quality_rules, url_filter
from .common import fold, sample, table, written
from .kneser_ney import KneserNey
from .language_id import LanguageId
from .toxicity import Toxicity

SEQUENCE, TOKENIZER_FILE = 2048, "byte_bpe_50k.json"
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]
#: Bounds of the samples that op1 learns from.
MOST_POSITIVE, MOST_UNLABELLED = 3000, 12000
MIX_KEEP, MIX_SEED = 0.5, "mix-1"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER_FILE)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 3) == 1).alias("held_out"))
    labels = table(spark, sf_dir, "labels").where("doc_id is not null and toxic is not null").where(fold(F.col("doc_id"), 3) != 1)
    share = labels.agg(F.count("*").alias("n"), F.sum((F.col("toxic") == 1).cast("int")).alias("toxic")).first()
    train = docs.where("not held_out")
    toxic = sample(labels.where("toxic = 1").select("doc_id"), MOST_POSITIVE, F.xxhash64("doc_id", F.lit(3)))
    # at most so many ids; they are broadcast, the texts stay where they are
    draw = F.xxhash64("doc_id", "text", F.lit(5))
    positives = sample(written(train.join(F.broadcast(toxic), "doc_id", "left_semi").select("doc_id", "text")), MOST_POSITIVE, draw)
    unlabelled = sample(train, MOST_UNLABELLED, draw)
    model = Toxicity.fit(positives, unlabelled, (share["toxic"] or 0) / max(1, share["n"]))
    return model.predict(docs, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, URL_RULES, ["page_id"])


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id"), 5) == 1).alias("held_out"))
    model = KneserNey.fit(docs.where("not held_out"))
    try:
        scored = written(model.score(docs, ["doc_id", "held_out"]))
    finally:
        model.close()
    return scored.withColumn("train_tokens", F.lit(model.shape.tokens).cast("long"))


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"), params=near_dup.Params(shingle=2))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return book.select("doc_id", *names, (~quality_rules.passes("base-1")).alias("base_failed"), quality_rules.passes("full-1").alias("kept"), "n_lines", "n_upper", "fail_bits")


def op6_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), maxscore.quantised(F.col("embedding"), 256).alias("v"))
    found = maxscore.top_k(vectors, vectors.where("id % 50 = 0"), 5)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), ["page_id", "url"])


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # texts are read once: what counts of them is narrow
    text = F.col("text")
    narrow = written(docs.select("doc_id", "source", "lang", mixing.topic_of(F.coalesce(text, F.lit(""))).alias("topic"), mixing.n_words(text).alias("n")))
    rows = mixing.with_probability(narrow, *(F.col(c) for c in ("source", "lang", "topic", "n")), MIX_KEEP)
    drawn = mixing.uniform(F.col("row.doc_id"), MIX_SEED) < F.col("probability")
    return rows.select("row.doc_id", "source", "language", "topic", F.col("tokens").alias("n_tokens"), F.round("probability", 6).alias("probability"), drawn.alias("sampled"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (fold(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = LanguageId.fit(docs.where("not held_out"))
    return model.predict(docs.select("doc_id", "held_out", "text")).drop("text")


def op10_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.packed(packing.pieces(docs, "doc_id", "text", tokenizer_path(), SEQUENCE), SEQUENCE)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_url_filter, op3_kneser_ney, op4_near_dup, op5_quality_rules, op6_maxscore, op7_html_text, op8_mixing, op9_language_id, op10_bin_slack)}
