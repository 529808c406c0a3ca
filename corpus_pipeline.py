"""Documents to packed training sequences, stage by stage.

Each stage reads what the one before it wrote. The first four return the
columns of ``documents``; the last one places every piece in a sequence.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import mixing, near_dup, packing, quality_rules
from nearfield.llm.common import fold, shared_folder
from nearfield.llm.language_id import LanguageId
from nearfield.llm.queries import MIX_KEEP, MIX_SEED, SEQUENCE, tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what passes the full policy."""
    return quality_rules.keep_good(docs, "full-1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of no language, and those that are clearly not in the
    language they are listed under."""
    model = LanguageId.fit(docs.where(fold(F.col("doc_id"), 4) != 2))
    held = docs.select(F.struct("*").alias("__nf_row"), F.col("text").alias("__nf_text"))
    told = model.predict(held, F.col("__nf_text"))
    wrong = (F.col("lang_pred") != F.col("__nf_row.lang")) & (F.col("score") >= 0.9)
    return told.where((F.col("lang_pred") != "und") & ~F.coalesce(wrong, F.lit(False))).select("__nf_row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words, 0.8."""
    return near_dup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to tempered source, language and topic weights."""
    text = F.col("text")
    return mixing.sampled(docs, "doc_id", F.col("source"), F.col("lang"), mixing.topic_of(F.coalesce(text, F.lit(""))), mixing.n_words(text), MIX_KEEP, MIX_SEED)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens."""
    return packing.packed(packing.pieces(docs, "doc_id", "text", tokenizer_path(), SEQUENCE), SEQUENCE)


STAGES = [("quality rules", quality), ("language id", language), ("near duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]
#: Language identification, near-duplicates and packing are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
