"""The corpus pipeline: quality rules, language, near duplicates, repeated passages, packing.

Each stage reads the documents that the one before has kept. All but the last return the columns of
documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import language, neardup, packing, quality, suffixes
from tidemark.llm._work import fresh, saved

#: Predictions less sure than this are rejected.
LEAST_SCORE = 0.3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return quality.passed(docs)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language that the classifier knows."""
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    found = language.predict(docs, language.fit(docs), pred, score)
    return found.where((F.col(pred) != "und") & (F.col(score) >= LEAST_SCORE)).drop(pred, score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (shingles of five words, similarity 0.8). Repeated rows of the doc_id that stays all stay, as do rows without one."""
    kept = neardup.near_duplicates(docs, size=5, percent=80).where("kept").select("doc_id").distinct()
    return docs.join(kept.where(F.col("doc_id").isNotNull()).hint("shuffle_hash"), "doc_id", "left_semi").unionByName(docs.where(F.col("doc_id").isNull()))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that are repeated; n_chars, where there is one, follows the text."""
    out = suffixes.without_repeats(docs)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows for training."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeats", repeats_stage),
    ("packing", packing_stage),
]

#: Training, minwise sketches and subword vocabularies have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages on the documents of `sf_dir`, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = saved(docs)
    return docs
