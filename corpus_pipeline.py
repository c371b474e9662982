"""Corpus preparation in five stages, each reading what the one before it wrote.

A stage takes (spark, docs, sf_dir) and works on all of ``docs``.  All but the last return the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspan.llm import bpe, jaccard, line_dedup, mixing, shared, toxicity


def _like(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` in the columns of ``docs``, with the lengths of its texts."""
    length = F.coalesce(F.length("text").cast("long"), F.col("n_chars")) if "n_chars" in docs.columns else None
    return changed.select(*(length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns))


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Toxic documents go."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = shared.free(docs, "_toxic")
    return _like(docs, toxicity.scored(docs, model, score).where(F.col(score) < toxicity.TOXIC))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of repeated three-line windows go, but for the first occurrence."""
    return _like(docs, line_dedup.dedup_lines(docs, counts=False))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return jaccard.deduplicated(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in their target shares: a row for each time that a document is taken."""
    return _like(docs, mixing.mixed(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids, n_tokens, and whether the ids decode to the text."""
    return bpe.encoded(docs, ("doc_id", "lang", "source"))


STAGES = [("toxicity", clean), ("line_dedup", dedup_lines), ("jaccard_join", dedup_near), ("mixing", mix), ("bpe", encode)]
#: SQL can't express the classifier; ``tests/llm`` holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = shared.written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
