"""A training-data pipeline: select, deduplicate, decontaminate and tokenize documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and reads
again as the next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm import decontaminate, line_dedup, ngram_join, quality
from shipledger.llm.queries import bpe_digests
from shipledger.llm.registry import table
from shipledger.llm.work import written


def _own(docs: DataFrame) -> list[str]:
    """The columns of ``docs``, quoted, as a name may hold a dot."""
    return [f"`{c}`" for c in docs.columns]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model, fitted on their labels, gives the best grade; others go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.select(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that a smaller doc_id has; what is left without a word goes.

    ``n_chars`` becomes the length of what is kept.
    """
    kept = line_dedup.dedup_lines(docs, batches=4)
    some = (F.col("n_dropped") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return kept.where(some).withColumn("n_chars", F.length("text").cast("long")).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that shares 80 % of its 5-word shingles."""
    groups = ngram_join.jaccard_components(docs, n=5, percent=80)
    others = groups.where(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    others = written(others, "near-duplicates")
    few = F.broadcast(others) if others.count() <= ngram_join.BROADCAST_ROWS else others
    return docs.join(few, "doc_id", "left_anti").select(*_own(docs))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark")).select(*_own(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the text that they decode to."""
    return bpe_digests(docs.select("doc_id", "text"))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark),
    ("bpe", tokenize),
]

#: SQL cannot express the fitted model or the tokenizer; a test compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
