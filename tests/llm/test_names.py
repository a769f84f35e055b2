"""Operators and stages on documents with columns that they use themselves, and with a dot in a name."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shipledger.llm import bpe, chat, decontaminate, divergence, line_dedup, ngram_join, packing, pii, quality, runs, sharding, token_store, work

NAMES = ["_key", "_keys", "_doc", "_slice", "a.b", "_column_1", "_text", "_grade"]
WORDS = " ".join(f"word{i}" for i in range(40))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, f"{WORDS}\nthis line is repeated here"), (2, f"other {WORDS}\nthis line is repeated here"), (3, None), (4, ""), (5, "short a@b.org")]
    extra = [F.lit(f"x{i}").alias(name) for i, name in enumerate(NAMES)]
    return spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(5).cast("long").alias("n_chars"), *extra)


@pytest.fixture(scope="module")
def tables(spark, docs, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(1, 1, 0), (2, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"item{i}" for i in range(30)))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder)


def test_stages_keep_all_columns(spark, docs, tables):
    at = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        at = work.written(stage(spark, at, tables), "stage")
        assert at.columns == docs.columns, name
        assert all(r["a.b"] == "x4" and r["_keys"] == "x1" for r in at.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, at, tables).count() == at.count() > 0


def test_operators_read_what_they_need(spark, docs, tables):
    count = docs.count()
    path = work.new_folder(spark, "names")
    token_store.write_token_store(docs, f"{path}/store", public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert token_store.read_token_store(spark, f"{path}/store").count() == count
    assert ngram_join.jaccard_components(docs, n=5, percent=80).count() == count
    assert line_dedup.dedup_lines(docs).columns == [*docs.columns, "n_lines", "n_dropped"]
    assert sharding.shard_documents(docs, 3).count() == count
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert bpe.encode(docs, ranks, public_tokenizers.PATTERN).columns == [*docs.columns, "ids"]
    model = quality.fit(docs, spark.read.parquet(f"{tables}/labels.parquet"))
    assert quality.score(docs, model).columns == [*docs.columns, "expected_grade", "tail_probability"]
    assert quality.select(docs, model).columns == docs.columns
    items = spark.read.parquet(f"{tables}/benchmark.parquet")
    assert decontaminate.drop_leaks(docs, items).columns == docs.columns
    assert pii.find_personal_data(docs.select("doc_id", "text", "_key", "a.b".join("``"))).count() == count
    packing.pack_documents(docs, f"{path}/packed", public_tokenizers.path("word_bpe_49k.json"), 2)
    assert runs.find_runs(docs).count() == count
    assert divergence.source_divergence(docs, min_docs=1).where("part = 'term'").count() == 0
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), "text", "_doc", "`a.b`")
    assert chat.read_turns(chat.format_conversations(turns)).count() == count
