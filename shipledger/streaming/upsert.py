"""Keep the index current while release documents arrive."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.query import StreamingQuery

from shipledger.operators.index import KEY
from shipledger.operators.quality import valid_identity
from shipledger.schema import RELEASE_DOCUMENT, data_file, release_columns
from shipledger.sources.forms import document_texts, is_document
from shipledger.sources.writers import merge_index
from shipledger.session import settle


def latest_per_build(entries: DataFrame, order: str) -> DataFrame:
    """The last entry of each build in a batch."""
    rest = [c for c in entries.columns if c not in (*KEY, order)]
    last = entries.groupBy(*KEY).agg(F.max_by(F.struct(*rest), order).alias("e"))
    return last.select(*KEY, "e.*")


def apply_batch(
    index_dir: str, batch: DataFrame, rejects_dir: str | None = None, order: str | None = None
) -> None:
    """Merge one batch of arriving files into the index; documents without a valid identity go to ``rejects_dir``.

    Only the last batch of a stream can be replayed, and its rows replace themselves, so a
    replay gives the same index. A replayed batch writes its rejects again.
    """
    paths = [r["path"] for r in batch.select("path").collect()]  # at most the files of one trigger
    if not paths:
        return
    entries = settle(file_entries(batch.sparkSession, paths, order))
    if rejects_dir is not None:
        rejected = entries.where(~F.col("valid")).select("arrival.*", "document")
        rejected.write.mode("append").json(rejects_dir)
    new = latest_per_build(entries.where("valid").drop("valid", "document"), "arrival")
    merge_index(new, index_dir)


def file_entries(spark: SparkSession, paths: list[str], order: str | None = None) -> DataFrame:
    """Index entries of files, each one document over any number of lines or one document per line.

    ``valid`` tells whether an entry has a valid identity; ``document`` keeps the text of those that have not.
    ``arrival`` is the order of the entries: by the text of the document field ``order``, if one is named, then files by
    their modification time and path, and entries of one file in file order.
    """
    # Paths are names here, not patterns.
    texts = document_texts(spark, [re.sub(r"([\\\[\]{}*?])", r"\\\1", path) for path in paths])
    parsed = texts.withColumn("d", F.when(is_document(), F.from_json("text", RELEASE_DOCUMENT)))
    arrival = ["file_modification_time", "file_path", "block", "line", "item"]
    if order is not None:
        field = T.StructType([T.StructField(order, T.StringType())])
        parsed = parsed.withColumn("order", F.from_json("text", field)[order])
        arrival = ["order", *arrival]
    columns = parsed.select(F.struct(*arrival).alias("arrival"), "text", F.col("d.*"))
    entries = columns.select(*release_columns(), "arrival", "text")
    return entries.withColumns(
        {"valid": F.coalesce(valid_identity(), F.lit(False)), "data_file": data_file()}
    ).withColumn("document", F.when(~F.col("valid"), F.col("text"))).drop("text")


def entry_stream(spark: SparkSession, in_dir: str, max_files: int = 1000) -> DataFrame:
    """Paths of arriving files, for :func:`apply_batch`, which reads the files of a batch."""
    return (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .load(in_dir)
        .select("path")
    )


def stream_upsert_index(
    spark: SparkSession,
    in_dir: str,
    index_dir: str,
    checkpoint: str,
    max_files: int = 1000,
    rejects_dir: str | None = None,
    order: str | None = None,
) -> StreamingQuery:
    """Start the upsert of everything that is in ``in_dir`` now; runs to its end.

    Documents without a valid identity, or that are not JSON, are appended to ``rejects_dir``, by default
    ``<index_dir>-rejects``. ``order`` names a field of the documents whose text decides which entry of a build
    is the last of a batch (at most ``max_files`` files), whatever file it is in; a later batch replaces earlier ones.

    Call again, or pass the entry stream to a query with another trigger, for later files.
    """
    rejects = rejects_dir or f"{index_dir.rstrip('/')}-rejects"
    return (
        entry_stream(spark, in_dir, max_files)
        .writeStream.foreachBatch(lambda batch, _: apply_batch(index_dir, batch, rejects, order))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
