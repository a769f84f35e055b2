"""Token ids of documents as binary blocks with Elias-Fano boundaries.

A store is a folder with two Parquet tables:

``blocks``: one row per block of consecutive documents. ``ids`` concatenates the ids of its
documents as little-endian unsigned integers of ``width`` bytes (2 where the vocabulary allows,
else 4). The boundaries between documents (one more than documents, the first 0, the last the
number of ids) are an Elias-Fano code: ``low_width``, ``low``, ``high`` and ``samples`` of its
set bits for select. ``slice`` is the part of the key range the block lies in, ``block`` its
number there, ``offset`` the ids of the slice before it.

``slices``: one row per slice, with the ids of all slices before it (``start``). Its size is the
number of partitions of the writing job.

A document starts at slice start + block offset + boundary in the concatenated array of all ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipledger.llm.elias_fano import EliasFano, build
from shipledger.llm.word_cache import encoder_for
from shipledger.llm.work import slices

BLOCKS = (
    "slice int, block int, offset long, n_tokens long, doc_ids array<long>, width int, ids binary, "
    "low_width int, low binary, high binary, samples binary"
)


def _block_schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (part.split(" ") for part in BLOCKS.split(", "))])


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str):
    """The encoder of a worker process; it keeps what it knows for the next task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return encoder_for(Tokenizer.from_file(tokenizer_file))


def _write_blocks(tokenizer_file: str, end_id: int, block_tokens: int, block_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer_file)
        size = max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        width = 2 if size <= 1 << 16 else 4
        dtype = f"<u{width}"
        end = np.asarray([end_id], dtype=dtype).tobytes()
        slice_no, schema = TaskContext.get().partitionId(), _block_schema()
        number = offset = 0
        docs: list = []
        parts: list[bytes] = []
        bounds = [0]

        def block() -> pa.RecordBatch:
            nonlocal number, offset, docs, parts, bounds
            code = build(np.asarray(bounds))
            row = [slice_no, number, offset, bounds[-1], docs, width, b"".join(parts), *code]
            number, offset = number + 1, offset + bounds[-1]
            docs, parts, bounds = [], [], [0]
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, row))], schema=schema)

        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                docs.append(name)
                parts.append(ids.astype(dtype, copy=False).tobytes() + end)
                bounds.append(bounds[-1] + len(ids) + 1)
                if bounds[-1] >= block_tokens or len(docs) >= block_docs:
                    yield block()
        if docs:
            yield block()

    return run


def write_token_store(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    block_tokens: int = 1 << 20,
    block_docs: int = 4096,
) -> None:
    """Encode ``docs`` (doc_id, text) into a token store at ``path``, in ascending doc_id order.

    Every document gets ``end_id`` at its end. The tokenizer is used as loaded, so a special token that stands in a text
    becomes its id. A null text is an empty one; a null doc_id sorts
    first; rows with the same doc_id are all stored, ordered by text. Other columns are ignored.
    An empty table gives an empty store. Texts of any length are encoded whole; a document is
    never split over blocks. ``block_tokens`` and ``block_docs`` close a block.
    """
    spark = docs.sparkSession
    (
        docs.select("doc_id", "text")
        .repartitionByRange(slices(spark), F.col("doc_id").asc())
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(_write_blocks(tokenizer_file, end_id, block_tokens, block_docs), BLOCKS)
        .write.option("compression", "zstd")
        .parquet(f"{path}/blocks")
    )
    before = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    (
        _blocks(spark, path)
        .groupBy("slice")
        .agg(F.sum("n_tokens").alias("n_tokens"))
        .select("slice", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("start"), "n_tokens")
        .coalesce(1)
        .write.parquet(f"{path}/slices")
    )


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCKS).parquet(f"{path}/blocks")


DOCUMENTS = "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"


def _read_blocks(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["doc_ids"])
                code = EliasFano(n + 1, row["low_width"], row["low"], row["high"], row["samples"])
                bounds = code.select_many(np.arange(n + 1))
                ids = np.frombuffer(row["ids"], dtype=f"<u{row['width']}")
                parts = [ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
                data = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(bounds[:-1] + row["offset"] + row["start"], pa.int64()),
                    "n_tokens": pa.array(np.diff(bounds), pa.int64()),
                    "ids_crc32": pa.array(map(zlib.crc32, parts), pa.int64()) if "ids_crc32" in columns else None,
                    "ids": pa.array(parts, pa.binary()) if "ids" in columns else None,
                }
                yield pa.RecordBatch.from_pydict({c: data[c] for c in columns})

    return run


def read_token_store(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The documents of a store: doc_id, start, n_tokens, ids_crc32 and ids.

    ``ids`` (and the data ``ids_crc32`` is of) are little-endian unsigned 32-bit integers.
    ``columns`` picks some of them.
    """
    columns = columns or [part.split(" ")[0] for part in DOCUMENTS.split(", ")]
    kinds = dict(part.split(" ") for part in DOCUMENTS.split(", "))
    # One row per partition of the writing job: bounded by the job, not by the documents.
    starts = F.broadcast(spark.read.parquet(f"{path}/slices").select("slice", "start"))
    rows = _blocks(spark, path).join(starts, "slice")
    return rows.mapInArrow(_read_blocks(columns), ", ".join(f"{c} {kinds[c]}" for c in columns))


def boundary(row, i: int) -> int:
    """Where document ``i`` of a block row starts inside its block, by select, without decoding the rest."""
    code = EliasFano(len(row["doc_ids"]) + 1, row["low_width"], row["low"], row["high"], row["samples"])
    return code.select(i)
