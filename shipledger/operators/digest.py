"""SHA-256 of archives against stored digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

READ_BYTES = 8 * 1024 * 1024


def file_digests(files: DataFrame) -> DataFrame:
    """path, length and SHA-256 of files of any size (path, length), read in pieces of 8 MiB.

    A file is one sequence for the digest, so it is read by one task; files are spread over
    tasks. The path may be in any store that Arrow's file systems open. A file that cannot be read
    has a null digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                digest = hashlib.sha256()
                try:
                    store, name = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))
                    with store.open_input_stream(name) as stream:
                        while piece := stream.read(READ_BYTES):
                            digest.update(piece)
                    found.append(digest.hexdigest())
                except (OSError, pa.ArrowException):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], names=["path", "length", "digest"])

    return files.select("path", F.col("length").cast("long").alias("length")).mapInArrow(
        run, "path string, length long, digest string"
    )


def archive_digest(artifacts: DataFrame, sidecars: DataFrame, rehash: bool = False) -> DataFrame:
    """Digest and status of each archive.

    ``artifacts`` has path, length and either content or, for archives of any size, only the path,
    from which they are read in pieces (see ``file_digests``). ``sidecars`` has path (of the archive) and
    value (text of the digest file). Status: verified or failed against a stored digest, hashed
    without one or with ``rehash``, unreadable for files that cannot be read.
    """
    stored = F.lower(F.regexp_extract("value", r"[^ \n\t]+", 0))
    if "content" in artifacts.columns:
        hashed = artifacts.select("path", "length", F.sha2("content", 256).alias("digest"))
    else:
        hashed = file_digests(artifacts)
    known = sidecars.select("path", F.nullif(stored, F.lit("")).alias("stored"))
    return hashed.join(known, "path", "left").select(
        "path",
        "length",
        "digest",
        F.when(F.col("digest").isNull(), "unreadable")
        .when(F.lit(rehash) | F.col("stored").isNull(), "hashed")
        .when(F.col("stored") == F.col("digest"), "verified")
        .otherwise("failed")
        .alias("status"),
    )


def digest_totals(digests: DataFrame) -> DataFrame:
    """Number of archives per status."""
    return digests.groupBy("status").agg(F.count("*").alias("archives"))
