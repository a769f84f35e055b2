"""Artifacts of any size by byte ranges, as rows (path, piece, content).

A value is below 2 GiB, so a larger file cannot be one row of the ``binaryFile`` source. Here only names and sizes come from that
source; ranges are read where their rows are, from any store that Arrow's file systems open.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger import fixed
from shipledger.operators.extract import PIECE_BYTES
from shipledger.session import settle
from shipledger.sources.readers import scan_artifacts

_INSIDE = re.compile(rb"[\x20-\x7E]*")
#: Bytes read at a time for the rest of a run behind a range.
_AHEAD = 64 * 1024


def _store(path: str):
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "", 1))


def opened(path: str):
    """An input file for random reads; ``path`` is a URI or a local path."""
    store, name = _store(path)
    return store.open_input_file(name)


def read_piece(source, length: int, piece: int, size: int) -> bytes:
    """Range ``piece`` of a file, without a run that began before it and with the rest of one that leaves it."""
    start = piece * size
    before = start > 0
    source.seek(start - before)
    data = source.read(size + before)
    if before and data and _INSIDE.match(data, 0, 1).end():
        data = data[_INSIDE.match(data).end() :]
    else:
        data = data[before:]
    at = start + size
    parts = [data]
    while parts[-1] and 0x20 <= parts[-1][-1] <= 0x7E and at < length:
        source.seek(at)
        ahead = source.read(_AHEAD)
        rest = ahead[: _INSIDE.match(ahead).end()]
        at += len(ahead)
        if rest:
            parts.append(rest)
        if len(rest) < len(ahead) or not ahead:
            break
    return b"".join(parts)


def _read(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (path, length, piece) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("path", "length", "piece")))):
                with opened(path) as source:
                    content = read_piece(source, length, piece, size)
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(i, 1) for c in batch.columns), pa.array([content], pa.binary())], names=[*batch.schema.names, "content"]
                )

    return run


def _parts(df: DataFrame) -> int:
    """Tasks to deal short rows over, each of which stands for much work; without a number few bytes would become few tasks."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _with_contents(files: DataFrame, size: int) -> DataFrame:
    """``files`` (path, length, other columns) once per piece, with ``piece`` and ``content``."""
    last = F.floor(F.greatest(F.col("length") - 1, F.lit(0)) / size).cast("long")
    pieces = files.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    # Ranges of one file lie together in what lists it; dealt anew, they are read by many tasks.
    dealt = pieces.repartition(_parts(files), "path", "piece")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.mapInArrow(_read(size), f"{kinds}, content binary")


def scan_artifact_pieces(
    spark: SparkSession, path: str, exts: list[str] | None = None, max_bytes: int | None = None, piece_bytes: int = PIECE_BYTES
) -> DataFrame:
    """Files as (path, modificationTime, length, piece, content), one row per ``piece_bytes`` bytes, of any size.

    A run of printable characters is whole in the piece where it starts, and only there. Choice of files as in ``scan_artifacts``; an empty file is
    one empty piece. A file that cannot be read fails the job.
    """
    files = scan_artifacts(spark, path, exts, max_bytes).select("path", "modificationTime", "length")
    return _with_contents(files, piece_bytes)


#: Folders that written files are dealt over.
FOLDERS = 256


def write_files(rows: DataFrame, out: str) -> DataFrame:
    """Every row (name, content, other columns) as a file of its own below ``out``; gives path and length with the other columns.

    A task writes its rows one after the other, with no folder, sort or listing for a single row. A file gets its name when it is complete, so a
    task that runs again leaves the same files. Names tell rows apart and hold no slash. The result is computed once.
    """

    def write(name: str, content: bytes) -> tuple[str, int]:
        folder = f"{out}/{zlib.crc32(name.encode()) % FOLDERS:03d}"
        store, place = _store(folder)
        store.create_dir(place, recursive=True)
        draft = f"{place}/_{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as stream:
            stream.write(content)
        store.move(draft, f"{place}/{name}")
        return f"{folder}/{name}", len(content)

    # Plain UDF: it takes 100 rows at a time, however large their contents are.
    writer = F.udf(write, "struct<path: string, length: long>", useArrow=False).asNondeterministic()
    rest = [c for c in rows.columns if c not in ("name", "content")]
    return settle(rows.select(*rest, writer("name", "content").alias("file_")).select("file_.*", *rest))


_HEADS = {"darwin_version": fixed.KERNEL_DARWIN, "xnu_version": fixed.KERNEL_XNU, "suffix": fixed.KERNEL_ARCH}


def kernel_heads(files: DataFrame, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """The fields of :func:`kernel_fields` of kernels by path (path, length, other columns), read only up to the last first match.

    Adds darwin_version, xnu_version, suffix and ``pieces_read``. A kernel is read piece by piece by one task, and no further once it has all
    fields; kernels are spread over tasks.
    """
    patterns = {name: re.compile(pattern.encode()) for name, pattern in _HEADS.items()}
    run_of = re.compile(rb"[\x20-\x7E]{%d,}" % fixed.MIN_RUN)

    def head(path: str, length: int) -> tuple[dict[str, str | None], int]:
        found: dict[str, str | None] = dict.fromkeys(patterns)
        read = 0
        with opened(path) as source:
            for piece in range(max(1, -(-length // piece_bytes))):
                data = read_piece(source, length, piece, piece_bytes)
                read += 1
                for run in run_of.finditer(data):
                    for name in [n for n, value in found.items() if value is None]:
                        hit = patterns[name].search(run[0])
                        if hit is not None and hit[1]:
                            found[name] = hit[1].decode("ascii")
                if None not in found.values():
                    break
        return found, read

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heads = [head(p, n) for p, n in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array([h[0][n] for h in heads], pa.string()) for n in patterns), pa.array([h[1] for h in heads], pa.int64())],
                names=[*batch.schema.names, *patterns, "pieces_read"],
            )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.repartition(_parts(files), "path").mapInArrow(run, f"{kinds}, darwin_version string, xnu_version string, suffix string, pieces_read long")
