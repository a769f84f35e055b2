"""Packing token ids of documents into sequences of a fixed size, online and in bounded space.

1. Every partition keeps at most ``open_windows`` open windows. What a document has beyond whole sequences goes to the
   open window that it fills best. When it fits none and no more may be opened, the fullest window is emitted.
   A gap of ``min_cut`` ids or more in it is first filled with the beginning of the document that did not fit, whose rest is placed
   like a document of its own; so padding stays below ``min_cut`` ids a sequence and documents are cut only there.
2. The open windows that partitions end with are merged: ``FAN_IN`` partitions' windows become the documents of one partition of
   the next round, until one partition is left. A round costs ``open_windows`` windows a partition, whatever the data.
3. The windows of the last partition are poured together; its last sequence is cut into powers of two.

Every round is a written table, so a lost executor costs tasks.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm.word_cache import encoder_for

SEQUENCE = 4096
OPEN_WINDOWS = 64
MIN_CUT = 16
#: Partitions whose open windows are merged by one task of the next round.
FAN_IN = 32

PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint>"
SEQUENCES = f"part int, number long, closed boolean, n_tokens int, pieces array<{PIECE}>, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"

_PIECE = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64())])
_SCHEMA = pa.schema(
    [("part", pa.int32()), ("number", pa.int64()), ("closed", pa.bool_()), ("n_tokens", pa.int32()), ("pieces", pa.list_(_PIECE)), ("ids", pa.binary())]
)

#: Pieces of a window or of what is to be placed: (doc_id, start, doc_tokens, ids).
Part = tuple[int, int, int, np.ndarray]


def cut(parts: list[Part], size: int) -> tuple[list[Part], list[Part]]:
    """The first ``size`` ids of ``parts``, and the rest."""
    head: list[Part] = []
    for i, (doc, start, total, ids) in enumerate(parts):
        if size <= 0:
            return head, parts[i:]
        if len(ids) > size:
            head.append((doc, start, total, ids[:size]))
            return head, [(doc, start + size, total, ids[size:]), *parts[i + 1 :]]
        head.append((doc, start, total, ids))
        size -= len(ids)
    return head, []


def _length(parts: list[Part]) -> int:
    return sum(len(p[3]) for p in parts)


class Packer:
    """Open windows of one partition; ``place`` gives the sequences that it fills or gives up."""

    def __init__(self, size: int = SEQUENCE, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT):
        if size < 1 or open_windows < 1 or min_cut < 1:
            raise ValueError("size, open_windows and min_cut must be positive")
        self.size, self.open_windows, self.min_cut = size, open_windows, min_cut
        self.gaps: list[tuple[int, int]] = []  # (free ids, window), ascending
        self.windows: dict[int, list[Part]] = {}
        self.opened = 0

    def place(self, parts: list[Part]) -> Iterator[list[Part]]:
        """Place parts that stay together where they can."""
        left = _length(parts)
        while left >= self.size:
            head, parts = cut(parts, self.size)
            left -= self.size
            yield head
        while left:
            at = bisect_left(self.gaps, (left, -1))
            if at < len(self.gaps):  # the smallest gap that is large enough
                gap, window = self.gaps.pop(at)
                self.windows[window] += parts
                if gap == left:
                    yield self.windows.pop(window)
                else:
                    insort(self.gaps, (gap - left, window))
                return
            if len(self.gaps) < self.open_windows:
                self.windows[self.opened] = list(parts)
                insort(self.gaps, (self.size - left, self.opened))
                self.opened += 1
                return
            gap, window = self.gaps.pop(0)  # none fits: the fullest goes
            if gap >= self.min_cut:
                head, parts = cut(parts, gap)
                left -= gap
                self.windows[window] += head
            yield self.windows.pop(window)

    def leftovers(self) -> Iterator[list[Part]]:
        """The open windows, fullest first."""
        for _, window in self.gaps:
            yield self.windows[window]
        self.gaps, self.windows = [], {}

    def poured(self) -> Iterator[list[Part]]:
        """The open windows filled from each other; the last sequence as powers of two."""
        parts: list[Part] = []
        for window in self.leftovers():
            parts += window
            while _length(parts) >= self.size:
                head, parts = cut(parts, self.size)
                yield head
        while left := _length(parts):
            head, parts = cut(parts, 1 << (left.bit_length() - 1))
            yield head


def _rows(found: Iterator[tuple[bool, list[Part]]], dtype: str) -> Iterator[pa.RecordBatch]:
    """Sequences as record batches of some hundreds of kilobytes."""
    part, rows, held = TaskContext.get().partitionId(), [], 0
    for number, (closed, parts) in enumerate(found):
        pieces = [dict(zip(("doc_id", "start", "length", "doc_tokens"), (d, s, len(i), t))) for d, s, t, i in parts]
        ids = b"".join(i.tobytes() for *_, i in parts)
        n = len(ids) // np.dtype(dtype).itemsize
        rows.append(dict(zip(_SCHEMA.names, (part, number, closed, n, pieces, ids))))
        held += len(ids) + 40 * len(pieces)
        if held >= 1 << 20:
            yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)


@lru_cache(maxsize=1)
def _encoder(tokenizer_file: str):
    """The encoder of a worker process; it keeps what it knows for the next task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return encoder_for(Tokenizer.from_file(tokenizer_file))


def _pack_documents(tokenizer_file: str, end_id: int, size: int, open_windows: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer_file), Packer(size, open_windows, min_cut)
        end = np.asarray([end_id], dtype=encoder.dtype)

        def found():
            for batch in batches:
                for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                    ids = np.concatenate([ids, end])
                    for parts in packer.place([(doc, 0, len(ids), ids)]):
                        yield True, parts
            for parts in packer.leftovers():
                yield False, parts

        yield from _rows(found(), encoder.dtype)

    return run


def _merge_windows(dtype: str, last: bool, size: int, open_windows: int, min_cut: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(size, open_windows, min_cut)

        def found():
            for batch in batches:
                for row in batch.to_pylist():
                    ids, parts, at = np.frombuffer(row["ids"], dtype=dtype), [], 0
                    for p in row["pieces"]:
                        parts.append((p["doc_id"], p["start"], p["doc_tokens"], ids[at : at + p["length"]]))
                        at += p["length"]
                    for done in packer.place(parts):
                        yield True, done
            for parts in packer.poured() if last else packer.leftovers():
                yield last, parts

        yield from _rows(found(), dtype)

    return run


def pack_documents(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int,
    size: int = SEQUENCE,
    open_windows: int = OPEN_WINDOWS,
    min_cut: int = MIN_CUT,
) -> DataFrame:
    """Encode ``docs`` (doc_id, text), pack them and write the sequences below ``path``; gives :func:`read_sequences`.

    A null text is an empty one; every document ends with ``end_id``. Rows are packed as they lie in the partitions of ``docs``;
    repeated rows and null doc_ids are documents like others, other columns are ignored, an empty table gives no sequence.
    Every id is in one sequence. A document of ``size`` ids or more fills whole sequences first. Of what remains only what meets a
    window that is given up is cut. A sequence has ``size`` ids at most and lacks fewer than ``min_cut`` of them, but for at most
    ``size.bit_length()`` last ones in the whole table, whose lengths are powers of two.
    """
    spark = docs.sparkSession
    limits = (size, open_windows, min_cut)
    first = docs.select(F.col("doc_id").cast("long"), "text")
    _write(first.mapInArrow(_pack_documents(tokenizer_file, end_id, *limits), SEQUENCES), path, 0)
    dtype, level = _encoder(tokenizer_file).dtype, 0
    left = _windows(spark, path).where("level = 0 AND NOT closed")
    while (parts := left.agg(F.countDistinct("part")).first()[0]) > 0:
        level += 1
        last = parts <= FAN_IN
        # The tasks of a round are runs of the partitions before; sorted, so that a task gives the same windows when it runs again.
        dealt = left.repartition(1) if last else left.repartitionByRange(-(-parts // FAN_IN), F.expr(f"part div {FAN_IN}"))
        dealt = dealt.select("pieces", "ids", "part", "number").sortWithinPartitions("part", "number").select("pieces", "ids")
        _write(dealt.mapInArrow(_merge_windows(dtype, last, *limits), SEQUENCES), path, level)
        if last:
            break
        left = _windows(spark, path).where(f"level = {level} AND NOT closed")
    return read_sequences(spark, path)


def _write(sequences: DataFrame, path: str, level: int) -> None:
    sequences.write.option("compression", "zstd").partitionBy("closed").parquet(f"{path}/level={level}")


def _windows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{SEQUENCES}, level int").parquet(path)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """The sequences: sequence_id, n_tokens, pieces (doc_id, start, length, doc_tokens) in order, ids as little-endian integers."""
    number = F.shiftleft(F.col("level").cast("long"), 58) + F.shiftleft(F.col("part").cast("long"), 32) + F.col("number")
    return _windows(spark, path).where("closed").select(number.alias("sequence_id"), "n_tokens", "pieces", "ids")


def _digests(dtype: str):
    schema = pa.schema([(n, pa.int64()) for n, _ in (c.split(" ") for c in PIECES.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, names = batch.column("pieces"), batch.column("sequence_id").to_pylist()
            piece = lists.flatten()
            columns = {n: piece.field(n) for n in ("doc_id", "start", "length", "doc_tokens")}
            lengths = columns["length"].to_pylist()
            crc, sequence, offset, i = [], [], [], 0
            for name, data, n in zip(names, batch.column("ids").to_pylist(), np.diff(lists.offsets.to_numpy()).tolist()):
                ids, at = np.frombuffer(data, dtype=dtype).astype("<u4").tobytes(), 0
                for length in lengths[i : i + n]:
                    crc.append(zlib.crc32(ids[4 * at : 4 * (at + length)]))
                    sequence.append(name)
                    offset.append(at)
                    at += length
                i += n
            columns |= {"ids_crc32": crc, "sequence_id": sequence, "offset": offset}
            yield pa.RecordBatch.from_arrays([pa.array(columns[n], pa.int64()) for n in schema.names], schema=schema)

    return run


def read_pieces(spark: SparkSession, path: str, tokenizer_file: str) -> DataFrame:
    """One row per piece with the checksum of its ids as unsigned 32-bit integers, from the sequences on disk."""
    dtype = _encoder(tokenizer_file).dtype
    return read_sequences(spark, path).mapInArrow(_digests(dtype), PIECES)
