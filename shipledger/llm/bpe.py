"""Byte-level BPE as a tree reduction.

Encoding is a monoid: the value of a text is (text, ids), and values of neighbours join into the
value of both texts. A text is halved until it is at most ``LEAF`` characters long, leaves are
encoded alone, and halves are joined up the tree. Around a seam only a window is encoded again.
It grows by doubling until both ends lie at places that the pre-tokenizer cuts whatever stands on
either side (see ``pieces``), or at the ends of the halves: then the ids outside the window are the
same as in an encoding of the whole. Decoding concatenates the bytes of halves up the same tree.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from shipledger.llm.pieces import CUT
from shipledger.llm.work import map_rows

LEAF = 4096
WINDOW = 32


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a vocabulary file on the driver: one base64 token and its rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class TreeCoder:
    """Encodes and decodes by tree reduction over a ``tiktoken`` encoding of the leaves."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF, window: int = WINDOW):
        import tiktoken

        self.leaves = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.size = {rank: len(token) for token, rank in ranks.items()}
        self.leaf, self.window = max(1, leaf), max(1, window)

    def encode(self, text: str) -> list[int]:
        if len(text) <= self.leaf:
            return self.leaves.encode_ordinary(text)
        middle = len(text) // 2
        left, right = text[:middle], text[middle:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The ids of ``left + right``."""
        reach = self.window
        while True:
            start = self._last_cut(left, reach)
            end = self._first_cut(right, reach)
            if start is not None and end is not None:
                break
            reach *= 2
        keep_left = self._without(left_ids, len(left[start:].encode()), from_end=True)
        keep_right = self._without(right_ids, len(right[:end].encode()), from_end=False)
        return keep_left + self.leaves.encode_ordinary(left[start:] + right[:end]) + keep_right

    def _last_cut(self, text: str, reach: int) -> int | None:
        if reach >= len(text):
            base, part = 0, text
        else:
            base, part = len(text) - reach, text[-reach:]
        at = None
        for found in CUT.finditer(part):
            at = base + found.start()
        return at if at is not None else (0 if base == 0 else None)

    def _first_cut(self, text: str, reach: int) -> int | None:
        found = CUT.search(text, 0, min(len(text), reach))
        if found is not None:
            return found.start()
        return len(text) if reach >= len(text) else None

    def _without(self, ids: list[int], n_bytes: int, from_end: bool) -> list[int]:
        """``ids`` without those that make up ``n_bytes`` at one end; cuts are token boundaries."""
        count = 0
        order = reversed(ids) if from_end else iter(ids)
        while n_bytes > 0:
            n_bytes -= self.size[next(order)]
            count += 1
        if n_bytes:
            raise AssertionError("a window ends inside a token")
        return ids[: len(ids) - count] if from_end else ids[count:]

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf:
            return self.leaves.decode_bytes(ids)
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def _with_column(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


#: Rows that are encoded at once; bounds the memory of a worker.
ROWS = 512


def encode(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", into: str = "ids") -> DataFrame:
    """Add ``into`` (array<int>): the ids of ``text``, as plain BPE of the whole text gives them.

    A null text is an empty one, an empty text has no ids. All rows and other columns stay; a column
    that is called like ``into`` is replaced. Texts of any length are encoded whole.
    """
    df = df.drop(into)
    place = df.columns.index(text)
    context = df.sparkSession.sparkContext
    shared = context.broadcast(ranks)  # the vocabulary: fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeCoder(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                ids = [coder.encode(value or "") for value in part.column(place).to_pylist()]
                yield _with_column(part, into, pa.array(ids, pa.list_(pa.int32())))

    return map_rows(df, run, {into: "array<int>"})


def decode(df: DataFrame, ranks: dict[bytes, int], pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add ``into`` (binary): the bytes that the column ``ids`` stands for; null for null."""
    df = df.drop(into)
    place = df.columns.index(ids)
    shared = df.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = TreeCoder(shared.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                texts = [None if v is None else coder.decode(v) for v in part.column(place).to_pylist()]
                yield _with_column(part, into, pa.array(texts, pa.binary()))

    return map_rows(df, run, {into: "binary"})
