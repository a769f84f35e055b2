"""Removal of repeated lines with levelled sorted runs of line hashes.

Batches of documents arrive one after the other. What earlier batches held is kept as runs:
Parquet tables of (key, doc), range-partitioned and sorted by key, a 128-bit hash of the line.
The keys of a batch are merge-joined with the runs: those found there are old, the rest
(the anti-join) becomes a run of its own at level 0. As soon as a level has ``fanout`` runs, they are
merged into one run of the next level, so n batches leave about fanout * log(n) runs to join with.
No key is in two runs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.llm.work import map_rows, slices, unused, written

STRIP = " \t\n\x0b\x0c\r"
_LOWER = {c: c + 32 for c in range(65, 91)}
MIN_CHARS = 10
#: Stands for a null doc_id, which comes before all others.
NO_DOC = -(1 << 63)


def line_key(line: str, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the stripped line with A-Z in lower case; None for a line that is too short to count."""
    import xxhash

    key = line.strip(STRIP)
    if len(key) < min_chars:
        return None
    key = key.lower() if key.isascii() else key.translate(_LOWER)
    return xxhash.xxh3_128_digest(key.encode())


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, doc): the distinct line keys of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                keys, owners = [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    found = {line_key(line, min_chars) for line in (text or "").split("\n")} - {None}
                    keys.extend(found)
                    owners.extend([doc] * len(found))
                yield pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.binary()), "doc": pa.array(owners, pa.int64())})

    return docs.select(_doc().alias("doc"), "text").mapInArrow(run, "key binary, doc long")


def _doc():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_DOC))


class LineRuns:
    """The runs of all batches so far; ``levels[i]`` lists the tables at level i."""

    def __init__(self, spark: SparkSession, fanout: int = 2, min_chars: int = MIN_CHARS):
        self.spark, self.fanout, self.min_chars = spark, fanout, min_chars
        self.levels: list[list[DataFrame]] = [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _sorted(self, rows: DataFrame, level: int) -> DataFrame:
        by_key = rows.repartitionByRange(slices(self.spark), "key").sortWithinPartitions("key")
        return written(by_key, f"line-run-{level}")

    def add_batch(self, docs: DataFrame) -> DataFrame:
        """Add a batch; returns (doc, keys): the keys whose lines a document of it loses.

        A key of an earlier batch is lost by every document of this one, a key that is new is kept by
        the smallest doc_id of the batch that holds it.
        """
        entries = written(line_keys(docs, self.min_chars), "line-keys")
        own = entries.groupBy("key").agg(F.min("doc").alias("doc"), F.max("doc").alias("last"))
        if self.runs():
            old = reduce(DataFrame.unionByName, self.runs()).withColumnRenamed("doc", "old")
            own = own.join(old, "key", "left")
        else:
            own = own.withColumn("old", F.lit(None).cast("long"))
        keyed = written(own, "line-owners")
        self._push(keyed.where(F.col("old").isNull()).select("key", "doc"), 0)
        owners = keyed.select("key", F.coalesce("old", "doc").alias("owner"), "last").where(
            F.col("last") != F.col("owner")
        )
        lost = entries.join(owners, "key").where(F.col("doc") != F.col("owner"))
        return written(lost.groupBy("doc").agg(F.collect_list("key").alias("keys")), "line-lost")

    def _push(self, rows: DataFrame, level: int) -> None:
        if len(self.levels) == level:
            self.levels.append([])
        self.levels[level].append(self._sorted(rows, level))
        if len(self.levels[level]) >= self.fanout:
            merged = reduce(DataFrame.unionByName, self.levels[level])
            self.levels[level] = []
            self._push(merged, level + 1)


def drop_lines(docs: DataFrame, lost: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` without the lines that ``lost`` names; adds n_lines and n_dropped, replacing such columns."""
    docs = docs.drop("n_lines", "n_dropped")
    names = docs.columns
    at = names.index("text")
    doc, keys = unused("_doc", names), unused("_keys", names)
    lost = lost.select(F.col("doc").alias(doc), F.col("keys").alias(keys))
    rows = docs.withColumn(doc, _doc()).join(lost, doc, "left").drop(doc)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts, lines, dropped = [], [], []
                for text, keys in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist()):
                    parts = (text or "").split("\n")
                    kept = parts
                    if keys:
                        keys = set(keys)
                        kept = [line for line in parts if line_key(line, min_chars) not in keys]
                    texts.append("\n".join(kept))
                    lines.append(len(parts))
                    dropped.append(len(parts) - len(kept))
                columns = [part.column(i) for i in range(len(names))]
                columns[at] = pa.array(texts, columns[at].type)
                columns += [pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=[*part.schema.names[: len(names)], "n_lines", "n_dropped"])

    return map_rows(rows, run, {"n_lines": "long", "n_dropped": "long"}, keep=len(names))


def dedup_lines(docs: DataFrame, batches: int = 4, fanout: int = 2, min_chars: int = MIN_CHARS) -> DataFrame:
    """Every line key of at least ``min_chars`` characters stays only in the smallest doc_id that holds it.

    ``docs`` (doc_id, text and any other columns) is taken in ``batches`` ascending ranges of doc_id
    through ``LineRuns``. All rows stay, with the kept lines as text (a null text becomes empty), and
    n_lines (before) and n_dropped. Rows of one doc_id count as one document and keep their lines; a
    null doc_id comes before all others. An empty table gives no rows.
    """
    doc = _doc()
    steps = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(doc, steps, 10_000).alias("cuts")).first()["cuts"] if steps else []
    cuts = sorted(set(cuts or []))
    runs = LineRuns(docs.sparkSession, fanout, min_chars)
    lost = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = docs
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where((F.col("doc_id") <= high) | F.col("doc_id").isNull() if low is None else F.col("doc_id") <= high)
        lost.append(runs.add_batch(batch))
    return drop_lines(docs, reduce(DataFrame.unionByName, lost), min_chars)
