"""Entries of files that hold one JSON array each, read in splits.

The text source cuts a file at every closing brace, within byte ranges of any store that Spark reads. Whether a range starts inside a
text and how deep it is nested depends on the ranges before it:

1. Of files with several ranges, each range gives one row: whether it changes the side of quotes, and for either side at its start the
   change of depth and how many entries end in it, by depth.
2. A prefix scan over these rows, a few numbers each, gives side, depth and the number of entries before every range.
3. A second pass cuts the ranges into entries. An entry inside a range is whole there; only the pieces of those that cross a
   border are shuffled and put together.

An entry is a value; the array as a whole never is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shipledger.session import settle

#: Ranges up to which their table (one short row each) is broadcast.
BROADCAST_ROWS = 500_000
#: Rows of entries that leave a task at a time.
BATCH_ROWS = 4096

_TOKEN = re.compile(r'\\.|"|[\[\]{},]', re.DOTALL)
_SUMMARY = "file_path string, block long, flips int, delta0 long, delta1 long, ends0 map<long,long>, ends1 map<long,long>, opens boolean"
_ENTRY = "file_path string, pos long, block long, raw string, closed_by string, whole boolean"
_OUT = pa.schema([("file_path", pa.string()), ("pos", pa.int64()), ("block", pa.int64()), ("raw", pa.string()), ("closed_by", pa.string()), ("whole", pa.bool_())])


def _walk(text: str, inside: bool, depth: int) -> tuple[bool, int, list[tuple[int, str, int]]]:
    """Side of quotes and depth behind ``text``, and its brackets and commas outside of texts with the depth before them."""
    found = []
    for token in _TOKEN.finditer(text):
        c = token[0]
        if c == '"':
            inside = not inside
        elif inside or len(c) > 1:
            continue
        else:
            found.append((token.start(), c, depth))
            depth += (c in "[{") - (c in "]}")
    return inside, depth, found


def opens_array(text: str) -> bool:
    """True for a text that begins like an array."""
    return text.lstrip("\ufeff \t\r\n").startswith("[")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, bool, list[str]]]:
    """The ranges of a task, one after the other: what tells them apart, whether more of the range follows, and its texts.

    All texts but the first of a file begin with the brace that ended the one before.
    """
    key, texts = None, []
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for value, *where in zip(*columns):
            where = tuple(where)
            if where != key:
                if key is not None:
                    yield key, False, texts
                key, texts = where, [value if where[1] == 0 else "}" + value]
            else:
                texts.append("}" + value)
        if key is not None:
            yield key, True, texts
            texts = []
    if key is not None:
        yield key, False, texts


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = pa.map_(pa.int64(), pa.int64())
    sides, depths, ends, opens = [False, True], [0, 0], [Counter(), Counter()], False
    fresh = True
    for key, more, texts in _ranges(batches):
        path, block = key
        if fresh:
            opens = block == 0 and bool(texts) and opens_array(texts[0])
        for text in texts:
            for side in (0, 1):
                sides[side], depths[side], found = _walk(text, sides[side], depths[side])
                # A comma, or a bracket that closes the array, ends an entry if the depth before it is 1.
                ends[side].update(depth for _, c, depth in found if c in ",]}")
        fresh = not more
        if fresh:
            columns = [path], [block], [int(sides[0])], *([d] for d in depths)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))]
                + [pa.array([list(e.items())], kinds) for e in ends]
                + [pa.array([opens])],
                names=[c.split(" ")[0] for c in _SUMMARY.split(", ")],
            )
            sides, depths, ends = [False, True], [0, 0], [Counter(), Counter()]


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    state = None

    for key, more, texts in _ranges(batches):
        path, block, inside, depth, number, opens = key
        if state is None:
            if block == 0:
                opens = bool(texts) and opens_array(texts[0])
                if not opens:
                    rows.append((path, -1, 0, (texts or [""])[0][:200], "not_array", True))
            state = [bool(inside), depth, number, [], depth == 0, opens]
        if state[5]:
            for text in texts:
                _cut(text, state, path, block, rows)
        if not more:
            if state[5] and state[3]:
                rows.append((path, state[2], block, "".join(state[3]), "", False))
            state = None
        while len(rows) >= BATCH_ROWS:
            yield _batch(rows[:BATCH_ROWS])
            del rows[:BATCH_ROWS]
    if rows:
        yield _batch(rows)


def _cut(text: str, state: list, path: str, block: int, rows: list[tuple]) -> None:
    """Add the entries that end in ``text`` to ``rows``; state: side, depth, number, pieces of the open entry, whether it began here."""
    state[0], after, found = _walk(text, state[0], state[1])
    begin = 0 if state[1] else len(text)
    for at, c, depth in found:
        if depth == 0 and c in "[{":
            begin, state[4] = at + 1, True
        elif depth == 1 and c in ",]}":
            state[3].append(text[begin:at])
            rows.append((path, state[2], block, "".join(state[3]), c, state[4]))
            state[2], state[3], state[4] = state[2] + 1, [], True
            begin = at + 1 if c == "," else len(text)
    state[1] = after
    if begin < len(text):
        state[3].append(text[begin:])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def array_entries(spark: SparkSession, path: str | list[str], glob: str | None = None) -> DataFrame:
    """Entries of every JSON array file below ``path``: file_path, pos (from 0), raw and closed_by.

    ``raw`` is the text of an entry, whatever it is; ``closed_by`` the comma or bracket behind it, empty where the file ends before. A file
    that does not begin like an array gives one row with pos -1, its beginning as ``raw`` and ``not_array``. An empty array and a file of no
    bytes give no row.
    """
    conf = spark._jsparkSession.sessionState().conf()
    whole_bytes = min(conf.filesOpenCostInBytes(), conf.filesMaxPartitionBytes())  # smaller files have one range
    reader = spark.read.option("recursiveFileLookup", True).option("lineSep", "}")
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    meta = {c: F.col(f"_metadata.{c}") for c in ("file_path", "file_size", "file_block_start", "file_block_length")}
    lines = reader.text(path)
    named = ["value", meta["file_path"].alias("file_path"), meta["file_block_start"].alias("block")]
    several = (meta["file_size"] > whole_bytes) & (meta["file_block_length"] < meta["file_size"])
    summaries = lines.where(several).select(*named).mapInArrow(_summaries, _SUMMARY)
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)

    def total(column: str) -> Column:
        return F.coalesce(F.sum(F.expr(column)).over(before), F.lit(0))

    placed = settle(
        summaries.withColumn("inside", total("flips") % 2)
        .withColumn("depth", total("if(inside = 0, delta0, delta1)"))
        .withColumn("n", F.expr("coalesce(element_at(if(inside = 0, ends0, ends1), 1 - depth), 0L)"))
        .withColumn("number", total("n"))
        .withColumn("opens", F.max("opens").over(Window.partitionBy("file_path")))
        .select("file_path", "block", F.col("inside").cast("int"), "depth", "number", "opens")
    )
    ranges = placed.count()
    if ranges > BROADCAST_ROWS:
        raise ValueError(f"{ranges} ranges: raise spark.sql.files.maxPartitionBytes")
    started = lines.select(*named).join(F.broadcast(placed), ["file_path", "block"], "left").na.fill(0, ["inside", "depth", "number"])
    found = started.select("value", "file_path", "block", "inside", "depth", "number", "opens").mapInArrow(_entries, _ENTRY)
    columns = ["file_path", "pos", "raw", "closed_by"]
    if ranges:
        found = settle(found)
        pieces = found.where("NOT whole").groupBy("file_path", "pos").agg(
            F.array_sort(F.collect_list(F.struct("block", "raw", "closed_by"))).alias("p")
        )
        joined = pieces.select("file_path", "pos", F.array_join("p.raw", "").alias("raw"), F.element_at("p", -1)["closed_by"].alias("closed_by"))
        found = found.where("whole").select(*columns).unionByName(joined)
    return found.select(*columns).where(~((F.col("pos") == 0) & (F.col("closed_by") == "]") & ~F.col("raw").rlike(r"\S")))
