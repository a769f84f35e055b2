"""JSON texts of files that hold one document over any number of lines, or one per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.session import settle

#: Files up to this size are read as one value; larger ones by line, in splits.
WHOLE_BYTES = 32 << 20
#: A text is a value, so no longer file can be one document.
VALUE_BYTES = (1 << 31) - (1 << 20)

#: Large files up to which the table of those that are one document is broadcast, a row each.
BROADCAST_ROWS = 500_000

WHERE = ["file_path", "file_modification_time"]


def one_value(text: str) -> str:
    """SQL that is true when ``text`` is one JSON object or array and nothing behind it.

    The parsers of Spark stop at the end of the first value; put into an array and into an
    object, a text with more than one value breaks one of the two.
    """
    opened = rf"{text} RLIKE r'^\s*[\x7b\x5b]'"
    in_array = f"json_array_length(concat('[', {text}, ']')) = 1"
    in_object = "size(json_object_keys(concat('{\"d\":', " + text + ", '}'))) = 1"
    return f"coalesce({opened} AND {in_array} AND {in_object}, false)"


def _texts(small: DataFrame) -> DataFrame:
    """Texts of whole files (``value``): the file, if it is one JSON value or nothing in it is, else its lines."""
    lines = F.filter(F.split("value", "\r\n|\r|\n"), lambda line: line.rlike(r"\S"))
    # A broken document over several lines stays together: no line of it is a document by itself.
    whole = F.expr(
        f"size(lines) = 0 OR {one_value('value')}"
        rf" OR (value RLIKE r'^\s*[\x7b\x5b]' AND NOT exists(lines, l -> {one_value('l')}))"
    )
    listed = small.withColumn("lines", lines).withColumn("lines", F.when(whole, F.array("value")).otherwise(F.col("lines")))
    return listed.select(*WHERE, F.lit(0).cast("long").alias("block"), F.posexplode("lines").alias("line", "text")).withColumn(
        "line", F.col("line").cast("long")
    )


def _one_document(lines: DataFrame) -> DataFrame:
    """Paths of files of ``lines`` that can be one document over several lines; a row per file.

    In one value, the first line is no value by itself, the last line closes it, and behind each line that is a value
    by itself comes a line that starts with a closing bracket or a comma. A file that opens a value and has no line that is one
    stays together too, as a broken document does in a smaller file.
    """
    place = F.struct("block", "line")
    return (
        lines.where(F.col("file_size") < VALUE_BYTES)
        .withColumn("_one", F.expr(one_value("value")))
        .groupBy("file_path")
        .agg(
            F.min_by(F.col("value").rlike(r"^\s*[{\[]") & ~F.col("_one"), place).alias("opens"),
            F.max_by(F.col("value").rlike(r"[}\]]\s*$"), place).alias("closes"),
            F.count_if("_one").alias("values"),
            F.count_if(F.col("value").rlike(r"^\s*[}\],]")).alias("behind"),
        )
        .where("opens AND (values = 0 OR (closes AND behind >= values))")
        .select("file_path", F.lit(True).alias("one"))
    )


def document_texts(
    spark: SparkSession, path: str | list[str], glob: str | None = None, whole_bytes: int = WHOLE_BYTES
) -> DataFrame:
    """Texts of all JSON documents in the files below ``path``, broken ones too.

    Columns: file_path, file_modification_time, the place in the file (block, line, item; in this order) and text.
    A file that is one JSON value is one text, any other gives its lines that are not blank, each for itself. An
    array gives its elements. Files above ``whole_bytes`` are read by line in splits and only put together where they can
    be one document, with the same texts as a smaller file; above 2 GiB, where they can be no value, they give their lines. Files are UTF-8, with or without a byte order mark.
    """

    def read(whole: bool) -> DataFrame:
        reader = spark.read.option("recursiveFileLookup", True)
        if glob is not None:
            reader = reader.option("pathGlobFilter", glob)
        texts = reader.text(path, wholetext=whole)
        size = F.col("_metadata.file_size")
        return texts.where(size <= whole_bytes if whole else size > whole_bytes).select(
            *[f"_metadata.{c}" for c in (*WHERE, "file_size")],
            F.col("_metadata.file_block_start").alias("block"),
            F.regexp_replace("value", "^﻿", "").alias("value"),
        )

    # Lines of a split have ascending numbers; only the lines of one split are compared by them.
    lines = read(False).withColumn("line", F.monotonically_increasing_id()).where(F.col("value").rlike(r"\S"))
    one = settle(_one_document(lines))
    marked = lines.join(F.broadcast(one) if one.count() <= BROADCAST_ROWS else one, "file_path", "left")
    joined = (
        marked.where("one")
        .groupBy(*WHERE)
        .agg(F.array_sort(F.collect_list(F.struct("block", "line", "value"))).alias("lines"))
        .select(*WHERE, F.array_join("lines.value", "\n").alias("value"))
    )
    texts = (
        _texts(read(True).select(*WHERE, "value").unionByName(joined))
        .unionByName(marked.where("one IS NULL").select(*WHERE, "block", "line", F.col("value").alias("text")))
    )
    elements = F.when(F.expr(rf"text RLIKE r'^\s*\x5b' AND {one_value('text')}"), F.from_json("text", "array<string>"))
    items = F.when(F.size(elements) > 0, F.transform(elements, lambda e: F.coalesce(e, F.lit("null")))).otherwise(F.array("text"))
    return texts.select(*WHERE, "block", "line", F.posexplode(items).alias("item", "text"))


def is_document(text: str = "text") -> Column:
    """True for a text that is one JSON object."""
    return F.expr(rf"{text} RLIKE r'^\s*\x7b' AND {one_value(text)}")
