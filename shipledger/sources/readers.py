"""Readers for release documents, indexes, artifacts and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shipledger.schema import INDEX_ENTRY, RELEASE_DOCUMENT, release_columns, with_defaults
from shipledger.sources.arrays import array_entries
from shipledger.sources.forms import document_texts, is_document


REQUIRED = ("osVersion", "buildNumber", "releaseName")


def _scanned(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """Every text below a folder that stands for a document: file_path, text, document ``d`` and reason of a reject."""
    texts = document_texts(spark, path, glob).select("file_path", "text")
    parsed = texts.withColumn("d", F.when(is_document(), F.from_json("text", RELEASE_DOCUMENT)))
    reason = F.when(~is_document(), "invalid_json")
    for name in REQUIRED:
        reason = reason.when(F.col(f"d.{name}").isNull(), name)
    return parsed.withColumn("reason", reason)


def scan_releases(
    spark: SparkSession, path: str, product: str | None = None, glob: str = "*.json"
) -> DataFrame:
    """All release documents below a folder, one per file or one per line.

    ``glob`` chooses files by name. ``data_path`` is the path of the file below the folder, for :func:`load_indexed`.
    A document that lacks a required field or is not JSON is left out here and given by
    :func:`scan_rejected`.
    """
    documents = with_defaults(_scanned(spark, path, glob).where("reason IS NULL").select("d.*", "file_path"))
    if product is not None:
        documents = documents.where(F.col("product") == product)
    return documents


def scan_rejected(spark: SparkSession, path: str, glob: str = "*.json") -> DataFrame:
    """Documents that :func:`scan_releases` leaves out: file_path, reason and text.

    ``reason`` is ``invalid_json`` or names the first required field that is missing. Both readers
    take their rows from the same texts, so each document is in one of them.
    """
    return _scanned(spark, path, glob).where("reason IS NOT NULL").select("file_path", "reason", "text")


def scan_release_lines(
    spark: SparkSession,
    path: str,
    product: str | None = None,
    major: int | None = None,
    fmt: str = "json",
) -> DataFrame:
    """Documents as ``write_releases`` leaves them, below product and major folders.

    ``product`` and ``major`` choose folders, so that others are not read.
    """
    raw = spark.read.schema(RELEASE_DOCUMENT).format(fmt).load(path)
    if product is not None:
        raw = raw.where(F.col("product") == product)
    if major is not None:
        raw = raw.where(F.col("major").try_cast("int") == major)
    return with_defaults(raw.drop("product"))


def flat_releases(documents: DataFrame) -> DataFrame:
    """Flat identity columns of documents, with file, link and minimum OS version."""
    xcode = F.col("product") == "Xcode"
    return documents.select(
        *release_columns(),
        F.when(xcode, F.col("xipFile")).otherwise(F.col("ipswFile")).alias("file"),
        F.when(xcode, F.col("xipURL")).otherwise(F.col("ipswURL")).alias("url"),
        F.col("minimumOSVersion").alias("minimum_os_version"),
    )


def scan_index_entries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of ``releases.json`` arrays as they stand there: file_path, pos, raw and the ``reason`` of a reject.

    Arrays of any size are read in splits (see ``arrays``). ``reason`` is ``not_array`` for a file that is no array (``pos`` is -1), ``not_closed``
    for the last entry of an array without its end, ``invalid_json`` for an entry that is not one JSON object, or the first required
    field that is missing.
    """
    entries = array_entries(spark, path)
    whole = is_document("raw")
    parsed = entries.withColumn("e", F.when(whole, F.from_json("raw", INDEX_ENTRY)))
    reason = (
        F.when(F.col("closed_by") == "not_array", "not_array").when(F.col("closed_by") == "", "not_closed").when(~whole, "invalid_json")
    )
    for name in (*REQUIRED, "dataFile"):
        reason = reason.when(F.col(f"e.{name}").isNull(), name)
    return parsed.select("file_path", "pos", F.btrim("raw", F.lit(" \t\r\n")).alias("raw"), reason.alias("reason"), "e")


def scan_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Entries of ``releases.json`` arrays with their position, those that :func:`scan_index_rejected` gives left out.

    Positions count all entries of a file, rejected ones too. An index in the Parquet form of ``write_index`` stores ``pos``.
    """
    return scan_index_entries(spark, path).where("reason IS NULL").select("e.*", "pos").select(
        *release_columns(),
        F.col("dataFile").alias("data_file"),
        F.col("pos").cast("bigint").alias("pos"),
        F.concat_ws("-", "osVersion", "buildNumber").alias("id"),
    )


def scan_index_rejected(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """What :func:`scan_index` leaves out: file_path, pos, reason and raw text."""
    return scan_index_entries(spark, path).where("reason IS NOT NULL").select("file_path", "pos", "reason", "raw")


def unsafe_data_file(column: str = "data_file") -> Column:
    """True for a path that could leave the data folder."""
    return F.coalesce(F.col(column).contains(".."), F.lit(True))


def load_indexed(index: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Index entries with their documents, and the entries that were refused.

    ``documents`` carries ``data_file``, its path below the product folder (see
    :func:`relative_data_file`). Entries without a document keep a null ``document``.
    """
    rows = documents.select(
        "product", "data_file", F.struct(*[c for c in documents.columns if c != "data_file"]).alias("document")
    )
    loaded = index.where(~unsafe_data_file()).join(rows, ["product", "data_file"], "left")
    return loaded, index.where(unsafe_data_file())


def relative_data_file(documents: DataFrame) -> DataFrame:
    """Add ``data_file``: the file path from its ``releases`` folder on."""
    return documents.withColumn(
        "data_file", F.regexp_extract(F.try_url_decode("file_path"), r"(releases/[^/]+/[^/]+)$", 1)
    )


def scan_artifacts(
    spark: SparkSession, path: str, exts: list[str] | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Files as (path, modificationTime, length, content).

    The extension filter works on file names in any case; the size filter reaches the
    source, which then never opens larger files. Hidden files are skipped by the source.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if exts:
        ending = [
            "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in ext) for ext in exts
        ]
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(ending) + "}")
    files = reader.load(path)
    return files if max_bytes is None else files.where(F.col("length") <= max_bytes)


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files as (path, value)."""
    texts = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), "value")


def scan_sdk_settings(spark: SparkSession, path: str) -> DataFrame:
    """SDK folders and versions from the ``SDKSettings.json`` files below a folder."""
    settings = (
        spark.read.schema(T.StructType([T.StructField("Version", T.StringType())]))
        .option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "SDKSettings.json")
        .json(path)
    )
    folder = F.regexp_extract(F.try_url_decode(F.col("_metadata.file_path")), "^(.*)/[^/]*$", 1)
    return settings.select(folder.alias("sdk_dir"), F.col("Version").alias("version"))


def scan_raw_documents(spark: SparkSession, path: str) -> DataFrame:
    """Documents as raw text with their file name, for the quality rules."""
    texts = (
        spark.read.option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.json")
        .text(path, wholetext=True)
    )
    name = F.substring_index(F.try_url_decode(F.col("_metadata.file_path")), "/", -1)
    return texts.select(name.alias("file_name"), F.col("value").alias("raw"))
