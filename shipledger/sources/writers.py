"""Writers for release documents, indexes and published datasets."""

from __future__ import annotations

import uuid
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, DataFrameWriter, SparkSession, Window
from pyspark.sql import functions as F

from shipledger.functions.versions import release_key
from shipledger.schema import index_row
from shipledger.session import settle


def _sorted_struct(df: DataFrame) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])


def _compressed(writer: DataFrameWriter, compression: str | None) -> DataFrameWriter:
    return writer if compression is None else writer.option("compression", compression)


def write_releases(documents: DataFrame, out: str, fmt: str = "json", compression: str | None = None) -> None:
    """Documents below ``product=…/major=…``; null fields are left out of JSON.

    Many documents share a file, so a large catalogue does not become as many small files. ``compression`` names a
    codec of the format, which readers tell by the file name.
    """
    major = F.regexp_extract("osVersion", "[^.]+", 0)
    placed = documents.drop("file_path", "data_file", "build_number").withColumn("major", major)
    _compressed(placed.write.mode("overwrite"), compression).partitionBy("product", "major").format(fmt).save(out)


def write_document_files(documents: DataFrame, out: str) -> None:
    """One JSON document per file at ``<product>/<data_file>``-like partitions.

    For exchange with tools that expect a file per release: each release is a partition
    folder holding one text file.
    """
    texts = documents.select("product", "build_number", F.to_json(_sorted_struct(documents)).alias("value"))
    texts.repartition("product", "build_number").write.mode("overwrite").partitionBy(
        "product", "build_number"
    ).text(out)


def index_json(index: DataFrame) -> DataFrame:
    """Index entries as JSON lines, newest version first, keys in order."""
    rows = index.select(release_key().alias("_key"), *index_row())
    names = sorted(c for c in rows.columns if c != "_key")
    return rows.orderBy(F.col("_key").desc()).select(
        F.to_json(F.struct(*names)).alias("value")
    )


def _paths(spark: SparkSession, base: str):
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path
    files = path(base).getFileSystem(spark._jsc.hadoopConfiguration())
    return jvm, path, files


#: Index entries that a range of the index holds, about.
RANGE_ROWS = 500_000
#: Ranges of an index, about. Beyond, ranges hold more rows, so that folders, manifest and what the driver lists of them stay bounded.
MAX_RANGES = 1_000
KEY = ["product", "build_number"]
_MANIFEST = "folder string, low struct<product:string,build_number:string>, high struct<product:string,build_number:string>, rows long"


def _swap(spark: SparkSession, base: str, version: str) -> None:
    """Make ``version`` current: the pointer file ``CURRENT`` is replaced by one rename."""
    jvm, path, files = _paths(spark, base)
    draft, current = path(f"{base}/CURRENT.{uuid.uuid4().hex}"), path(f"{base}/CURRENT")
    stream = files.create(draft, True)
    stream.write(bytearray(version, "utf-8"))
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        current.toUri(), spark._jsc.hadoopConfiguration()
    )
    overwrite = spark.sparkContext._gateway.new_array(
        getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 1
    )
    overwrite[0] = getattr(jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(draft, current, overwrite)


def _write_ranges(rows: DataFrame, base: str, version: str) -> DataFrame:
    """Write ``rows`` below folders by their column ``_range``; gives the manifest of these folders."""
    out = f"{base}/v-{version}"
    rows.write.mode("errorifexists").partitionBy("_range").parquet(out)
    key = F.struct(*KEY)
    written = rows.sparkSession.read.schema(rows.schema).parquet(out)
    return written.groupBy("_range").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.count("*").alias("rows")).select(
        F.concat(F.lit(f"v-{version}/_range="), F.col("_range").cast("string")).alias("folder"), "low", "high", "rows"
    )


def _finish(manifest: DataFrame, base: str, version: str) -> str:
    """Write the manifest of a version, make it current and remove what neither it nor the one before names."""
    spark = manifest.sparkSession
    manifest.coalesce(1).write.mode("errorifexists").parquet(f"{base}/m-{version}")
    _swap(spark, base, version)
    _, path, files = _paths(spark, base)
    listed = [(s.getModificationTime(), s.getPath().getName()) for s in files.listStatus(path(base))]
    manifests = sorted(x for x in listed if x[1].startswith("m-") and x[1] != f"m-{version}")
    kept = [f"m-{version}", *(name for _, name in manifests[-1:])]
    # Old versions stay while a current one names one of their ranges.
    used = {
        r["v"]
        for r in spark.read.schema(_MANIFEST).parquet(*[f"{base}/{m}" for m in kept]).select(F.split("folder", "/")[0].alias("v")).distinct().collect()
    }
    for _, name in listed:
        if (name.startswith("m-") and name not in kept) or (name.startswith("v-") and name not in used):
            files.delete(path(f"{base}/{name}"), True)
    return version


def _rows_of_range(total: int, range_rows: int) -> int:
    """Rows of a range in an index of ``total`` rows."""
    return max(range_rows, -(-total // MAX_RANGES))


def write_index(index: DataFrame, base: str, range_rows: int = RANGE_ROWS) -> str:
    """Write a new version of the whole index below ``base`` and make it current.

    Entries are range-partitioned by product and build into folders of about ``range_rows`` (more, if these were above
    ``MAX_RANGES`` folders), which a manifest lists with their least and greatest key. Everything is written completely before the pointer file
    ``CURRENT`` is replaced by a rename, so readers see the old or the new index, never a
    part. The version before stays for its readers. The store must rename atomically. :func:`merge_index` writes changes.
    """
    version = uuid.uuid4().hex
    total = index.count()
    count = max(1, -(-total // _rows_of_range(total, range_rows)))
    sliced = index.repartitionByRange(count, *KEY).withColumn("_range", F.spark_partition_id()).sortWithinPartitions("_range", *KEY)
    return _finish(_write_ranges(sliced, base, version), base, version)


def merge_index(new: DataFrame, base: str, range_rows: int = RANGE_ROWS) -> str:
    """Entries of ``new`` (one per build) replace those of the same product and build in the index below ``base``.

    Only ranges that a new key belongs to are read and written again; the folders of all others stay as they are and the new manifest names
    them. A range that has grown above twice ``range_rows`` (or what :func:`write_index` takes instead) is split. Without an index, for
    more rows than half of it, or when it has come to twice ``MAX_RANGES`` ranges, the index is written as a whole. ``new`` may lack columns of the index, and have others.
    """
    spark = new.sparkSession
    version = current_version(spark, base)
    if version is None:
        return write_index(new, base, range_rows)
    manifest = settle(spark.read.schema(_MANIFEST).parquet(f"{base}/m-{version}"))
    total = manifest.agg(F.sum("rows")).first()[0] or 0
    # One row per range; a key belongs to the last range that starts at or before it, keys before all ranges to the first.
    lows = [(r["low"]["product"] or "", r["low"]["build_number"] or "") for r in manifest.orderBy("low").select("low").collect()]
    shared = spark.sparkContext.broadcast(lows)

    @F.pandas_udf("int")
    def range_of(product: pd.Series, build: pd.Series) -> pd.Series:
        keys = zip(product.fillna(""), build.fillna(""))
        return pd.Series([max(0, bisect_right(shared.value, key) - 1) for key in keys], dtype="int32")

    placed = settle(new.withColumn("_range", range_of(*KEY)))
    new, added = placed.drop("_range"), placed.count()
    if 2 * added > total or len(lows) > 2 * MAX_RANGES:
        old = read_index(spark, base).join(new.select(*KEY).distinct(), KEY, "left_anti")
        return write_index(old.unionByName(new, allowMissingColumns=True), base, range_rows)
    range_rows = _rows_of_range(total + added, range_rows)
    ordered = manifest.withColumn("_range", F.row_number().over(Window.orderBy("low")) - 1)
    touched = settle(ordered.join(placed.groupBy("_range").agg(F.count("*").alias("_added")), "_range"))
    folders = [f"{base}/{r['folder']}" for r in touched.select("folder").collect()]
    # The folder of an old row tells its range.
    name = F.regexp_extract("_metadata.file_path", "(v-[^/]+/_range=[^/]+)/[^/]+$", 1)
    named = F.broadcast(touched.select(F.col("folder").alias("_folder"), "_range"))
    old = _read_folders(spark, folders).withColumn("_folder", name).join(named, "_folder").drop("_folder")
    old = old.join(new.select(*KEY), KEY, "left_anti")
    rows = old.unionByName(placed, allowMissingColumns=True)
    # Only ranges that the new rows may have made too large are counted.
    large = touched.where(F.col("rows") + F.col("_added") > 2 * range_rows).select("_range")
    grown = None
    if not large.isEmpty():
        counts = rows.join(F.broadcast(large), "_range", "left_semi").groupBy("_range").agg(F.count("*").alias("_rows"))
        sizes = counts.withColumn("_parts", F.ceil(F.col("_rows") / range_rows))
        grown = settle(sizes.where(F.col("_rows") > 2 * range_rows))
    if grown is None or grown.isEmpty():
        cut = rows.withColumn("_range", F.concat_ws("-", "_range", F.lit(0)))
    else:
        # Only rows of grown ranges are numbered.
        place = F.row_number().over(Window.partitionBy("_range").orderBy(*KEY)) - 1
        part = F.floor(place * F.col("_parts") / F.col("_rows"))
        split = rows.join(F.broadcast(grown), "_range").withColumn("_range", F.concat_ws("-", "_range", part)).drop("_parts", "_rows")
        whole = rows.join(F.broadcast(grown), "_range", "left_anti").withColumn("_range", F.concat_ws("-", "_range", F.lit(0)))
        cut = whole.unionByName(split)
    changed = uuid.uuid4().hex
    fresh = _write_ranges(cut.repartition("_range").sortWithinPartitions("_range", *KEY), base, changed)
    kept = manifest.join(touched.select("folder"), "folder", "left_anti")
    return _finish(kept.unionByName(fresh), base, changed)


def current_version(spark: SparkSession, base: str) -> str | None:
    """The name of the current version of the index below ``base``; None when there is none yet."""
    _, path, files = _paths(spark, base)
    if not files.exists(path(f"{base}/CURRENT")):
        return None
    return spark.read.text(f"{base}/CURRENT").first()["value"]


def _read_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*folders)


def read_index(spark: SparkSession, base: str) -> DataFrame | None:
    """The current index below ``base``; None when there is none yet.

    A pointer to a missing or broken version raises, so a damaged index is never replaced
    by a rewrite.
    """
    version = current_version(spark, base)
    if version is None:
        return None
    # One name per range.
    manifest = spark.read.parquet(f"{base}/m-{version}")
    folders = [f"{base}/{r['folder']}" for r in manifest.select("folder").collect()]
    if not folders:
        return spark.read.parquet(f"{base}/v-{version}").drop("_range")
    return _read_folders(spark, folders)


def publish(df: DataFrame, name: str, out: str, by: list[str] | None = None, compression: str | None = None) -> None:
    """Publish a dataset as JSON lines with sorted keys below ``out/name``.

    ``by`` names the columns that split the dataset into folders, ``compression`` a codec such as ``gzip``.
    """
    by = by or []
    text = df.select(*by, F.to_json(_sorted_struct(df)).alias("value"))
    writer = _compressed(text.write.mode("overwrite"), compression)
    (writer.partitionBy(*by) if by else writer).text(f"{out}/{name}")


def fingerprint(*inputs: DataFrame) -> str:
    """A text that tells whether tables have changed: number and summed hashes of their rows, whatever their order."""
    parts = []
    for df in inputs:
        # Hashes are added as decimals of their halves, which cannot overflow.
        row = F.xxhash64(F.lit(",".join(df.columns)), *[F.col(f"`{c}`") for c in df.columns])
        sums = df.select(row.alias("h")).agg(
            F.count("*").alias("n"),
            F.sum(F.expr("CAST(h & 4294967295 AS DECIMAL(38, 0))")).alias("low"),
            F.sum(F.expr("CAST(shiftrightunsigned(h, 32) AS DECIMAL(38, 0))")).alias("high"),
        )
        parts.append("-".join(str(x or 0) for x in sums.first()))
    return "+".join(parts)


def publish_current(df: DataFrame, name: str, out: str, by: list[str] | None = None, of: str | None = None) -> bool:
    """Publish like :func:`publish`, into a new folder below ``out/name`` that becomes current by one rename.

    Readers, who take the folder from :func:`published`, see the old or the new dataset; the one before stays for those who still read it. ``of`` is the
    :func:`fingerprint` of what the dataset is made from: if the current one was made from the same, nothing is computed or written, and the result
    is False. A publish that ends early leaves the current dataset as it was.
    """
    spark, base = df.sparkSession, f"{out}/{name}"
    known = _published(spark, out, name)
    if of is not None and known is not None and known[1] == of:
        return False
    version = f"v-{uuid.uuid4().hex}"
    publish(df, version, base, by)
    _swap(spark, base, f"{version} {of or ''}")
    _, path, files = _paths(spark, base)
    keep = {version, known and known[0]}
    for s in files.listStatus(path(base)):
        if s.getPath().getName().startswith("v-") and s.getPath().getName() not in keep:
            files.delete(s.getPath(), True)
    return True


def _published(spark: SparkSession, out: str, name: str) -> tuple[str, str] | None:
    found = current_version(spark, f"{out}/{name}")
    return None if found is None else tuple(found.split(" ", 1))


def published(spark: SparkSession, out: str, name: str) -> str | None:
    """The folder of the current dataset ``name``; None when there is none yet."""
    found = _published(spark, out, name)
    return None if found is None else f"{out}/{name}/{found[0]}"
