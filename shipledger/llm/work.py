"""Tables between jobs, and row numbers without one big window."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def workspace(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a session without that setting (tests) gets a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        key = spark.sparkContext.applicationId
        folder = _own.setdefault(key, tempfile.mkdtemp(prefix="shipledger-work-"))
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{workspace(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows of ``df`` as a Parquet table in the workspace.

    Later jobs read the table, so a lost executor costs a task, not the jobs before, and
    values that a recomputation could change (partition numbers) are fixed.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(name: str, columns: list[str]) -> str:
    """``name``, longer if ``columns`` have it in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, run, added: dict[str, str], keep: int | None = None) -> DataFrame:
    """``df.mapInArrow(run)`` for columns of any names, dots included; ``run`` sees and gives them by position.

    ``added`` names the new columns and their types; of the columns of ``df`` the first ``keep`` stay.
    """
    fields = df.schema.fields
    names = [f"_column_{i}" for i in range(len(fields))]
    kept = list(zip(names, (f.dataType.simpleString() for f in fields)))[:keep]
    schema = ", ".join(f"`{n}` {k}" for n, k in [*kept, *added.items()])
    return df.toDF(*names).mapInArrow(run, schema).toDF(*df.columns[:keep], *added)


def slices(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def numbered(df: DataFrame, keys: list[str], order: list[Column], into: str) -> DataFrame:
    """Add ``into``: the place of a row, from 0 and without gaps, among the rows of its ``keys``.

    Rows are range-partitioned on keys and order, so that a key of any size spreads over
    many slices. A window numbers the rows inside a slice; what comes before a slice is
    added from a table with one row per slice and key found in it.
    """
    count = slices(df.sparkSession)
    ranges = [F.col(k).asc() for k in keys] + list(order)
    sliced = written(
        df.repartitionByRange(count, *ranges)
        .sortWithinPartitions(*ranges)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id()),
        "numbered",
    )
    parts = sliced.groupBy("_slice", *keys).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        "_slice", *keys, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    inside = F.row_number().over(Window.partitionBy("_slice", *keys).orderBy("_at")) - 1
    left, right = sliced.withColumn("_inside", inside).alias("l"), offsets.alias("r")
    same = F.col("l._slice") == F.col("r._slice")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    return left.join(right, same).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("r._before") + F.col("l._inside")).cast("long").alias(into),
    )
