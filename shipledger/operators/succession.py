"""The next row in a sorted sequence, for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipledger.session import settle

#: Rows of a group up to which one task sorts it whole; larger groups are sliced.
GROUP_ROWS = 1_000_000


def with_next(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    payload: list[str],
    into: str = "next",
    slices: int | None = None,
) -> DataFrame:
    """Add struct ``into`` with ``payload`` of the following row of the same ``keys``.

    A window over ``keys`` alone would put a whole group into one task. Here the rows are
    range-partitioned on keys and order together, so a large group spreads over many
    slices; the window only looks inside a slice. Rows at the end of a slice take the first
    row of the next one from a table with one row per slice, whose size is the number of
    slices whatever the data. ``order`` should tell all rows of a key apart, as rows that are
    equal in it stay in one slice.
    """
    spark = df.sparkSession
    count = slices or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = [F.col(k).asc() for k in keys] + list(order)
    sliced = settle(
        df.repartitionByRange(count, *ranges)
        .sortWithinPartitions(*ranges)
        .withColumn("_slice", F.spark_partition_id())
        .withColumn("_at", F.monotonically_increasing_id())
    )
    key = F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))
    row = F.struct(*[F.col(p) for p in payload])

    heads = sliced.groupBy("_slice").agg(
        F.min_by(F.struct(key.alias("key"), row.alias("row")), "_at").alias("head")
    )
    following = heads.select(
        "_slice", F.lead("head").over(Window.orderBy("_slice")).alias("_following")
    )
    inside = F.lead(row).over(Window.partitionBy("_slice", *keys).orderBy("_at"))
    return (
        sliced.withColumn(into, inside)
        .join(F.broadcast(following), "_slice", "left")
        .withColumn(
            into,
            F.coalesce(
                F.col(into),
                F.when(F.col("_following.key") == key, F.col("_following.row")),
            ),
        )
        .drop("_slice", "_at", "_following")
    )


def with_next_in_groups(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    payload: list[str],
    into: str = "next",
    group_rows: int = GROUP_ROWS,
) -> DataFrame:
    """As :func:`with_next`, for many groups of which few or none are large.

    Groups are counted first. A window takes all groups of up to ``group_rows`` rows; only larger ones
    go through range slices, which sample, sort and shuffle their rows once more.
    """
    placed = settle(df)
    large = placed.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > group_rows)
    large = settle(large.select(*keys))
    # Sorting compares a number first; texts are read only inside a group.
    group = Window.partitionBy(F.xxhash64(*keys), *keys).orderBy(*order)
    row = F.struct(*[F.col(p) for p in payload])
    if large.isEmpty():
        return placed.withColumn(into, F.lead(row).over(group))
    # There are at most rows / group_rows large groups. A null key joins none of them and stays with the small ones.
    small = placed.join(F.broadcast(large), keys, "left_anti").withColumn(into, F.lead(row).over(group))
    sliced = with_next(placed.join(F.broadcast(large), keys, "left_semi"), keys, order, payload, into)
    return small.unionByName(sliced)
