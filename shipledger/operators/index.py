"""The release index: upsert, comparison with the documents, order and duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.functions.versions import release_key
from shipledger.operators.dimension import join_dimension
from shipledger.operators.found import explode_found
from shipledger.operators.succession import with_next
from shipledger.session import settle

KEY = ["product", "build_number"]


def upsert_index(index: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of ``new`` replace those of the same product and build; the rest stays.

    ``write_index`` puts the result into version order.
    """
    kept = index.join(new.select(*KEY).distinct(), KEY, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def index_diff(index: DataFrame, catalog: DataFrame) -> DataFrame:
    """Builds that only the index or only the catalogue has."""
    i, c = index.select(*KEY).distinct(), catalog.select(*KEY).distinct()
    only_catalog = c.join(i, KEY, "left_anti").withColumn("side", F.lit("catalog"))
    only_index = i.join(c, KEY, "left_anti").withColumn("side", F.lit("index"))
    return only_catalog.unionByName(only_index)


def parity_check(index: DataFrame, catalog: DataFrame, fields: list[str]) -> DataFrame:
    """Fields that differ between index and catalogue, one row per build and field."""

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEY, F.struct(*[F.col(f).cast("string").alias(f) for f in fields]).alias(name))

    met = side(index, "i").join(side(catalog, "c"), KEY)
    checks = [
        F.when(
            ~F.col(f"i.{f}").eqNullSafe(F.col(f"c.{f}")),
            F.struct(
                F.lit(f).alias("field"),
                F.col(f"i.{f}").alias("index_value"),
                F.col(f"c.{f}").alias("catalog_value"),
            ),
        )
        for f in fields
    ]
    listed = met.select(*KEY, F.array_compact(F.array(*checks)).alias("m"))
    return explode_found(listed, "m", KEY, "m").select(*KEY, "m.*")


def index_order_check(index: DataFrame, key: Column | None = None) -> DataFrame:
    """First position per product where the index is not in order (newest version first).

    ``index`` has ``pos``. Result: product, position, actual build, expected build; no row
    for an ordered index.

    The sorted index is never numbered. The rows before the first inversion are in order,
    so the first wrong place is where the highest later row would belong: the first row
    below that one. Everything but finding neighbours is an aggregate; what is found per product, a row
    each, meets the rows by ``join_dimension``.
    """
    rows = settle(
        index.select("product", "build_number", "pos", (release_key() if key is None else key).alias("_key"))
    )
    following = with_next(rows, ["product"], [F.col("pos").asc()], ["_key"])
    inversions = (
        following.where(F.col("_key") < F.col("next._key"))
        .groupBy("product")
        .agg(F.min("pos").alias("_last"))
    )
    placed = join_dimension(rows, inversions, ["product"])
    best = (
        placed.where(F.col("pos") > F.col("_last"))
        .groupBy("product")
        .agg(
            F.max(F.struct("_key", -F.col("pos"))).alias("_top"),
            F.max_by("build_number", F.struct("_key", -F.col("pos"))).alias("expected"),
        )
    )
    wrong = join_dimension(placed, best, ["product"]).where(
        (F.col("pos") <= F.col("_last")) & (F.col("_key") < F.col("_top._key"))
    )
    first = wrong.groupBy("product", "expected").agg(
        F.min("pos").alias("_pos"), F.min_by("build_number", "pos").alias("actual")
    )
    before = (
        join_dimension(rows, first, ["product"])
        .where(F.col("pos") < F.col("_pos"))
        .groupBy("product")
        .agg(F.count("*").alias("position"))
    )
    return first.join(before, "product", "left").select(
        "product", F.coalesce("position", F.lit(0)).alias("position"), "actual", "expected"
    )


def duplicate_check(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
