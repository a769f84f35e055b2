"""Differences between the component lists of releases.

``components`` needs product, build_number, ord, name and version. A release is named by
(product, build_number). The result is one long table: product, from_build, to_build, name,
from_version, to_version and status (upgraded, downgraded, unchanged, added, removed).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.functions.versions import with_direction
from shipledger.operators.dimension import BROADCAST_ROWS, join_dimension
from shipledger.operators.succession import with_next
from shipledger.session import settle

PAIR = ["product", "from_build", "to_build"]


def _diff(sided: DataFrame, keys: list[str]) -> DataFrame:
    """Meet both sides of a pair in one grouping instead of a full outer join.

    The first entry of a name counts, so repeated names collapse during partial
    aggregation, before the shuffle.
    """

    def first(side: str) -> Column:
        return F.min_by(F.struct("version"), F.when(F.col("side") == side, F.col("ord")))

    met = sided.groupBy(*keys, "name").agg(first("from").alias("f"), first("to").alias("t"))
    was, now = F.col("f").isNotNull(), F.col("t").isNotNull()
    versions = met.select(
        *keys,
        "name",
        F.when(was, F.coalesce("f.version", F.lit(""))).alias("from_version"),
        F.when(now, F.coalesce("t.version", F.lit(""))).alias("to_version"),
    )
    status = F.when(F.col("from_version").isNull(), "added").when(
        F.col("to_version").isNull(), "removed"
    )
    return with_direction(versions, "from_version", "to_version", "status").withColumn(
        "status", status.otherwise(F.col("status"))
    )


def compare_many(components: DataFrame, pairs: DataFrame) -> DataFrame:
    """All requested pairs in one job; ``pairs`` has product, from_build and to_build.

    Only the columns needed travel, and for a pair a number, which meets its builds again behind the
    grouping. ``pairs`` meets the components by ``join_dimension``: the shuffle on (pair, name) is the
    only one of the facts, as long as the pairs are few; beyond, pairs travel by their builds.
    """
    wanted = settle(pairs.select(*PAIR).distinct().withColumn("_pair", F.monotonically_increasing_id()))
    few = wanted.count() <= BROADCAST_ROWS
    keys = ["_pair"] if few else PAIR
    sides = wanted.select(
        *dict.fromkeys([*keys, "product"]),
        F.explode(
            F.array(
                F.struct(F.col("from_build").alias("build_number"), F.lit("from").alias("side")),
                F.struct(F.col("to_build").alias("build_number"), F.lit("to").alias("side")),
            )
        ).alias("s"),
    ).select(*dict.fromkeys([*keys, "product"]), "s.build_number", "s.side")
    slim = components.select("product", "build_number", "ord", "name", "version")
    diff = _diff(join_dimension(slim, sides, ["product", "build_number"]), keys)
    if few:
        diff = diff.join(F.broadcast(wanted), "_pair")
    return diff.select(*PAIR, "name", "from_version", "to_version", "status")


def compare_releases(
    components: DataFrame, product: str, from_build: str, to_build: str
) -> DataFrame:
    """One pair; the two builds are pushed to the scan as a filter."""
    build = F.col("build_number")
    sided = components.where(
        (F.col("product") == product) & build.isin(from_build, to_build)
    ).select(
        "ord",
        "name",
        "version",
        F.explode(
            F.array_compact(
                F.array(
                    F.when(build == from_build, F.lit("from")),
                    F.when(build == to_build, F.lit("to")),
                )
            )
        ).alias("side"),
    )
    return _diff(sided, []).select(
        F.lit(product).alias("product"),
        F.lit(from_build).alias("from_build"),
        F.lit(to_build).alias("to_build"),
        "name",
        "from_version",
        "to_version",
        "status",
    )


def previous_release(releases: DataFrame) -> DataFrame:
    """Add ``previous_build``: the next older release of the product by date.

    Releases of one date keep index order (``pos``), as in a stable sort by date.
    """
    return with_next(
        releases,
        ["product"],
        [F.col("release_date").desc_nulls_last(), F.col("pos").asc()],
        ["build_number"],
        into="older",
    ).select(*releases.columns, F.col("older.build_number").alias("previous_build"))


def compare_with_previous(components: DataFrame, releases: DataFrame) -> DataFrame:
    """Every release against its predecessor by date."""
    pairs = (
        previous_release(releases.select("product", "build_number", "release_date", "pos"))
        .where("previous_build is not null")
        .select(
            "product",
            F.col("previous_build").alias("from_build"),
            F.col("build_number").alias("to_build"),
        )
    )
    return compare_many(components, pairs)


def changed_only(diff: DataFrame) -> DataFrame:
    """Everything but unchanged rows; added and removed rows stay."""
    return diff.where(F.col("status") != "unchanged")


def upgraded(diff: DataFrame) -> DataFrame:
    """Rows whose version went up."""
    return diff.where(F.col("status") == "upgraded")


def downgraded(diff: DataFrame) -> DataFrame:
    """Rows whose version went down."""
    return diff.where(F.col("status") == "downgraded")


def compare_summary(diff: DataFrame) -> DataFrame:
    """Counts per pair, and the one-line text of them."""

    def count(status: str) -> Column:
        return F.count_if(F.col("status") == status).alias(status)

    names = ["upgraded", "downgraded", "added", "removed"]
    counts = diff.groupBy(*PAIR).agg(*[count(s) for s in [*names, "unchanged"]])
    text = F.concat_ws(", ", *[F.concat_ws(" ", F.col(s).cast("string"), F.lit(s)) for s in names])
    return counts.withColumn("summary", text)


def overlay_components(base: DataFrame, overlay: DataFrame) -> DataFrame:
    """Overlay rows replace base rows of the same name in the same release."""
    key = ["product", "build_number", "name"]
    replaced = overlay.select(*key).distinct()
    return base.join(replaced, key, "left_anti").unionByName(overlay)
