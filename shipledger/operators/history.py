"""Component and SDK histories over all releases at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.functions.labels import component_slug, display_name, release_slug
from shipledger.functions.versions import direction_of_keys, version_key
from shipledger.operators.dimension import join_dimension
from shipledger.operators.found import order_by_key
from shipledger.operators.succession import with_next_in_groups
from shipledger.session import settle


def _age() -> Column:
    """Oldest first; releases without a date come last, ties keep index order."""
    return F.struct(
        F.col("release_date").isNull().alias("undated"), F.col("release_date"), F.col("pos")
    )


def latest_components(components: DataFrame, releases: DataFrame) -> DataFrame:
    """Per name, the entry in the most recent release that has it."""
    dated = join_dimension(
        components.select("product", "build_number", "ord", "name", "version", "source", "path"),
        releases.select("product", "build_number", "release_date", "pos"),
        ["product", "build_number"],
    )
    newest = F.struct(F.col("release_date"), -F.col("pos"), -F.col("ord"))
    latest = dated.groupBy("product", "name").agg(
        F.max_by(
            F.struct(F.coalesce("version", F.lit("")).alias("version"), "source", "path"), newest
        ).alias("c")
    )
    return latest.select("product", "name", "c.version", "c.source", "c.path")


def component_slugs(components: DataFrame) -> DataFrame:
    """Distinct slugs in order."""
    return components.select("product", component_slug().alias("slug")).distinct().orderBy(
        "product", "slug"
    )


def component_history(components: DataFrame, releases: DataFrame) -> DataFrame:
    """For every slug and version, the earliest release that has it.

    One aggregate over all slugs: popular slugs shrink to one row per version on the map
    side, before the shuffle. ``min_pos`` is the first index position with the version.
    """
    labelled = releases.select(
        "product",
        "build_number",
        "pos",
        "release_date",
        F.struct(
            display_name().alias("first_release"),
            release_slug().alias("first_release_slug"),
            F.col("release_date").alias("first_release_date"),
            F.col("is_beta").alias("first_release_beta"),
            F.col("is_rc").alias("first_release_rc"),
        ).alias("label"),
    )
    versions = components.select(
        "product",
        "build_number",
        component_slug().alias("slug"),
        F.coalesce("version", F.lit("")).alias("version"),
    )
    earliest = (
        join_dimension(versions, labelled, ["product", "build_number"])
        .groupBy("product", "slug", "version")
        .agg(F.min_by("label", _age()).alias("label"), F.min("pos").alias("min_pos"))
    )
    return earliest.select("product", "slug", "version", "min_pos", "label.*")


def component_meta(components: DataFrame, releases: DataFrame) -> DataFrame:
    """Name, source and path that stand for a slug: its first entry in index order."""
    positions = releases.select("product", "build_number", "pos")
    first = (
        join_dimension(
            components.select("product", "build_number", "ord", "name", "source", "path"),
            positions,
            ["product", "build_number"],
        )
        .groupBy("product", component_slug().alias("slug"))
        .agg(F.min_by(F.struct("name", "source", "path"), F.struct("pos", "ord")).alias("m"))
    )
    return first.select("product", "slug", "m.*")


def history_direction(history: DataFrame) -> DataFrame:
    """Direction of every version against the next lower one of its slug; the lowest one is
    ``added``. Versions without a number sort below all others."""
    keyed = history.withColumn("_key", version_key("version"))
    order = [F.col("_key").desc_nulls_last(), F.col("min_pos").asc(), F.col("version").asc()]
    lower = with_next_in_groups(keyed, ["product", "slug"], order, ["version", "_key"], into="lower")
    # The keys travel with the rows, so each is computed once.
    direction = direction_of_keys(F.col("lower._key"), F.col("_key"))
    return lower.select(
        *history.columns,
        F.when(F.col("lower.version").isNull(), "added").otherwise(direction).alias("direction"),
    )


def first_sdk_build(sdks: DataFrame) -> DataFrame:
    """The first entry of each SDK version in a release."""
    return sdks.groupBy("product", "build_number", "sdk_version").agg(
        F.min_by(F.struct(F.nullif("build_version", F.lit("")).alias("b")), "ord").alias("first")
    ).select("product", "build_number", "sdk_version", F.col("first.b").alias("sdk_build"))


def sdk_history(sdks: DataFrame, releases: DataFrame) -> DataFrame:
    """Releases per SDK version, whether a release is the first to ship its SDK build, and the
    latest known build of the SDK version.

    The entries are computed once. First and latest come from aggregates over (version, build)
    joined back, so no SDK version has to be sorted in one task.
    """
    entries = settle(
        first_sdk_build(sdks).join(
            releases.select(
                "product",
                "build_number",
                "release_date",
                "pos",
                display_name(include_release_name=False).alias("release"),
                release_slug().alias("release_slug"),
                "is_beta",
                "is_rc",
            ),
            ["product", "build_number"],
        )
    )
    builds = (
        entries.where(F.col("sdk_build").isNotNull())
        .groupBy("product", "sdk_version", "sdk_build")
        .agg(F.min(_age()).alias("first"), F.max(_age()).alias("last"))
    )
    latest = builds.groupBy("product", "sdk_version").agg(
        F.max_by("sdk_build", "last").alias("latest_build")
    )
    known = join_dimension(
        entries,
        builds.select("product", "sdk_version", "sdk_build", "first"),
        ["product", "sdk_version", "sdk_build"],
        "left",
    )
    return (
        join_dimension(known, latest, ["product", "sdk_version"], "left")
        .select(
            "product",
            "sdk_version",
            "latest_build",
            "sdk_build",
            "release",
            "release_slug",
            "build_number",
            "release_date",
            "pos",
            "is_beta",
            "is_rc",
            F.coalesce(F.col("first") == _age(), F.lit(False)).alias("is_first_shipping_build"),
        )
    )


def sdk_versions(sdks: DataFrame) -> DataFrame:
    """Distinct SDK versions, highest first."""
    distinct = sdks.select("sdk_version").distinct()
    return order_by_key(distinct, version_key("sdk_version"), "sdk_version", descending=True)


def dedupe_sdks(sdks: DataFrame) -> DataFrame:
    """One SDK per version and release, versions in descending text order."""
    first = sdks.groupBy("product", "build_number", "sdk_version").agg(
        F.min_by(F.struct("build_version"), "ord").alias("first")
    )
    return first.select(
        "product", "build_number", "sdk_version", F.col("first.build_version").alias("build_version")
    ).orderBy("product", "build_number", F.col("sdk_version").desc())
