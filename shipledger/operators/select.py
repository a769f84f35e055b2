"""Listing, resolving and looking up releases and components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipledger.functions.labels import safe_link
from shipledger.functions.versions import (
    build_key,
    compare_versions,
    major,
    recency_key,
    release_key,
    strip_parenthetical,
)
from shipledger.operators.dimension import join_dimension
from shipledger.operators.found import order_by_key
from shipledger.session import settle


def list_releases(releases: DataFrame, major_version: int | None = None) -> DataFrame:
    """Releases in ascending version order, optionally of one major version.

    On a table partitioned by ``major`` only that partition is read.
    """
    kept = releases
    if major_version is not None:
        if "major" in releases.columns:
            kept = kept.where(F.col("major").try_cast("int") == major_version)
        kept = kept.where(major("os_version") == major_version)
    return order_by_key(kept, release_key())


def release_type() -> Column:
    """``beta``, ``rc`` or ``release``."""
    return F.when(F.col("is_beta"), "beta").when(F.col("is_rc"), "rc").otherwise("release")


def filter_release_type(releases: DataFrame, kind: str) -> DataFrame:
    """Releases of one kind, or ``all``."""
    if kind not in ("all", "release", "beta", "rc"):
        raise ValueError(f"unknown release type: {kind}")
    return releases if kind == "all" else releases.where(release_type() == kind)


def _selection_key() -> Column:
    maturity = F.when(F.col("is_beta"), 0).when(F.col("is_rc"), 1).otherwise(2)
    universal = F.when(F.col("is_device_specific"), 0).otherwise(1)
    revision = F.when(F.col("is_beta"), F.coalesce("beta_revision", F.lit(1))).otherwise(0)
    return F.struct(
        (maturity * 2 + universal).alias("rank"),
        F.coalesce("beta_number", "rc_number", F.lit(0)).alias("number"),
        revision.alias("revision"),
        build_key("build_number").alias("build"),
        (-F.col("pos")).alias("first"),
    )


def preferred_release(releases: DataFrame) -> DataFrame:
    """The build that stands for an OS version: final before candidate before beta, universal
    before device-specific, then the later number, revision and build.

    A maximum per key, so it combines on the map side and needs no ordering of the group.
    """
    rest = [c for c in releases.columns if c not in ("product", "os_version")]
    best = releases.groupBy("product", "os_version").agg(
        F.max_by(F.struct(*rest), _selection_key()).alias("best")
    )
    return best.select("product", "os_version", *[F.col(f"best.{c}").alias(c) for c in rest])


def resolve_specs(specs: DataFrame, releases: DataFrame) -> DataFrame:
    """Resolve a table of release texts (product, spec, build) to builds.

    A text is ``version`` or ``version-build``, or a version with the build beside it.
    ``status`` is resolved, unmatched or invalid (an empty side of the dash).
    """
    spec, build = F.col("spec"), F.col("build")
    dashed = build.isNull() & spec.contains("-")
    parsed = specs.select(
        "product",
        "spec",
        "build",
        F.when(dashed, F.substring_index(spec, "-", 1)).otherwise(spec).alias("os_version"),
        F.when(dashed, F.expr("substr(spec, instr(spec, '-') + 1)")).otherwise(build).alias("_build"),
    ).withColumn(
        "_invalid", dashed & ((F.col("os_version") == "") | (F.col("_build") == ""))
    )
    preferred = preferred_release(
        releases.select(
            "product",
            "os_version",
            "build_number",
            "is_beta",
            "is_rc",
            "beta_number",
            "beta_revision",
            "rc_number",
            "is_device_specific",
            "pos",
        )
    ).select("product", "os_version", F.col("build_number").alias("_preferred"))
    known = (
        releases.groupBy("product", "os_version", F.col("build_number").alias("_build"))
        .agg(F.min("pos").alias("pos"))
    )
    return (
        parsed.join(preferred, ["product", "os_version"], "left")
        .withColumn("_build", F.coalesce("_build", "_preferred"))
        .join(known, ["product", "os_version", "_build"], "left")
        .select(
            "product",
            "spec",
            "build",
            "os_version",
            F.when(~F.col("_invalid") & F.col("pos").isNotNull(), F.col("_build")).alias(
                "build_number"
            ),
            F.when(F.col("_invalid"), "invalid")
            .when(F.col("pos").isNull(), "unmatched")
            .otherwise("resolved")
            .alias("status"),
        )
    )


#: Letters of a term by which names are found at once.
PIECE = 16


def _grams(text: Column, sizes: list[int]) -> Column:
    """All distinct substrings of the given sizes."""
    fitting = F.filter(F.array(*[F.lit(n) for n in sizes]), lambda size: size <= F.length(text))
    return F.array_distinct(
        F.flatten(
            F.transform(
                fitting,
                lambda size: F.transform(
                    F.sequence(F.lit(1), F.length(text) - size + 1),
                    lambda start: F.substr(text, start, size),
                ),
            )
        )
    )


def _containing_names(terms: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs (term, lname) where the name contains the term, without comparing all pairs.

    A term of up to ``PIECE`` letters meets a name on a substring equal to it, so only pairs of the
    result meet. A longer term meets names on that one of its pieces of this size that the fewest
    names have, then the pair is verified. Names are cut into sizes that some term has, no others.
    """
    length = F.length("term")
    # At most PIECE + 2 numbers.
    lengths = terms.where(length.isNotNull()).select(F.least(length, F.lit(PIECE + 1)).alias("n")).distinct().collect()
    sizes = sorted({min(r["n"], PIECE) for r in lengths})
    pieces = names.select("lname", F.explode(_grams(F.col("lname"), sizes or [0])).alias("gram"))
    short = terms.where(length <= PIECE).select("term", F.col("term").alias("gram"))
    pairs = join_dimension(pieces, short, ["gram"]).select("term", "lname")
    if all(r["n"] <= PIECE for r in lengths):
        return pairs
    wanted = terms.where(length > PIECE).select("term", F.explode(_grams(F.col("term"), [PIECE])).alias("gram"))
    pieces = names.select("lname", F.explode(_grams(F.col("lname"), [PIECE])).alias("gram"))
    pieces = join_dimension(pieces, wanted.select("gram").distinct(), ["gram"])
    frequency = pieces.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = (
        wanted.join(frequency, "gram", "left")
        .groupBy("term")
        .agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    )
    return pairs.unionByName(
        join_dimension(pieces, rarest, ["gram"])
        .where(F.contains(F.col("lname"), F.col("term")))
        .select("term", "lname")
    )


def lookup_components(requests: DataFrame, components: DataFrame) -> DataFrame:
    """Components of a release for each request (product, build_number, request).

    Tier 1 is the name in any case, tier 2 the name without parentheticals; both give the
    first such component. Only requests without either get tier 3, every component whose
    name contains the text. Unknown texts give no row.
    """
    release = ["product", "build_number"]
    details = ["ord", "name", "version", "path", "source"]
    asked = settle(
        requests.select(*release, "request").distinct().select(
            *release,
            "request",
            F.lower("request").alias("term"),
            strip_parenthetical(F.lower("request")).alias("bare"),
        )
    )
    # Only releases that are asked for are searched; their components are read once.
    lname = F.lower("name")
    searched = settle(
        join_dimension(
            components.select(*release, *details), asked.select(*release).distinct(), release
        ).select(*release, *details, lname.alias("lname"), strip_parenthetical(lname).alias("lbare"))
    )

    keys = F.explode(F.array("term", "bare")).alias("key")
    targets = asked.select(*release, keys).distinct()
    tiers = F.explode(
        F.array(
            F.struct(F.lit(1).alias("tier"), F.col("lname").alias("key")),
            F.struct(F.lit(2).alias("tier"), F.col("lbare").alias("key")),
        )
    ).alias("t")
    keyed = searched.select(*release, *details, tiers).select(*release, "t.tier", "t.key", *details)
    found = settle(
        join_dimension(keyed, targets, [*release, "key"])
        .groupBy(*release, "tier", "key")
        .agg(F.min_by(F.struct(*details), "ord").alias("hit"))
    )

    def tier(number: int, key: str) -> DataFrame:
        return found.where(F.col("tier") == number).select(
            *release, F.col("key").alias(key), F.col("hit").alias(f"hit{number}")
        )

    placed = settle(
        asked.join(tier(1, "term"), [*release, "term"], "left").join(
            tier(2, "bare"), [*release, "bare"], "left"
        )
    )
    hit = F.coalesce("hit1", "hit2")
    single = placed.where(hit.isNotNull()).select(
        *release,
        "request",
        F.when(F.col("hit1").isNotNull(), 1).otherwise(2).alias("tier"),
        *[hit[d].alias(d) for d in details],
    )

    open_requests = placed.where(hit.isNull()).select(*release, "request", "term")
    pairs = _containing_names(
        open_requests.select("term").distinct(), searched.select("lname").distinct()
    )
    several = (
        searched.join(open_requests.join(pairs, "term"), [*release, "lname"])
        .select(*release, "request", F.lit(3).alias("tier"), *details)
    )
    return single.unionByName(several)


def safe_links(df: DataFrame, column: str) -> DataFrame:
    """Blank every link that is not https."""
    return df.withColumn(column, safe_link(column))


def component_projection(components: DataFrame) -> DataFrame:
    """Component lists of releases, names in case-insensitive order."""
    return components.select(
        "product", "build_number", "name", F.coalesce("version", F.lit("unknown")).alias("version"),
        "path", "source",
    ).orderBy("product", "build_number", F.collate("name", "UNICODE"), "name", "version")


def attach_details(index: DataFrame, details: DataFrame) -> DataFrame:
    """Add detail columns to the release list; rows without details keep nulls."""
    return index.join(details, ["product", "build_number"], "left")


def first_sdk(sdks: DataFrame) -> DataFrame:
    """The first SDK of each release."""
    return sdks.groupBy("product", "build_number").agg(
        F.min_by("sdk_version", "ord").alias("sdk_version")
    )


def project_release_row(releases: DataFrame, sdks: DataFrame) -> DataFrame:
    """Rows of the release list; only Xcode rows carry minimum OS version and first SDK."""
    xcode = F.col("product") == "Xcode"
    return attach_details(releases, first_sdk(sdks)).select(
        "product",
        "os_version",
        "build_number",
        "release_date",
        release_type().alias("type"),
        F.when(xcode, F.col("minimum_os_version")).alias("minimum_os_version"),
        F.when(xcode, F.col("sdk_version")).alias("sdk_version"),
    )


def latest_releases(releases: DataFrame) -> DataFrame:
    """Newest final release per product, and the newest pre-release if its version is higher
    or there is no final release."""
    row = F.struct("os_version", "build_number", "release_date")
    pre = F.col("is_beta") | F.col("is_rc")
    newest = releases.groupBy("product").agg(
        F.max_by(row, F.when(~pre, recency_key())).alias("ga"),
        F.max_by(row, F.when(pre, recency_key())).alias("prerelease"),
    )
    pending = F.col("ga").isNull() | (
        compare_versions("ga.os_version", "prerelease.os_version") == "upgraded"
    )
    return newest.withColumn("prerelease", F.when(pending, F.col("prerelease")))


def release_stats(releases: DataFrame) -> DataFrame:
    """Number of releases and of final releases per product."""
    return releases.groupBy("product").agg(
        F.count("*").alias("total"),
        F.count_if(~F.col("is_beta") & ~F.col("is_rc")).alias("final"),
    )


def releases_by_major(releases: DataFrame) -> DataFrame:
    """Releases per major version, highest first; the label is the name of the oldest one."""
    named = (F.col("product") != "Xcode") & (F.coalesce("release_name", F.lit("")) != "")
    oldest = F.when(named, F.struct("release_date", -F.col("pos")))
    return (
        releases.groupBy("product", F.split("os_version", r"\.")[0].alias("major"))
        .agg(F.count("*").alias("releases"), F.min_by("release_name", oldest).alias("label"))
        .orderBy("product", F.col("major").try_cast("int").desc_nulls_last())
    )
