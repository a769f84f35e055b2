"""Queries on keys and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.functions import versions as V
from shipledger.operators import compare as C
from shipledger.operators.succession import with_next
from shipledger.plans.catalogue import line_components, month_components, month_releases, order_releases, table
from shipledger.plans.registry import query
from shipledger.plans.sql import (
    COMP, DIFF, FIRSTS, LINE_VERSION, ORDER_REL, PAIRS, PAREN, REL, build_order, direction, padded, tokens, with_,
)

DIFF_COLUMNS = "product, from_build, to_build, name, from_version, to_version, status"


def _previous_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.compare_with_previous(month_components(spark, sf_dir), month_releases(spark, sf_dir))


@query("compare_with_previous", with_(COMP, REL, PAIRS, FIRSTS, DIFF) + f"SELECT {DIFF_COLUMNS} FROM diff")
def compare_with_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release against its predecessor."""
    return _previous_diff(spark, sf_dir)


SUMMARY = """SELECT product, from_build, to_build,
 count(*) FILTER (status = 'upgraded') AS upgraded, count(*) FILTER (status = 'downgraded') AS downgraded,
 count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'removed') AS removed,
 count(*) FILTER (status = 'unchanged') AS unchanged,
 count(*) FILTER (status = 'upgraded') || ' upgraded, ' || count(*) FILTER (status = 'downgraded') ||
 ' downgraded, ' || count(*) FILTER (status = 'added') || ' added, ' ||
 count(*) FILTER (status = 'removed') || ' removed' AS summary
 FROM diff GROUP BY 1, 2, 3"""


@query("compare_summary", with_(COMP, REL, PAIRS, FIRSTS, DIFF) + SUMMARY)
def compare_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the differences of every release to its predecessor."""
    return C.compare_summary(_previous_diff(spark, sf_dir))


# Each final build against the beta of the same version, and each candidate against the final.
SAME_VERSION = """pairs AS (SELECT a.product, a.build_number AS from_build, b.build_number AS to_build
 FROM rel a JOIN rel b ON a.os_version = b.os_version
 WHERE (a.is_beta AND b.maturity = 2) OR (a.is_rc AND b.maturity = 2))"""


@query("compare_many", with_(COMP, REL, SAME_VERSION, FIRSTS, DIFF) + f"SELECT {DIFF_COLUMNS} FROM diff")
def compare_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requested pairs: beta and candidate of each version against its final build."""
    releases = month_releases(spark, sf_dir).select(
        "product", "os_version", "build_number", "is_beta", "is_rc"
    )
    final = releases.where(~F.col("is_beta") & ~F.col("is_rc")).select(
        "product", "os_version", F.col("build_number").alias("to_build")
    )
    early = releases.where(F.col("is_beta") | F.col("is_rc")).select(
        "product", "os_version", F.col("build_number").alias("from_build")
    )
    return C.compare_many(month_components(spark, sf_dir), early.join(final, ["product", "os_version"]))


ONE_PAIR = "pairs AS (SELECT 'macOS' AS product, '13C5003a' AS from_build, '14D84' AS to_build)"


@query("compare_releases", with_(COMP, ONE_PAIR, FIRSTS, DIFF) + f"SELECT {DIFF_COLUMNS} FROM diff")
def compare_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pair of builds."""
    return C.compare_releases(month_components(spark, sf_dir), "macOS", "13C5003a", "14D84")


def _subset(name: str, condition: str, keep) -> None:
    sql = with_(COMP, REL, PAIRS, FIRSTS, DIFF) + f"SELECT {DIFF_COLUMNS} FROM diff WHERE {condition}"
    query(name, sql)(lambda spark, sf_dir: keep(_previous_diff(spark, sf_dir)))


_subset("changed_only", "status <> 'unchanged'", C.changed_only)
_subset("upgraded", "status = 'upgraded'", C.upgraded)
_subset("downgraded", "status = 'downgraded'", C.downgraded)


@query(
    "component_name_union",
    with_(COMP, REL, PAIRS, FIRSTS, DIFF)
    + "SELECT DISTINCT product, from_build, to_build, name FROM diff",
)
def component_name_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on either side of each pair."""
    return _previous_diff(spark, sf_dir).select("product", "from_build", "to_build", "name")


@query("previous_release", with_(REL, PAIRS) + "SELECT product, to_build AS build_number, from_build AS previous_build FROM pairs")
def previous_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predecessor of every release by date."""
    return C.previous_release(month_releases(spark, sf_dir)).select(
        "product", "build_number", "previous_build"
    )


# The beta of a version laid over the components of the month's final build.
OVERLAY = """SELECT name, version, path, source, ord, build_number FROM (
 SELECT *, 'n' AS side FROM comp WHERE build_number NOT LIKE '%a') b
 WHERE NOT EXISTS (SELECT 1 FROM over_ o WHERE o.build_number = b.build_number AND o.name = b.name)
 UNION ALL SELECT name, version, path, source, ord, build_number FROM over_"""
OVERLAY_ROWS = """over_ AS (SELECT * REPLACE (substr(build_number, 1, 3) || CAST(TRY_CAST(regexp_extract(build_number,
 '^[0-9]+[A-Z]([0-9]+)a$', 1) AS INT) - 4920 AS VARCHAR) AS build_number) FROM comp WHERE build_number LIKE '%a')"""


@query("overlay_components", with_(COMP, OVERLAY_ROWS) + OVERLAY)
def overlay_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beta components laid over those of the final build of the month."""
    components = month_components(spark, sf_dir)
    beta = F.col("build_number").endswith("a")
    number = F.regexp_extract("build_number", "^[0-9]+[A-Z]([0-9]+)a$", 1).cast("int") - 4920
    overlay = components.where(beta).withColumn(
        "build_number", F.concat(F.substring("build_number", 1, 3), number.cast("string"))
    )
    return C.overlay_components(components.where(~beta), overlay).select(
        "name", "version", "path", "source", "ord", "build_number"
    )


VERSIONS = f"vers AS (SELECT DISTINCT coalesce({LINE_VERSION}, '') AS version FROM lineitem)"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        month_components(spark, sf_dir)
        .select(F.coalesce("version", F.lit("")).alias("version"))
        .distinct()
    )


@query(
    "version_tokens",
    with_(VERSIONS)
    + f"""SELECT version, array_to_string(list_transform({tokens('version')}, lambda x:
 CASE WHEN x.r = 1 THEN x.t ELSE CAST(x.n AS VARCHAR) END), '|') AS tokens FROM vers""",
)
def version_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every component version."""
    return _versions(spark, sf_dir).select(
        "version", F.array_join(V.version_tokens("version"), "|").alias("tokens")
    )


def _following(keyed: DataFrame, name: str, descending: bool = False) -> DataFrame:
    """Every ``name`` with the one that follows it in the order of ``k``."""
    order = [F.col("k").desc_nulls_last() if descending else F.col("k").asc_nulls_first(), F.col(name).asc()]
    return with_next(keyed.select("k", name), [], order, [name]).select(
        name, F.coalesce(f"next.{name}", F.lit("-")).alias("following")
    )


@query(
    "version_key",
    with_(VERSIONS)
    + f"""SELECT version, coalesce(lead(version) OVER (ORDER BY len({tokens('version')}) > 0, {padded('version')}, version), '-') AS following FROM vers""",
)
def version_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every component version with the next higher one."""
    return _following(_versions(spark, sf_dir).withColumn("k", V.version_key("version")), "version")


ADJACENT = f"""lines AS (SELECT l_orderkey, coalesce({LINE_VERSION}, '') AS version, l_partkey,
 l_suppkey FROM lineitem)"""


@query(
    "compare_versions",
    with_(COMP, ADJACENT)
    + f"""SELECT a, b, {direction('a', 'b')} AS direction, n FROM (
 SELECT x.version AS a, y.version AS b, count(*) AS n FROM
 (SELECT l_orderkey, arg_min(version, (l_partkey, version)) AS version FROM lines GROUP BY 1) x JOIN
 (SELECT l_orderkey, arg_max(version, (l_partkey, version)) AS version FROM lines GROUP BY 1) y
 USING (l_orderkey) GROUP BY 1, 2)""",
)
def compare_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction between the versions of the first and the last part of every order."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", *line_components())
    version = F.coalesce("version", F.lit(""))
    by = F.struct(F.col("l_partkey"), version)
    pairs = (
        rows.groupBy("l_orderkey")
        .agg(F.min_by(version, by).alias("a"), F.max_by(version, by).alias("b"))
        .groupBy("a", "b")
        .agg(F.count("*").alias("n"))
    )
    return V.with_direction(pairs, "a", "b", "direction").select("a", "b", "direction", "n")


@query(
    "os_version_key",
    with_(ORDER_REL)
    + """SELECT build_number, CAST(split_part(os_version, '.', 1) AS INT) AS major, CAST(split_part(os_version, '.', 2) AS INT) AS minor,
 coalesce(TRY_CAST(split_part(os_version, '.', 3) AS INT), 0) AS patch FROM orel""",
)
def os_version_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the OS version of every release."""
    return order_releases(spark, sf_dir).select("build_number", V.os_version_key("os_version").alias("k")).select(
        "build_number", "k.*"
    )


@query(
    "build_key",
    with_(ORDER_REL)
    + f"SELECT build_number, coalesce(lead(build_number) OVER (ORDER BY {build_order('build_number')}, build_number), '-') AS following FROM orel",
)
def build_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every build with the next one in build order."""
    return _following(order_releases(spark, sf_dir).withColumn("k", V.build_key("build_number")), "build_number")


@query(
    "release_key",
    with_(ORDER_REL)
    + f"""SELECT build_number, coalesce(lead(build_number) OVER (ORDER BY CAST(split_part(os_version, '.', 1) AS INT), CAST(split_part(os_version, '.', 2) AS INT),
 coalesce(TRY_CAST(split_part(os_version, '.', 3) AS INT), 0), CASE WHEN is_beta THEN 0 WHEN is_rc THEN 1 ELSE 2 END,
 {build_order('build_number')}, build_number), '-') AS following FROM orel""",
)
def release_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release with the next one in version order."""
    return _following(order_releases(spark, sf_dir).withColumn("k", V.release_key()), "build_number")


@query(
    "prerelease_rank",
    with_(ORDER_REL)
    + "SELECT build_number, CASE WHEN is_beta THEN 0 WHEN is_rc THEN 1 ELSE 2 END AS rank FROM orel",
)
def prerelease_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Maturity of every release."""
    return order_releases(spark, sf_dir).select("build_number", V.prerelease_rank().alias("rank"))


@query(
    "recency_order",
    with_(ORDER_REL)
    + f"""SELECT build_number, coalesce(lead(build_number) OVER (ORDER BY release_date DESC NULLS LAST,
 {padded('os_version')} DESC, {build_order('build_number', desc=True)}, build_number), '-') AS following FROM orel""",
)
def recency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every release with the next older one."""
    return _following(
        order_releases(spark, sf_dir).withColumn("k", V.recency_key()), "build_number", descending=True
    )


@query(
    "beta_build_flag",
    with_(COMP) + "SELECT build_number LIKE '%a' AS beta, count(*) AS n FROM comp GROUP BY 1",
)
def beta_build_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components in beta and other builds, by the form of the build number."""
    return month_components(spark, sf_dir).groupBy(V.beta_build_flag("build_number").alias("beta")).agg(
        F.count("*").alias("n")
    )


@query(
    "strip_parenthetical",
    with_(COMP) + f"SELECT DISTINCT name, trim(regexp_replace(name, '{PAREN}', '', 'g')) AS bare FROM comp",
)
def strip_parenthetical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without parentheticals."""
    return month_components(spark, sf_dir).select("name", V.strip_parenthetical("name").alias("bare")).distinct()
