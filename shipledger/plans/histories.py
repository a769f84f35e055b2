"""Queries on component and SDK histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.operators import history as H
from shipledger.plans.catalogue import month_components, month_releases, order_releases, order_sdks
from shipledger.plans.registry import query
from shipledger.plans.sql import COMP, DISPLAY, ORDER_REL, ORDER_SDK, REL, SLUG, direction, padded, tokens, with_

DATED = """dated AS (SELECT c.*, r.release_date, r.pos, r.os_version, r.release_name, r.is_beta, r.is_rc,
 r.beta_number, r.beta_revision, r.rc_number FROM comp c JOIN rel r USING (product, build_number))"""


@query(
    "latest_components",
    with_(COMP, REL, DATED)
    + """SELECT product, name, version, source, path FROM (
 SELECT product, name, coalesce(version, '') AS version, source, path,
 row_number() OVER (PARTITION BY product, name ORDER BY release_date DESC NULLS LAST, pos, ord) AS r FROM dated) WHERE r = 1""",
)
def latest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest entry of every component."""
    return H.latest_components(month_components(spark, sf_dir), month_releases(spark, sf_dir))


@query(
    "component_slugs",
    with_(COMP) + f"SELECT DISTINCT product, {SLUG.format(n='name')} AS slug FROM comp",
)
def component_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct slugs."""
    return H.component_slugs(month_components(spark, sf_dir))


HISTORY = f"""hist AS (SELECT product, {SLUG.format(n='name')} AS slug, coalesce(version, '') AS version,
 arg_min({DISPLAY.format(named='true')}, (release_date, pos)) AS first_release,
 arg_min(os_version || '-' || build_number, (release_date, pos)) AS first_release_slug,
 min(release_date) AS first_date, arg_min(is_beta, (release_date, pos)) AS first_beta,
 arg_min(is_rc, (release_date, pos)) AS first_rc, min(pos) AS min_pos FROM dated GROUP BY 1, 2, 3)"""


@query(
    "component_history",
    with_(COMP, REL, DATED, HISTORY)
    + """SELECT product, slug, version, min_pos, first_release, first_release_slug,
 CAST(first_date AS VARCHAR) AS first_release_date, first_beta AS first_release_beta, first_rc AS first_release_rc FROM hist""",
)
def component_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earliest release of every version of every component."""
    history = H.component_history(month_components(spark, sf_dir), month_releases(spark, sf_dir))
    return history.withColumn("first_release_date", F.col("first_release_date").cast("string"))


@query(
    "component_meta",
    with_(COMP, REL, DATED)
    + f"""SELECT product, {SLUG.format(n='name')} AS slug, arg_min(name, (pos, ord)) AS name,
 arg_min(source, (pos, ord)) AS source, arg_min(path, (pos, ord)) AS path FROM dated GROUP BY 1, 2""",
)
def component_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name, source and path of every slug."""
    return H.component_meta(month_components(spark, sf_dir), month_releases(spark, sf_dir))


@query(
    "history_direction",
    with_(COMP, REL, DATED, HISTORY)
    + f"""SELECT product, slug, version, CASE WHEN lower_version IS NULL THEN 'added' ELSE {direction('lower_version', 'version')} END AS direction
 FROM (SELECT product, slug, version, lead(version) OVER (PARTITION BY product, slug ORDER BY
 CASE WHEN len({tokens('version')}) = 0 THEN 1 ELSE 0 END, {padded('version')} DESC, min_pos, version) AS lower_version FROM hist)""",
)
def history_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of every version in its history."""
    history = H.component_history(month_components(spark, sf_dir), month_releases(spark, sf_dir))
    directed = H.history_direction(history.select("product", "slug", "version", "min_pos"))
    return directed.drop("min_pos")


@query("sdk_versions", with_(ORDER_REL, ORDER_SDK) + "SELECT DISTINCT sdk_version FROM osdk")
def sdk_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct SDK versions."""
    return H.sdk_versions(order_sdks(spark, sf_dir))


@query(
    "dedupe_sdks",
    with_(ORDER_REL, ORDER_SDK)
    + """SELECT product, build_number, sdk_version, coalesce(build_version, '-') AS build_version FROM (
 SELECT *, row_number() OVER (PARTITION BY build_number, sdk_version ORDER BY ord) AS r FROM osdk) WHERE r = 1""",
)
def dedupe_sdks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One SDK per version and release."""
    return H.dedupe_sdks(order_sdks(spark, sf_dir)).withColumn(
        "build_version", F.coalesce("build_version", F.lit("-"))
    )


@query(
    "sdk_history",
    with_(ORDER_REL, ORDER_SDK)
    + f"""SELECT sdk_version, coalesce(latest_build, '-') AS latest_build, coalesce(build_version, '-') AS sdk_build,
 release, build_number, is_first AS is_first_shipping_build FROM (
 SELECT *, build_version IS NOT NULL AND row_number() OVER (PARTITION BY sdk_version, build_version ORDER BY release_date, pos) = 1 AS is_first,
  last_value(build_version IGNORE NULLS) OVER (PARTITION BY sdk_version ORDER BY release_date, pos
   ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS latest_build FROM (
  SELECT s.sdk_version, s.build_version, r.build_number, r.release_date, r.pos, {DISPLAY.format(named='false')} AS release FROM (
   SELECT *, row_number() OVER (PARTITION BY build_number, sdk_version ORDER BY ord) AS n FROM osdk) s
  JOIN orel r USING (product, build_number) WHERE s.n = 1))""",
)
def sdk_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases per SDK version with first and latest builds."""
    history = H.sdk_history(order_sdks(spark, sf_dir), order_releases(spark, sf_dir))
    return history.select(
        "sdk_version", F.coalesce("latest_build", F.lit("-")).alias("latest_build"),
        F.coalesce("sdk_build", F.lit("-")).alias("sdk_build"), "release", "build_number", "is_first_shipping_build",
    )
