"""Queries on listing, resolving and looking up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.functions import labels as L
from shipledger.operators import select as S
from shipledger.plans.catalogue import (
    month_components, month_releases, month_specs, lookup_requests, order_releases, order_sdks, table,
)
from shipledger.plans.registry import query
from shipledger.plans.sql import (
    COMP, DISPLAY, ORDER_REL, ORDER_SDK, PAREN, REL, SLUG, SPECS, REQUESTS, build_order, direction, padded, with_,
)


@query("list_releases", with_(REL) + "SELECT build_number, os_version FROM rel WHERE maj = 13")
def list_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of one major version."""
    return S.list_releases(month_releases(spark, sf_dir), 13).select("build_number", "os_version")


def _by_type(kind: str, condition: str) -> None:
    query(f"filter_release_type_{kind}", with_(ORDER_REL) + f"SELECT build_number FROM orel WHERE {condition}")(
        lambda spark, sf_dir: S.filter_release_type(order_releases(spark, sf_dir), kind).select("build_number")
    )


_by_type("release", "NOT is_beta AND NOT is_rc")
_by_type("beta", "is_beta")
_by_type("rc", "is_rc AND NOT is_beta")

SELECTION = f"""best AS (SELECT product, os_version, build_number, row_number() OVER (PARTITION BY product, os_version
 ORDER BY CASE WHEN is_beta THEN 0 WHEN is_rc THEN 1 ELSE 2 END * 2 + CASE WHEN is_device_specific THEN 0 ELSE 1 END DESC,
 coalesce(beta_number, rc_number, 0) DESC, CASE WHEN is_beta THEN coalesce(beta_revision, 1) ELSE 0 END DESC,
 {build_order('build_number', desc=True)}, pos) AS r FROM {{rel}})"""


@query(
    "preferred_release",
    with_(ORDER_REL, SELECTION.format(rel="orel")) + "SELECT product, os_version, build_number FROM best WHERE r = 1",
)
def preferred_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The build that stands for each version."""
    return S.preferred_release(order_releases(spark, sf_dir)).select("product", "os_version", "build_number")


@query(
    "resolve_specs",
    with_(REL, SPECS, SELECTION.format(rel="rel"))
    + """SELECT spec, coalesce(build, '-') AS build, coalesce(CASE WHEN NOT bad THEN r.build_number END, '-') AS build_number,
 CASE WHEN bad THEN 'invalid' WHEN r.build_number IS NULL THEN 'unmatched' ELSE 'resolved' END AS status, n
 FROM (SELECT spec, build, n, build IS NULL AND spec LIKE '%-%' AND (spec LIKE '-%' OR regexp_matches(spec, '^[^-]*-$')) AS bad,
   CASE WHEN build IS NULL AND spec LIKE '%-%' THEN split_part(spec, '-', 1) ELSE spec END AS v,
   CASE WHEN build IS NULL AND spec LIKE '%-%' THEN substr(spec, instr(spec, '-') + 1) ELSE build END AS b FROM specs) s
 LEFT JOIN best p ON p.os_version = s.v AND p.r = 1
 LEFT JOIN rel r ON r.os_version = s.v AND r.build_number = coalesce(s.b, p.build_number)""",
)
def resolve_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release texts made from the orders, resolved."""
    specs = month_specs(spark, sf_dir)
    found = S.resolve_specs(specs.select("product", "spec", "build"), month_releases(spark, sf_dir))
    joined = specs.select("spec", F.coalesce("build", F.lit("-")).alias("build"), "n").join(
        found.select(
            "spec", F.coalesce("build", F.lit("-")).alias("build"),
            F.coalesce("build_number", F.lit("-")).alias("build_number"), "status",
        ),
        ["spec", "build"],
    )
    return joined.select("spec", "build", "build_number", "status", "n")


LOOKUP_CTE = f"""cand AS (SELECT q.build_number, q.request, c.ord, c.name, c.version,
 CASE WHEN lower(c.name) = lower(q.request) THEN 1
  WHEN trim(regexp_replace(lower(c.name), '{PAREN}', '', 'g')) = trim(regexp_replace(lower(q.request), '{PAREN}', '', 'g')) THEN 2
  WHEN contains(lower(c.name), lower(q.request)) THEN 3 END AS tier
 FROM requests q JOIN comp c ON c.build_number = q.build_number),
ranked AS (SELECT *, min(tier) OVER (PARTITION BY build_number, request) AS top,
 row_number() OVER (PARTITION BY build_number, request, tier ORDER BY ord) AS r FROM cand WHERE tier IS NOT NULL)"""
LOOKUP = """SELECT build_number, request, tier, name, coalesce(version, '-') AS version, ord FROM ranked
WHERE tier = top AND (tier = 3 OR r = 1)"""


@query("lookup_components", with_(COMP, REQUESTS, LOOKUP_CTE) + LOOKUP)
def lookup_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components for names, bare names and parts of names."""
    found = S.lookup_components(lookup_requests(spark, sf_dir), month_components(spark, sf_dir))
    return found.select(
        "build_number", "request", "tier", "name", F.coalesce("version", F.lit("-")).alias("version"), "ord"
    )


@query(
    "safe_links",
    "SELECT page_id, CASE WHEN starts_with(replace(url, 'http://th', 'https://th'), 'https://') THEN replace(url, 'http://th', 'https://th') END AS url FROM pages",
)
def safe_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages, some of them made https."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.replace("url", F.lit("http://th"), F.lit("https://th")).alias("url")
    )
    return S.safe_links(pages, "url")


@query(
    "component_projection",
    with_(COMP) + "SELECT product, build_number, name, coalesce(version, 'unknown') AS version, path, source FROM comp",
)
def component_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component lists."""
    return S.component_projection(month_components(spark, sf_dir))


@query(
    "project_release_row",
    with_(ORDER_REL, ORDER_SDK)
    + """SELECT r.product, r.os_version, r.build_number, CAST(r.release_date AS VARCHAR) AS release_date,
 CASE WHEN is_beta THEN 'beta' WHEN is_rc THEN 'rc' ELSE 'release' END AS type,
 coalesce(CASE WHEN r.product = 'Xcode' THEN r.minimum_os_version END, '-') AS minimum_os_version,
 coalesce(CASE WHEN r.product = 'Xcode' THEN s.sdk_version END, '-') AS sdk_version
 FROM orel r LEFT JOIN (SELECT build_number, arg_min(sdk_version, ord) AS sdk_version FROM osdk GROUP BY 1) s
 ON r.build_number = s.build_number""",
)
def project_release_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release list rows."""
    rows = S.project_release_row(order_releases(spark, sf_dir), order_sdks(spark, sf_dir))
    return rows.select(
        "product", "os_version", "build_number", F.col("release_date").cast("string").alias("release_date"), "type",
        F.coalesce("minimum_os_version", F.lit("-")).alias("minimum_os_version"),
        F.coalesce("sdk_version", F.lit("-")).alias("sdk_version"),
    )


@query(
    "attach_details",
    "SELECT o_orderkey, o_custkey, coalesce(c_name, '-') AS c_name, coalesce(c_mktsegment, '-') AS c_mktsegment"
    " FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def attach_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer details on the orders."""
    index = table(spark, sf_dir, "orders").select(
        F.lit("macOS").alias("product"), F.col("o_custkey").cast("string").alias("build_number"),
        "o_orderkey", "o_custkey",
    )
    details = table(spark, sf_dir, "customer").select(
        F.lit("macOS").alias("product"), F.col("c_custkey").cast("string").alias("build_number"),
        "c_name", "c_mktsegment",
    )
    return S.attach_details(index, details).select(
        "o_orderkey", "o_custkey", F.coalesce("c_name", F.lit("-")).alias("c_name"),
        F.coalesce("c_mktsegment", F.lit("-")).alias("c_mktsegment"),
    )


NEWEST = f"""SELECT *, row_number() OVER (PARTITION BY product, is_beta OR is_rc ORDER BY release_date DESC NULLS LAST,
 {padded('os_version')} DESC, {build_order('build_number', desc=True)}) AS r FROM orel"""


@query(
    "latest_releases",
    with_(ORDER_REL, f"newest AS ({NEWEST})")
    + f"""SELECT product, coalesce(g, '-') AS ga_build, CASE WHEN g IS NULL OR {direction('gv', 'pv')} = 'upgraded'
 THEN p ELSE '-' END AS prerelease_build FROM (
 SELECT product, max(build_number) FILTER (NOT (is_beta OR is_rc)) AS g, max(os_version) FILTER (NOT (is_beta OR is_rc)) AS gv,
  max(build_number) FILTER (is_beta OR is_rc) AS p, max(os_version) FILTER (is_beta OR is_rc) AS pv
 FROM newest WHERE r = 1 GROUP BY product)""",
)
def latest_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest final release and pending pre-release per product."""
    return S.latest_releases(order_releases(spark, sf_dir)).select(
        "product", F.coalesce("ga.build_number", F.lit("-")).alias("ga_build"),
        F.coalesce("prerelease.build_number", F.lit("-")).alias("prerelease_build"),
    )


@query(
    "release_stats",
    with_(ORDER_REL) + "SELECT product, count(*) AS total, count(*) FILTER (NOT is_beta AND NOT is_rc) AS final FROM orel GROUP BY 1",
)
def release_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release counts."""
    return S.release_stats(order_releases(spark, sf_dir))


@query(
    "releases_by_major",
    with_(ORDER_REL)
    + """SELECT product, split_part(os_version, '.', 1) AS major, count(*) AS releases,
 coalesce(arg_min(release_name, (release_date, -pos)) FILTER (product <> 'Xcode' AND release_name <> ''), '-') AS label
 FROM orel GROUP BY 1, 2""",
)
def releases_by_major(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases per major version."""
    return S.releases_by_major(order_releases(spark, sf_dir)).select(
        "product", "major", "releases", F.coalesce("label", F.lit("-")).alias("label")
    )


LABELS_SQL = f"""SELECT build_number, {DISPLAY.format(named='true')} AS site, {DISPLAY.format(named='false')} AS short,
 CASE WHEN product = 'Xcode' THEN 'Xcode ' || os_version ELSE 'macOS ' || os_version || ' ' || release_name END ||
 CASE WHEN NOT is_beta THEN '' WHEN beta_number IS NULL THEN ' Beta' ELSE ' Developer Beta ' || CAST(beta_number AS VARCHAR) ||
  CASE WHEN beta_revision IS NULL THEN '' ELSE ' v.' || CAST(beta_revision AS VARCHAR) END END AS cli,
 os_version || '-' || build_number AS slug, strftime(release_date, '%b %-d, %Y') AS short_date,
 strftime(release_date, '%B %-d, %Y') AS long_date FROM orel"""


@query("release_labels", with_(ORDER_REL) + LABELS_SQL)
def release_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, slugs and dates of releases as text."""
    return order_releases(spark, sf_dir).select(
        "build_number",
        L.display_name().alias("site"),
        L.display_name(include_release_name=False).alias("short"),
        L.cli_display_name().alias("cli"),
        L.release_slug().alias("slug"),
        L.format_date("release_date").alias("short_date"),
        L.format_date("release_date", "long").alias("long_date"),
    )


@query(
    "component_labels",
    f"""SELECT p_partkey, {SLUG.format(n="name")} AS slug, coalesce(version, 'unknown') AS version,
 CASE lower(product) WHEN 'macos' THEN 'macOS' WHEN 'xcode' THEN 'Xcode' ELSE CASE WHEN product IS NULL THEN 'macOS' ELSE '-' END END AS product
 FROM (SELECT p_partkey, p_name || ' (' || p_brand || ') x (' || p_type || ')' AS name, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS version,
 CASE p_size % 4 WHEN 0 THEN NULL WHEN 1 THEN 'MACOS' WHEN 2 THEN 'xcode' ELSE 'other' END AS product FROM part)""",
)
def component_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slugs, shown versions and product names of parts."""
    size = F.col("p_size")
    parts = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" ("), "p_brand", F.lit(") x ("), "p_type", F.lit(")")).alias("name"),
        F.when(size % 2 == 0, size.cast("string")).alias("version"),
        F.when(size % 4 == 1, "MACOS").when(size % 4 == 2, "xcode").when(size % 4 == 3, "other").alias("product"),
    )
    return parts.select(
        "p_partkey", L.component_slug("name").alias("slug"), L.display_version().alias("version"),
        F.coalesce(L.resolved_product_type("product"), F.lit("-")).alias("product"),
    )


@query(
    "file_from_url",
    """SELECT page_id, coalesce(CASE WHEN wrapped <> '' THEN regexp_extract(wrapped, '([^/]*)$', 1) ELSE nullif(last, '') END, '-') AS file FROM (
 SELECT page_id, coalesce(regexp_extract(split_part(url, '#', 1), '[?&]path=([^&]*)', 1), '') AS wrapped,
  regexp_extract(rtrim(split_part(split_part(url, '#', 1), '?', 1), '/'), '^[a-z]+://[^/]+/(?:.*/)?([^/]*)$', 1) AS last FROM (
  SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END ||
   'path=/apps/v' || page_id || '/file-' || page_id || '.xip' ELSE url END AS url FROM pages))""",
)
def file_from_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File names of page links, some with the file in a query parameter."""
    page = F.col("page_id").cast("string")
    joint = F.when(F.col("url").contains("?"), "&").otherwise("?")
    link = F.when(
        F.col("page_id") % 3 == 0,
        F.concat("url", joint, F.lit("path=/apps/v"), page, F.lit("/file-"), page, F.lit(".xip")),
    ).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.coalesce(L.file_from_url(link), F.lit("-")).alias("file")
    )
