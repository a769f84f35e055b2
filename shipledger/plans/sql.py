"""Pieces of the checking SQL: the derived catalogue and the version order.

The version order is written as a comparison of padded token lists here, unlike the text
keys of the library.
"""

from __future__ import annotations

MONTH_BUILD = """CAST(year({d}) - 1984 AS VARCHAR) || chr(64 + CAST(month({d}) AS INT)) ||
 CAST(CASE {f} WHEN 'A' THEN 5000 + month({d}) WHEN 'R' THEN 300 + month({d})
      ELSE 80 + month({d}) END AS VARCHAR) || CASE {f} WHEN 'A' THEN 'a' ELSE '' END"""

LINE_TAX = "CAST(round(l_tax * 100) AS INT)"
LINE_ORD = f"""((l_orderkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT)) * 10 + {LINE_TAX}"""
LINE_NAME = """'Part-' || CAST(l_partkey AS VARCHAR) ||
 CASE WHEN l_partkey % 5 = 0 THEN ' (Compat)' ELSE '' END"""
LINE_VERSION = f"""CASE {LINE_TAX} WHEN 8 THEN NULL WHEN 7 THEN 'unknown' ELSE
 CAST(l_linenumber AS VARCHAR) || '.' || CAST(CAST(l_quantity AS INT) AS VARCHAR) ||
 CASE {LINE_TAX} WHEN 1 THEN 'p1' WHEN 2 THEN '.0' WHEN 3 THEN ' (build 9)' WHEN 4 THEN 'a'
  WHEN 5 THEN '.0.1' WHEN 6 THEN 'B2' ELSE '' END END"""
LINE_PATH = "'/usr/lib/' || CAST(l_partkey AS VARCHAR) || '.dylib'"
LINE_SOURCE = "CASE WHEN l_partkey % 2 = 0 THEN 'filesystem' ELSE 'dyldCache' END"

COMP = f"""comp AS (SELECT 'macOS' AS product,
 {MONTH_BUILD.format(d='l_shipdate', f='l_returnflag')} AS build_number,
 {LINE_ORD} AS ord, {LINE_NAME} AS name, {LINE_VERSION} AS version, {LINE_PATH} AS path,
 {LINE_SOURCE} AS source FROM lineitem)"""

RELEASE_NAME = """CASE {m} WHEN 11 THEN 'Big Sur' WHEN 12 THEN 'Monterey' WHEN 13 THEN 'Ventura'
 WHEN 14 THEN 'Sonoma' WHEN 15 THEN 'Sequoia' WHEN 26 THEN 'Tahoe' WHEN 27 THEN 'Golden Gate'
 ELSE 'macOS ' || CAST({m} AS VARCHAR) END"""

REL = f"""relbase AS (SELECT {MONTH_BUILD.format(d='l_shipdate', f='l_returnflag')} AS build_number,
 year(l_shipdate) - 1984 AS maj, month(l_shipdate) AS mon, l_returnflag AS flag,
 count(*) AS n, CAST(max(l_shipdate) AS DATE) AS release_date
 FROM lineitem GROUP BY 1, 2, 3, 4),
rel AS (SELECT 'macOS' AS product, CAST(maj AS VARCHAR) || '.' || CAST(mon AS VARCHAR) AS os_version,
 build_number, maj, mon, {RELEASE_NAME.format(m='maj')} AS release_name, release_date,
 flag = 'A' AS is_beta,
 CASE WHEN flag = 'A' AND n % 5 <> 0 THEN 1 + n % 4 END AS beta_number,
 CASE WHEN flag = 'A' AND n % 5 <> 0 AND n % 3 = 0 THEN 2 END AS beta_revision,
 flag = 'R' AS is_rc,
 CASE WHEN flag = 'R' AND n % 2 = 0 THEN 1 + n % 3 END AS rc_number,
 flag = 'N' AND n % 4 = 0 AS is_device_specific,
 CASE flag WHEN 'A' THEN 0 WHEN 'R' THEN 1 ELSE 2 END AS maturity,
 ((200 - maj) * 12 + 12 - mon) * 3 + CASE flag WHEN 'A' THEN 2 WHEN 'R' THEN 1 ELSE 0 END AS pos
 FROM relbase)"""

PAREN = r"\s*\([^)]*\)"


def tokens(v: str) -> str:
    """List of (rank, number, letters) of a version text."""
    clean = f"regexp_replace(regexp_replace({v}, '{PAREN}', '', 'g'), '^[^0-9]+', '')"
    return f"""list_transform(regexp_extract_all({clean}, '[0-9]+|[A-Za-z]+'), lambda t:
 CASE WHEN regexp_matches(t, '^[0-9]') THEN
  {{'r': CASE WHEN coalesce(TRY_CAST(t AS BIGINT), 0) = 0 THEN 0 ELSE 2 END,
    'n': coalesce(TRY_CAST(t AS BIGINT), 0), 't': ''}}
 ELSE {{'r': 1, 'n': CAST(0 AS BIGINT), 't': lower(t)}} END)"""


def padded(v: str) -> str:
    """Token list padded with zeros, so that a missing token equals zero."""
    return f"list_resize({tokens(v)}, greatest(256, len({tokens(v)})), {{'r': 0, 'n': CAST(0 AS BIGINT), 't': ''}})"


def direction(a: str, b: str) -> str:
    """Direction from version ``a`` to ``b``."""
    return f"""CASE WHEN len({tokens(a)}) = 0 OR len({tokens(b)}) = 0 THEN 'unchanged'
 WHEN {padded(a)} < {padded(b)} THEN 'upgraded'
 WHEN {padded(a)} > {padded(b)} THEN 'downgraded' ELSE 'unchanged' END"""


BUILD_PARTS = """coalesce(TRY_CAST(regexp_extract({b}, '^([0-9]*)([A-Za-z]*)([0-9]*)(.*)$', 1) AS BIGINT), 0){sep}
 regexp_extract({b}, '^([0-9]*)([A-Za-z]*)([0-9]*)(.*)$', 2){sep}
 coalesce(TRY_CAST(regexp_extract({b}, '^([0-9]*)([A-Za-z]*)([0-9]*)(.*)$', 3) AS BIGINT), 0){sep}
 regexp_extract({b}, '^([0-9]*)([A-Za-z]*)([0-9]*)(.*)$', 4){end}"""


def build_order(b: str, desc: bool = False) -> str:
    """ORDER BY items of a build number."""
    word = " DESC" if desc else ""
    return BUILD_PARTS.format(b=b, sep=f"{word},", end=word)


SLUG = r"lower(trim(regexp_replace({n}, '\s*\(.*\)', '')))"

DISPLAY = """CASE WHEN product = 'Xcode' THEN 'Xcode ' || os_version
 WHEN {named} AND coalesce(release_name, '') <> '' THEN 'macOS ' || os_version || ' ' || release_name
 ELSE 'macOS ' || os_version END ||
 CASE WHEN is_beta AND coalesce(beta_number, 0) <> 0 THEN ' beta ' || CAST(beta_number AS VARCHAR) ||
  CASE WHEN coalesce(beta_revision, 0) <> 0 THEN ' v.' || CAST(beta_revision AS VARCHAR) ELSE '' END
 WHEN is_rc THEN ' RC' || CASE WHEN coalesce(rc_number, 0) <> 0 THEN ' ' || CAST(rc_number AS VARCHAR) ELSE '' END
 ELSE '' END"""

PAIRS = """pairs AS (SELECT product, build_number AS to_build,
 lead(build_number) OVER (PARTITION BY product ORDER BY release_date DESC NULLS LAST, pos) AS from_build
 FROM rel)"""

FIRSTS = """firsts AS (SELECT product, build_number, name, arg_min(coalesce(version, ''), ord) AS version
 FROM comp GROUP BY 1, 2, 3)"""

DIFF = f"""diff AS (SELECT product, from_build, to_build, name, from_version, to_version,
 CASE WHEN from_version IS NULL THEN 'added' WHEN to_version IS NULL THEN 'removed'
 WHEN from_version = to_version THEN 'unchanged'
 ELSE {direction('from_version', 'to_version')} END AS status FROM (
 SELECT coalesce(f.product, t.product) AS product, coalesce(f.from_build, t.from_build) AS from_build,
  coalesce(f.to_build, t.to_build) AS to_build, coalesce(f.name, t.name) AS name,
  f.version AS from_version, t.version AS to_version
 FROM (SELECT p.*, name, version FROM pairs p JOIN firsts c
       ON c.product = p.product AND c.build_number = p.from_build) f
 FULL OUTER JOIN (SELECT p.*, name, version FROM pairs p JOIN firsts c
       ON c.product = p.product AND c.build_number = p.to_build WHERE p.from_build IS NOT NULL) t
 ON f.product = t.product AND f.from_build = t.from_build AND f.to_build = t.to_build AND f.name = t.name))"""


def with_(*parts: str) -> str:
    """A WITH clause of the given parts."""
    return "WITH " + ",\n".join(parts) + "\n"

ORDER_MAJOR, ORDER_MINOR = "(11 + o_custkey % 17)", "(o_custkey % 7)"
ORDER_REL = f"""orel AS (SELECT CASE WHEN o_orderstatus = 'P' THEN 'Xcode' ELSE 'macOS' END AS product,
 CAST({ORDER_MAJOR} AS VARCHAR) || '.' || CAST({ORDER_MINOR} AS VARCHAR) ||
  CASE WHEN o_custkey % 3 = 0 THEN '.' || CAST(o_orderkey % 10 AS VARCHAR) ELSE '' END AS os_version,
 CAST({ORDER_MAJOR} AS VARCHAR) || chr(CAST(65 + {ORDER_MINOR} AS INT)) || CAST(o_orderkey AS VARCHAR) ||
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'a' ELSE '' END AS build_number,
 {RELEASE_NAME.format(m=ORDER_MAJOR)} AS release_name, CAST(o_orderdate AS DATE) AS release_date,
 o_orderpriority = '1-URGENT' AS is_beta,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 4 <> 0 THEN 1 + o_orderkey % 9 END AS beta_number,
 CASE WHEN o_orderpriority = '1-URGENT' AND o_orderkey % 8 = 1 THEN 2 END AS beta_revision,
 o_orderpriority = '2-HIGH' AS is_rc,
 CASE WHEN o_orderpriority = '2-HIGH' AND o_orderkey % 3 <> 0 THEN 1 + o_orderkey % 3 END AS rc_number,
 o_orderstatus <> 'P' AND o_orderpriority = '3-MEDIUM' AS is_device_specific,
 CASE WHEN o_orderstatus = 'P' THEN CAST({ORDER_MAJOR} AS VARCHAR) || '.0' END AS minimum_os_version,
 o_orderkey AS pos, o_orderkey AS order_key FROM orders)"""

ORDER_SDK = """osdk AS (SELECT r.product, r.build_number,
 (l_partkey * 10 + l_linenumber) * 100 + CAST(l_quantity AS INT) AS ord,
 CAST(11 + l_partkey % 17 AS VARCHAR) || '.' || CAST(l_linenumber % 4 AS VARCHAR) AS sdk_version,
 CASE WHEN l_partkey % 6 <> 0 THEN CAST(20 + l_partkey % 9 AS VARCHAR) || chr(CAST(65 + l_partkey % 5 AS INT)) ||
  CAST(l_partkey % 40 AS VARCHAR) END AS build_version
 FROM orel r JOIN lineitem ON l_orderkey = r.order_key WHERE r.product = 'Xcode')"""

SPECS = f"""specs AS (SELECT spec, build, count(*) AS n FROM (
 SELECT CASE kind WHEN 0 THEN v WHEN 3 THEN v WHEN 4 THEN v || '-' ELSE v || '-' || b END AS spec,
  CASE WHEN kind = 3 THEN b END AS build FROM (
  SELECT kind, CAST(year(o_orderdate) - 1984 AS VARCHAR) || '.' || CAST(month(o_orderdate) AS VARCHAR) AS v,
   {MONTH_BUILD.format(d='o_orderdate', f='flag')} AS b FROM (
   SELECT o_orderdate, o_custkey % 5 AS kind,
    CASE o_custkey % 5 WHEN 1 THEN 'A' WHEN 2 THEN 'R' ELSE 'N' END AS flag FROM orders))) GROUP BY 1, 2)"""

REQUESTS = """requests AS (SELECT DISTINCT '13' || chr(CAST(65 + s_nationkey % 12 AS INT)) ||
  CAST(81 + s_nationkey % 12 AS VARCHAR) AS build_number,
 CASE s_suppkey % 4 WHEN 0 THEN 'PART-' || CAST(s_suppkey * 3 AS VARCHAR)
  WHEN 1 THEN 'part-' || CAST(s_suppkey * 5 AS VARCHAR) WHEN 2 THEN 'T-' || CAST(s_suppkey AS VARCHAR)
  ELSE 'none-' || CAST(s_suppkey AS VARCHAR) END AS request FROM supplier)"""
