"""Queries on kernels, devices and chips."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.fixed import BOARD_KERNEL_DEVICES, CHIP_FAMILIES, CHIP_TIERS, DEVICES
from shipledger.functions.chips import chip_sort_key
from shipledger.operators import flatten
from shipledger.operators import hardware as W
from shipledger.plans.catalogue import ARCH_CYCLE, table
from shipledger.plans.registry import query
from shipledger.plans.sql import with_
from shipledger.session import constant_table


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest identities: every customer is a device of the kernel of its nation."""
    key, nation = F.col("c_custkey"), F.col("c_nationkey")
    device = (
        F.when(key % 5 == 0, F.concat(F.lit("Mac"), (13 + key % 5).cast("string"), F.lit(","), (1 + key % 15).cast("string")))
        .when(key % 5 == 1, F.concat(F.lit("MacBookPro18,"), (1 + key % 4).cast("string")))
        .when(key % 5 == 2, F.concat(F.lit("iMac21,"), (1 + key % 2).cast("string")))
        .when(key % 5 == 3, F.concat(F.lit("Mac17,"), (2 + key % 9).cast("string")))
    )
    kind = F.when(nation % 6 == 5, "development").otherwise("release")
    return table(spark, sf_dir, "customer").select(
        F.lit("macOS").alias("product"),
        F.concat(F.lit("24"), F.substring("c_mktsegment", 1, 1), F.lit("100")).alias("build_number"),
        device.alias("device"),
        F.concat(F.lit("Firmware/all/kernelcache."), kind, F.lit(".n"), nation.cast("string")).alias("kernel_path"),
        nation.alias("nation"),
    )


def kernels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels of the derived releases; every third one lists its devices."""
    rows = identities(spark, sf_dir)
    nation = F.col("nation")
    listed = W.kernel_device_map(rows)
    archs = F.array(*[F.lit(a) for a in ARCH_CYCLE])
    base = rows.groupBy("product", "build_number", "nation", F.substring_index("kernel_path", "/", -1).alias("file")).agg(F.count("*").alias("n"))
    return base.join(listed, ["product", "build_number", "file"], "left").select(
        "product", "build_number", nation.alias("ord"), "file",
        F.concat(F.lit("24."), nation.cast("string"), F.lit(".0")).alias("darwin_version"),
        F.concat(F.lit("113."), nation.cast("string")).alias("xnu_version"),
        F.element_at(archs, nation + 1).alias("arch"),
        F.when(nation % 4 == 0, "Unknown").when(nation % 4 == 1, "M2 Max").when(nation % 4 == 2, "T9999").otherwise("Virtual Mac").alias("chip"),
        F.when(nation % 3 == 0, F.coalesce("devices", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")).alias("devices"),
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest map of the releases, without every second file."""
    rows = identities(spark, sf_dir).withColumn(
        "kernel_path", F.when(F.col("nation") % 2 == 0, F.col("kernel_path"))
    )
    return W.kernel_device_map(rows)


def boards(spark: SparkSession) -> DataFrame:
    """Fallback devices by file: the fixed ones and two of the derived names."""
    more = constant_table(
        spark,
        [("kernelcache.release.n1", ["Mac14,2"]), ("kernelcache.release.n11", ["Mac15,3", "iMac21,1"])],
        "file string, devices array<string>",
    )
    return W.board_devices_table(spark).unionByName(more)


def resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernels with devices from all sources."""
    return W.resolve_kernel_devices(kernels(spark, sf_dir), manifest(spark, sf_dir), boards(spark))


def chips_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device chips of the resolved kernels."""
    return W.resolve_device_chips(resolved(spark, sf_dir), W.devices_table(spark))


def _values(rows: list[tuple], columns: str) -> str:
    quoted = ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)
    return f"(VALUES {quoted}) AS v({columns})"


IDENT = """ident AS (SELECT '24' || substr(c_mktsegment, 1, 1) || '100' AS build_number, c_nationkey AS nation,
 'kernelcache.' || CASE WHEN c_nationkey % 6 = 5 THEN 'development' ELSE 'release' END || '.n' || c_nationkey AS file,
 CASE c_custkey % 5 WHEN 0 THEN 'Mac' || (13 + c_custkey % 5) || ',' || (1 + c_custkey % 15)
 WHEN 1 THEN 'MacBookPro18,' || (1 + c_custkey % 4) WHEN 2 THEN 'iMac21,' || (1 + c_custkey % 2)
 WHEN 3 THEN 'Mac17,' || (2 + c_custkey % 9) END AS device FROM customer)"""
LISTED = """listed AS (SELECT build_number, file, nation, list_sort(list(DISTINCT device)) AS devices
 FROM ident WHERE device IS NOT NULL GROUP BY 1, 2, 3)"""
ARCHS = "[" + ", ".join(f"'{a}'" for a in ARCH_CYCLE) + "]"
KERN = f"""kern AS (SELECT i.build_number, i.nation AS ord, i.file, {ARCHS}[i.nation + 1] AS arch,
 '24.' || i.nation || '.0' AS darwin_version, '113.' || i.nation AS xnu_version,
 CASE i.nation % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN 'M2 Max' WHEN 2 THEN 'T9999' ELSE 'Virtual Mac' END AS chip,
 CASE WHEN i.nation % 3 = 0 THEN coalesce(l.devices, []) ELSE [] END AS devices
 FROM (SELECT DISTINCT build_number, nation, file FROM ident) i LEFT JOIN listed l USING (build_number, file))"""
BOARD_ROWS = [(f, "|".join(d)) for f, d in BOARD_KERNEL_DEVICES.items()] + [
    ("kernelcache.release.n1", "Mac14,2"), ("kernelcache.release.n11", "Mac15,3|iMac21,1"),
]
FULL = f"""board AS (SELECT file, string_split(d, '|') AS devices FROM {_values(BOARD_ROWS, 'file, d')}),
full_ AS (SELECT k.* REPLACE (CASE WHEN len(k.devices) > 0 THEN k.devices ELSE
  coalesce(m.devices, b.devices, r.devices, []) END AS devices) FROM kern k
 LEFT JOIN (SELECT * FROM listed WHERE nation % 2 = 0) m ON m.build_number = k.build_number AND m.file = k.file
 LEFT JOIN board b ON b.file = k.file
 LEFT JOIN board r ON r.file = replace(k.file, '.development.', '.release.'))"""
DEVCHIP = f"""reg AS (SELECT * FROM {_values(DEVICES, 'device, chip, marketing_name')}),
devchip AS (SELECT build_number, file AS kernel_file, ord AS kernel_ord, i - 1 AS ord, x.device, reg.chip FROM (
 SELECT build_number, file, ord, unnest(devices) AS device, generate_subscripts(devices, 1) AS i FROM full_) x JOIN reg USING (device))"""
FAMILY_ROWS = [(n, str(CHIP_TIERS.index(t))) for n, t, _ in CHIP_FAMILIES]
SUFFIX_ROWS = [(s, n) for n, _, suffixes in CHIP_FAMILIES for s in suffixes]
FAM = f"""fam AS (SELECT * FROM {_values(FAMILY_ROWS, 'family, tier')}),
suf AS (SELECT * FROM {_values(SUFFIX_ROWS, 'suffix, family')})"""
BASE = [IDENT, LISTED, KERN, FULL, DEVCHIP]


@query(
    "kernel_device_map",
    with_(IDENT, LISTED) + "SELECT build_number, file, array_to_string(devices, '|') AS devices FROM listed",
)
def kernel_device_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of each kernel file of the manifests."""
    return W.kernel_device_map(identities(spark, sf_dir)).select(
        "build_number", "file", F.array_join("devices", "|").alias("devices")
    )


@query(
    "resolve_kernel_devices",
    with_(*BASE) + "SELECT build_number, file, array_to_string(devices, '|') AS devices FROM full_",
)
def resolve_kernel_devices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices of each kernel from own list, manifest and fallbacks."""
    return resolved(spark, sf_dir).select("build_number", "file", F.array_join("devices", "|").alias("devices"))


@query(
    "resolve_device_chips",
    with_(*BASE) + "SELECT build_number, kernel_file, ord, device, chip FROM devchip",
)
def resolve_device_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of the devices the registry knows."""
    return chips_of(spark, sf_dir).select("build_number", "kernel_file", "ord", "device", "chip")


@query(
    "chip_label",
    with_(*BASE)
    + """SELECT k.build_number, k.file, CASE WHEN k.chip = 'Unknown' AND c.n > 0 THEN
 CASE WHEN c.n = 1 THEN c.low ELSE 'Multiple' END ELSE k.chip END AS chip FROM full_ k LEFT JOIN (
 SELECT build_number, kernel_file, count(DISTINCT chip) AS n, min(chip) AS low FROM devchip GROUP BY 1, 2) c
 ON c.build_number = k.build_number AND c.kernel_file = k.file""",
)
def chip_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip labels of kernels."""
    return W.chip_label(resolved(spark, sf_dir), chips_of(spark, sf_dir)).select("build_number", "file", "chip")


@query(
    "device_names",
    with_(IDENT, f"reg AS (SELECT * FROM {_values(DEVICES, 'device, chip, marketing_name')})")
    + """SELECT device_name, count(*) AS n FROM (SELECT coalesce(marketing_name, i.device, '-') AS device_name
 FROM ident i LEFT JOIN reg USING (device)) GROUP BY 1""",
)
def device_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the devices of all customers."""
    named = W.device_names(identities(spark, sf_dir), W.devices_table(spark))
    return named.groupBy(F.coalesce("device_name", F.lit("-")).alias("device_name")).agg(F.count("*").alias("n"))


@query(
    "chip_from_arch",
    with_(IDENT, LISTED, KERN, FAM)
    + """SELECT build_number, file, arch, coalesce(family, '-') AS family FROM kern LEFT JOIN suf
 ON contains(arch, '_') AND suffix = split_part(arch, '_', -1)""",
)
def chip_from_arch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip family of every kernel architecture."""
    return W.chip_from_arch(kernels(spark, sf_dir), W.arch_table(spark)).select(
        "build_number", "file", "arch", F.coalesce("family", F.lit("-")).alias("family")
    )


@query(
    "chip_grid",
    with_(*BASE)
    + """SELECT build_number, chip, device, min(kernel_ord * 1000 + ord) AS first,
 min(min(kernel_ord * 1000 + ord)) OVER (PARTITION BY build_number, chip) AS chip_first FROM devchip GROUP BY 1, 2, 3""",
)
def chip_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices per chip with first positions."""
    def place(name: str):
        return (F.col(f"{name}.kernel_ord") * 1000 + F.col(f"{name}.ord")).alias(name)

    return W.chip_grid(chips_of(spark, sf_dir)).select(
        "build_number", "chip", "device", place("first"), place("chip_first")
    )


@query(
    "supported_chips",
    with_(*BASE, FAM)
    + """SELECT build_number, string_agg(family, '|' ORDER BY first) AS chips FROM (
 SELECT build_number, family, min(place) AS first FROM (
  SELECT build_number, chip AS family, kernel_ord * 1000 + ord AS place FROM devchip
  UNION ALL
  SELECT k.build_number, coalesce(f.family, s.family), k.ord * 1000 FROM full_ k
  LEFT JOIN fam f ON f.family = k.chip LEFT JOIN suf s ON contains(k.arch, '_') AND s.suffix = split_part(k.arch, '_', -1)
  WHERE NOT EXISTS (SELECT 1 FROM devchip d WHERE d.build_number = k.build_number AND d.kernel_ord = k.ord))
 WHERE family IS NOT NULL GROUP BY 1, 2) GROUP BY 1""",
)
def supported_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chip families of every release."""
    found = W.supported_chips(
        resolved(spark, sf_dir), chips_of(spark, sf_dir), W.chips_table(spark), W.arch_table(spark)
    )
    return found.select("build_number", F.array_join("chips", "|").alias("chips"))


GENERATION = """CASE WHEN {c} = 'A18 Pro' THEN 5 WHEN regexp_matches({c}, '^M[0-9]+ *(Pro|Max|Ultra)?$')
 THEN CAST(regexp_extract({c}, '^M([0-9]+)', 1) AS INT) ELSE 0 END"""
TIER = """CASE WHEN {c} = 'A18 Pro' THEN 4 WHEN NOT regexp_matches({c}, '^M[0-9]+ *(Pro|Max|Ultra)?$')
 THEN CASE WHEN contains({c}, 'Virtual') THEN 0 ELSE 1 END WHEN {c} LIKE '%Ultra' THEN 3 WHEN {c} LIKE '%Max' THEN 2
 WHEN {c} LIKE '%Pro' THEN 1 ELSE 0 END"""


@query(
    "kernel_summary",
    with_(*BASE)
    + f"""SELECT s.*, {GENERATION.format(c='lead_chip')} AS generation, {TIER.format(c='lead_chip')} AS tier FROM (
 SELECT k.build_number, k.file, k.arch, contains(k.file, 'development') AS is_dev,
 first_value(k.darwin_version) OVER (PARTITION BY k.build_number ORDER BY k.ord) AS darwin_version,
 first_value(k.xnu_version) OVER (PARTITION BY k.build_number ORDER BY k.ord) AS xnu_version,
 coalesce(c.chips, k.chip) AS chips, split_part(coalesce(c.chips, k.chip), '|', 1) AS lead_chip
 FROM full_ k LEFT JOIN (SELECT build_number, kernel_file, string_agg(chip, '|' ORDER BY tier, first) AS chips FROM (
  SELECT build_number, kernel_file, chip, min(ord) AS first, {TIER.format(c='chip')} AS tier FROM devchip GROUP BY 1, 2, 3)
  GROUP BY 1, 2) c ON c.build_number = k.build_number AND c.kernel_file = k.file) s""",
)
def kernel_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kernel rows of every release."""
    rows = W.kernel_summary(resolved(spark, sf_dir), chips_of(spark, sf_dir))
    return rows.select(
        "build_number", "file", "arch", "is_dev", "darwin_version", "xnu_version",
        F.array_join("chips", "|").alias("chips"), F.col("chips")[0].alias("lead_chip"), "generation", "tier",
    )


CHIP_TEXT = "chip AS (SELECT c_custkey, {} AS chip FROM customer)".format(
    """CASE c_custkey % 7 WHEN 0 THEN 'M' || (1 + c_custkey % 5) WHEN 1 THEN 'M' || (1 + c_custkey % 5) || ' Pro'
 WHEN 2 THEN 'M' || (1 + c_custkey % 5) || ' Max' WHEN 3 THEN 'M' || (1 + c_custkey % 5) || ' Ultra'
 WHEN 4 THEN 'A18 Pro' WHEN 5 THEN 'Virtual Mac' ELSE 'T' || c_custkey END"""
)


@query(
    "chip_sort_key",
    with_(CHIP_TEXT, FAM)
    + f"""SELECT c_custkey, {GENERATION.format(c='chip')} AS generation, {TIER.format(c='chip')} AS tier,
 coalesce(CAST(fam.tier AS INT), -1) AS tier_rank FROM chip LEFT JOIN fam ON family = chip""",
)
def chip_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sort keys and tier ranks of chip labels."""
    key = F.col("c_custkey")
    number = (1 + key % 5).cast("string")
    label = (
        F.when(key % 7 == 0, F.concat(F.lit("M"), number))
        .when(key % 7 == 1, F.concat(F.lit("M"), number, F.lit(" Pro")))
        .when(key % 7 == 2, F.concat(F.lit("M"), number, F.lit(" Max")))
        .when(key % 7 == 3, F.concat(F.lit("M"), number, F.lit(" Ultra")))
        .when(key % 7 == 4, "A18 Pro")
        .when(key % 7 == 5, "Virtual Mac")
        .otherwise(F.concat(F.lit("T"), key.cast("string")))
    )
    rows = table(spark, sf_dir, "customer").select("c_custkey", label.alias("family"))
    return rows.join(W.chips_table(spark), "family", "left").select(
        "c_custkey", chip_sort_key("family").alias("k"), F.coalesce("tier_rank", F.lit(-1)).alias("tier_rank")
    ).select("c_custkey", "k.generation", "k.tier", "tier_rank")


@query(
    "devices_from_filename",
    """SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN 'Mac' || s_nationkey || ',1|Mac' || s_nationkey || ',2|Mac' || s_nationkey || ',' || s_suppkey
 WHEN 1 THEN 'MacBookAir' || s_nationkey || ',1|MacBookPro' || s_suppkey || ',1|MacBookPro' || s_suppkey || ',7'
 WHEN 2 THEN 'VirtualMac2,' || s_suppkey ELSE '' END AS devices FROM supplier""",
)
def devices_from_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Devices in kernel file names made from suppliers."""
    key, nation = F.col("s_suppkey").cast("string"), F.col("s_nationkey").cast("string")
    kind = F.col("s_suppkey") % 4
    name = (
        F.when(kind == 0, F.concat(F.lit("kernelcache.release.Mac"), nation, F.lit(",1_2_"), key))
        .when(kind == 1, F.concat(F.lit("kernelcache.development.MacBookAir"), nation, F.lit(",1_MacBookPro"), key, F.lit(",1_7")))
        .when(kind == 2, F.concat(F.lit("kernelcache.release.VirtualMac2,"), key))
        .otherwise(F.concat(F.lit("kernelcache.release.mac"), nation, F.lit("g")))
    )
    return table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.array_join(W.devices_from_filename(name), "|").alias("devices")
    )


@query(
    "explode_device_chips",
    with_(*BASE) + "SELECT build_number, kernel_file, device, chip FROM devchip",
)
def explode_device_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Device chips of nested release documents; kernels stand in for components."""
    rows = resolved(spark, sf_dir)
    nothing = F.lit(None).cast("string")
    releases = rows.select("product", "build_number").distinct().select(
        "product", "build_number", F.lit("24.0").alias("os_version"), F.lit("").alias("release_name"),
        F.lit(None).cast("date").alias("release_date"), nothing.alias("file"), nothing.alias("url"),
        F.lit(False).alias("is_beta"), F.lit(None).cast("int").alias("beta_number"),
        F.lit(None).cast("int").alias("beta_revision"), F.lit(False).alias("is_rc"),
        F.lit(None).cast("int").alias("rc_number"), F.lit(False).alias("is_device_specific"),
        nothing.alias("minimum_os_version"),
    )
    files = rows.select(
        "product", "build_number", "ord", F.col("file").alias("name"), F.col("chip").alias("version"),
        F.col("arch").alias("path"), F.lit("filesystem").alias("source"),
    )
    nested = flatten.nest_release(releases, files, rows, chips_of(spark, sf_dir))
    return flatten.explode_device_chips(nested).select("build_number", "kernel_file", "device", "chip")
