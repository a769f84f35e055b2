"""Kernels, devices and chips of releases.

``kernels`` needs product, build_number, ord, file, darwin_version, xnu_version, arch, chip
and devices; ``device_chips`` needs product, build_number, kernel_file, kernel_ord, ord,
device and chip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.fixed import BOARD_KERNEL_DEVICES, CHIP_FAMILIES, DEVICES
from shipledger.functions.chips import chip_sort_key, tier_rank
from shipledger.session import constant_table

RELEASE = ["product", "build_number"]


def devices_table(spark: SparkSession) -> DataFrame:
    """The fixed device registry."""
    return constant_table(spark, DEVICES, "device string, chip string, marketing_name string")


def chips_table(spark: SparkSession) -> DataFrame:
    """The fixed chip families: family, tier, tier_rank."""
    rows = [(name, tier) for name, tier, _ in CHIP_FAMILIES]
    return constant_table(spark, rows, "family string, tier string").withColumn(
        "tier_rank", tier_rank("tier")
    )


def arch_table(spark: SparkSession) -> DataFrame:
    """The fixed architecture suffixes: suffix, family."""
    rows = [(suffix, name) for name, _, suffixes in CHIP_FAMILIES for suffix in suffixes]
    return constant_table(spark, rows, "suffix string, family string")


def board_devices_table(spark: SparkSession) -> DataFrame:
    """The fixed devices of kernel files that are named by board."""
    return constant_table(
        spark, list(BOARD_KERNEL_DEVICES.items()), "file string, devices array<string>"
    )


def resolve_kernel_devices(kernels: DataFrame, manifest: DataFrame, fallback: DataFrame) -> DataFrame:
    """Fill the devices of kernels without any: from the manifest of the release, else from the
    fallback table by file, else by the file's release variant."""
    own = F.size("devices") > 0
    variant = F.replace(F.col("file"), F.lit(".development."), F.lit(".release."))
    listed = manifest.select(*RELEASE, "file", F.col("devices").alias("_manifest"))
    board = fallback.select("file", F.col("devices").alias("_board"))
    release_board = fallback.select(
        F.col("file").alias("_variant"), F.col("devices").alias("_release_board")
    )
    return (
        kernels.withColumn("_variant", variant)
        .join(listed, [*RELEASE, "file"], "left")
        .join(board, "file", "left")
        .join(release_board, "_variant", "left")
        .select(
            *[F.col(c) for c in kernels.columns if c != "devices"],
            F.when(own, F.col("devices"))
            .otherwise(F.coalesce("_manifest", "_board", "_release_board", "devices"))
            .alias("devices"),
        )
    )


def resolve_device_chips(kernels: DataFrame, devices: DataFrame) -> DataFrame:
    """One row per kernel device that the registry knows, with its chip."""
    exploded = kernels.select(
        *RELEASE,
        F.col("file").alias("kernel_file"),
        F.col("ord").alias("kernel_ord"),
        F.posexplode("devices").alias("ord", "device"),
    )
    return exploded.join(devices.select("device", "chip"), "device").select(
        *RELEASE, "kernel_file", "kernel_ord", "ord", "device", "chip"
    )


def chip_label(kernels: DataFrame, device_chips: DataFrame) -> DataFrame:
    """Kernels of an unknown chip get the chip of their devices, or ``Multiple``."""
    range_ = (
        device_chips.groupBy(*RELEASE, F.col("kernel_file").alias("file"))
        .agg(F.min("chip").alias("_low"), F.max("chip").alias("_high"))
    )
    single = F.when(F.col("_low") == F.col("_high"), F.col("_low")).otherwise("Multiple")
    unknown = (F.col("chip") == "Unknown") & F.col("_low").isNotNull()
    return (
        kernels.join(range_, [*RELEASE, "file"], "left")
        .withColumn("chip", F.when(unknown, single).otherwise(F.col("chip")))
        .select(*kernels.columns)
    )


def device_names(device_chips: DataFrame, devices: DataFrame) -> DataFrame:
    """Marketing names; models outside the registry keep their identifier."""
    names = devices.select("device", "marketing_name")
    return device_chips.join(names, "device", "left").select(
        *device_chips.columns, F.coalesce("marketing_name", "device").alias("device_name")
    )


def arch_suffix(arch: Column) -> Column:
    """Last part of an architecture name, null when it has only one part."""
    return F.when(F.contains(F.rtrim(arch, F.lit("_")), F.lit("_")), F.regexp_extract(arch, "([^_]+)_*$", 1))


def chip_from_arch(kernels: DataFrame, archs: DataFrame) -> DataFrame:
    """Add ``family``: the chip family of the architecture suffix, null when unknown."""
    return (
        kernels.withColumn("suffix", arch_suffix(F.col("arch")))
        .join(archs, "suffix", "left")
        .select(*kernels.columns, "family")
    )


def chip_grid(device_chips: DataFrame) -> DataFrame:
    """Distinct devices of every chip in a release with their first position.

    Long form: order by (chip_first, first) to get cards and devices in first-seen order.
    """
    first = F.struct("kernel_ord", "ord")
    devices = device_chips.groupBy(*RELEASE, "chip", "device").agg(F.min(first).alias("first"))
    chips = device_chips.groupBy(*RELEASE, "chip").agg(F.min(first).alias("chip_first"))
    return devices.join(chips, [*RELEASE, "chip"]).select(
        *RELEASE, "chip", "chip_first", "device", "first"
    )


def supported_chips(
    kernels: DataFrame, device_chips: DataFrame, chips: DataFrame, archs: DataFrame
) -> DataFrame:
    """Chip families of each release in first-seen order.

    A kernel counts with the families of its devices, else its own label, else its
    architecture. Families are distinct before they are collected, and there are only as
    many as the fixed family table has.
    """
    families = chips.select(F.col("family").alias("chip"), "family")
    by_device = (
        device_chips.join(families, "chip")
        .groupBy(*RELEASE, "kernel_ord", "family")
        .agg(F.min("ord").alias("ord"))
    )
    resolved = by_device.select(*RELEASE, F.col("kernel_ord").alias("ord")).distinct()
    own = (
        kernels.select(*RELEASE, "ord", "chip", arch_suffix(F.col("arch")).alias("suffix"))
        .join(resolved, [*RELEASE, "ord"], "left_anti")
        .join(families, "chip", "left")
        .join(archs.withColumnRenamed("family", "arch_family"), "suffix", "left")
        .select(
            *RELEASE,
            F.col("ord").alias("kernel_ord"),
            F.lit(0).alias("ord"),
            F.coalesce("family", "arch_family").alias("family"),
        )
        .where("family is not null")
    )
    seen = (
        by_device.select(*RELEASE, "kernel_ord", "ord", "family")
        .unionByName(own)
        .groupBy(*RELEASE, "family")
        .agg(F.min(F.struct("kernel_ord", "ord")).alias("first"))
    )
    return seen.groupBy(*RELEASE).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("first", "family"))), lambda x: x["family"]
        ).alias("chips")
    )


def kernel_summary(kernels: DataFrame, device_chips: DataFrame) -> DataFrame:
    """Kernel rows of release pages: versions of the first kernel, chips by tier.

    Order by (is_dev, -generation, tier, ord) within a release. The chips of a kernel are
    distinct before they are collected.
    """
    key = chip_sort_key("chip")
    by_tier = (
        device_chips.groupBy(*RELEASE, F.col("kernel_file").alias("file"), "chip")
        .agg(F.min("ord").alias("first"))
        .groupBy(*RELEASE, "file")
        .agg(
            F.transform(
                F.array_sort(F.collect_list(F.struct(key["tier"].alias("tier"), "first", "chip"))),
                lambda x: x["chip"],
            ).alias("_chips")
        )
    )
    first = kernels.groupBy(*RELEASE).agg(
        F.min_by(F.struct("darwin_version", "xnu_version"), "ord").alias("v")
    )
    rows = (
        kernels.select(*RELEASE, "ord", "file", "arch", "chip")
        .join(by_tier, [*RELEASE, "file"], "left")
        .join(first, RELEASE)
        .withColumn("chips", F.coalesce("_chips", F.array("chip")))
    )
    leading = chip_sort_key(F.col("chips")[0])
    return rows.select(
        *RELEASE,
        "v.darwin_version",
        "v.xnu_version",
        "ord",
        "file",
        "arch",
        "chips",
        F.col("file").contains("development").alias("is_dev"),
        leading["generation"].alias("generation"),
        leading["tier"].alias("tier"),
    )


def kernel_device_map(identities: DataFrame) -> DataFrame:
    """Kernel file to sorted distinct devices, from manifest identities.

    Identities without a device or kernel path are skipped; the file is the last part of
    the path. Devices are distinct before they are collected.
    """
    pairs = (
        identities.where("device is not null and kernel_path is not null")
        .select(*RELEASE, F.substring_index("kernel_path", "/", -1).alias("file"), "device")
        .distinct()
    )
    return pairs.groupBy(*RELEASE, "file").agg(
        F.array_sort(F.collect_list("device")).alias("devices")
    )


def devices_from_filename(file: Column | str) -> Column:
    """Device models in a kernel file name; a bare number repeats the prefix before it."""
    name = F.col(file) if isinstance(file, str) else file
    suffix = F.when(
        name.contains("kernelcache.release."),
        F.regexp_replace(name, r"(?s)^.*?kernelcache\.release\.", ""),
    ).otherwise(F.regexp_replace(name, r"(?s)^.*?kernelcache\.development\.", ""))
    parts = F.regexp_extract_all(suffix, F.lit("[^_]+"), F.lit(0))
    start = F.struct(F.lit("").alias("prefix"), F.array().cast("array<string>").alias("devices"))

    def step(state: Column, part: Column) -> Column:
        model = part.rlike(r"(?s)^\p{L}.*,")
        bare = ~part.rlike(r"^\p{L}") & (state["prefix"] != "")
        return F.struct(
            F.when(model, F.regexp_extract(part, "(?s)^(.*,)", 1))
            .otherwise(state["prefix"])
            .alias("prefix"),
            F.when(model, F.array_append(state["devices"], part))
            .when(bare, F.array_append(state["devices"], F.concat(state["prefix"], part)))
            .otherwise(state["devices"])
            .alias("devices"),
        )

    listed = F.aggregate(parts, start, step, lambda s: s["devices"])
    return F.when(suffix.startswith("VirtualMac"), F.array(suffix)).otherwise(listed)
