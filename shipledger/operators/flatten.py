"""From nested release documents to flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RELEASE = ["product", "build_number"]


def explode_components(documents: DataFrame) -> DataFrame:
    """One row per component, with its position."""
    return documents.select(
        *RELEASE, F.posexplode("components").alias("ord", "c")
    ).select(*RELEASE, "ord", "c.name", "c.version", "c.path", "c.source")


def explode_kernels(documents: DataFrame) -> DataFrame:
    """One row per kernel, with its position."""
    return documents.select(*RELEASE, F.posexplode("kernels").alias("ord", "k")).select(
        *RELEASE,
        "ord",
        "k.file",
        F.col("k.darwinVersion").alias("darwin_version"),
        F.col("k.xnuVersion").alias("xnu_version"),
        "k.arch",
        "k.chip",
        F.coalesce("k.devices", F.array().cast("array<string>")).alias("devices"),
    )


def explode_device_chips(documents: DataFrame) -> DataFrame:
    """One row per device of a kernel, with both positions."""
    return (
        documents.select(*RELEASE, F.posexplode("kernels").alias("kernel_ord", "k"))
        .select(
            *RELEASE,
            F.col("k.file").alias("kernel_file"),
            "kernel_ord",
            F.posexplode("k.deviceChips").alias("ord", "d"),
        )
        .select(*RELEASE, "kernel_file", "kernel_ord", "ord", "d.device", "d.chip")
    )


def explode_sdks(documents: DataFrame) -> DataFrame:
    """One row per SDK, with its position."""
    return documents.select(*RELEASE, F.posexplode("sdks").alias("ord", "s")).select(
        *RELEASE,
        "ord",
        F.col("s.sdkVersion").alias("sdk_version"),
        F.col("s.buildVersion").alias("build_version"),
    )


def nest_release(
    releases: DataFrame,
    components: DataFrame,
    kernels: DataFrame | None = None,
    device_chips: DataFrame | None = None,
    sdks: DataFrame | None = None,
) -> DataFrame:
    """Release documents from flat tables, the reverse of the functions above.

    A document is one value, so its parts meet in one row; they are as many as one release
    has. Missing tables give empty arrays (SDKs: null), as in documents without them.
    """

    def listed(rows: DataFrame, order: str, fields: list, into: str) -> DataFrame:
        packed = F.collect_list(F.struct(F.col(order).alias("_ord"), F.struct(*fields).alias("v")))
        return rows.groupBy(*RELEASE).agg(
            F.transform(F.array_sort(packed), lambda x: x["v"]).alias(into)
        )

    xcode = F.col("product") == "Xcode"
    document = releases.select(
        "product",
        "build_number",
        F.col("product").alias("productType"),
        F.col("os_version").alias("osVersion"),
        F.col("build_number").alias("buildNumber"),
        F.col("release_name").alias("releaseName"),
        F.date_format("release_date", "yyyy-MM-dd").alias("releaseDate"),
        F.when(~xcode, F.col("file")).alias("ipswFile"),
        F.when(~xcode, F.col("url")).alias("ipswURL"),
        F.when(xcode, F.col("file")).alias("xipFile"),
        F.when(xcode, F.col("url")).alias("xipURL"),
        F.col("is_beta").alias("isBeta"),
        F.col("beta_number").alias("betaNumber"),
        F.col("beta_revision").alias("betaRevision"),
        F.col("is_rc").alias("isRC"),
        F.col("rc_number").alias("rcNumber"),
        F.when(~xcode, F.col("is_device_specific")).alias("isDeviceSpecific"),
        F.col("minimum_os_version").alias("minimumOSVersion"),
    ).join(
        listed(components, "ord", ["name", "version", "path", "source"], "components"),
        RELEASE,
        "left",
    )
    if kernels is not None:
        rows = kernels
        if device_chips is not None:
            chips = device_chips.groupBy(*RELEASE, F.col("kernel_ord").alias("ord")).agg(
                F.transform(
                    F.array_sort(F.collect_list(F.struct("ord", "device", "chip"))),
                    lambda x: F.struct(x["device"].alias("device"), x["chip"].alias("chip")),
                ).alias("deviceChips")
            )
            rows = kernels.join(chips, [*RELEASE, "ord"], "left")
        fields = [
            "file",
            F.col("darwin_version").alias("darwinVersion"),
            F.col("xnu_version").alias("xnuVersion"),
            "arch",
            "chip",
            "devices",
            *(["deviceChips"] if device_chips is not None else []),
        ]
        document = document.join(listed(rows, "ord", fields, "kernels"), RELEASE, "left")
    if sdks is not None:
        fields = [F.col("sdk_version").alias("sdkVersion"), F.col("build_version").alias("buildVersion")]
        document = document.join(listed(sdks, "ord", fields, "sdks"), RELEASE, "left")
    none = F.array().cast("array<struct<name:string,version:string,path:string,source:string>>")
    return document.withColumn("components", F.coalesce("components", none))
