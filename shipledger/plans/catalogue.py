"""A release catalogue derived from the TPC-H-like tables.

The tables hold no releases, so the queries run on one derived from them: line items are
component rows and ship months are releases; orders are releases with their line items as
components where many small documents are wanted; customers are devices.
Nothing is filtered out, so the work grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipledger.functions.labels import release_name_by_major


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables, in its own splits."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _month_build(date: str, flag: str) -> Column:
    month = F.month(date)
    return F.concat(
        (F.year(date) - 1984).cast("string"),
        F.char(64 + month),
        F.when(F.col(flag) == "A", 5000 + month)
        .when(F.col(flag) == "R", 300 + month)
        .otherwise(80 + month)
        .cast("string"),
        F.when(F.col(flag) == "A", "a").otherwise(""),
    )


def _month_version(date: str) -> Column:
    return F.concat_ws(".", (F.year(date) - 1984).cast("string"), F.month(date).cast("string"))


def _line_version() -> Column:
    tax = F.round(F.col("l_tax") * 100).cast("int")
    suffix = (
        F.when(tax == 1, "p1")
        .when(tax == 2, ".0")
        .when(tax == 3, " (build 9)")
        .when(tax == 4, "a")
        .when(tax == 5, ".0.1")
        .when(tax == 6, "B2")
        .otherwise("")
    )
    return (
        F.when(tax == 8, F.lit(None).cast("string"))
        .when(tax == 7, "unknown")
        .otherwise(
            F.concat(
                F.concat_ws(
                    ".",
                    F.col("l_linenumber").cast("string"),
                    F.col("l_quantity").cast("int").cast("string"),
                ),
                suffix,
            )
        )
    )


def line_components() -> list[Column]:
    """Component columns of a line item row."""
    ord_ = (
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")
    ) * 10 + F.round(F.col("l_tax") * 100).cast("int")
    return [
        ord_.cast("bigint").alias("ord"),
        F.concat(
            F.lit("Part-"),
            F.col("l_partkey").cast("string"),
            F.when(F.col("l_partkey") % 5 == 0, " (Compat)").otherwise(""),
        ).alias("name"),
        _line_version().alias("version"),
        F.concat(F.lit("/usr/lib/"), F.col("l_partkey").cast("string"), F.lit(".dylib")).alias(
            "path"
        ),
        F.when(F.col("l_partkey") % 2 == 0, "filesystem").otherwise("dyldCache").alias("source"),
    ]


def month_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the monthly catalogue: one row per line item, no shuffle."""
    return table(spark, sf_dir, "lineitem").select(
        F.lit("macOS").alias("product"),
        _month_build("l_shipdate", "l_returnflag").alias("build_number"),
        *line_components(),
    )


def month_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of the monthly catalogue: one beta, candidate and final build per month."""
    groups = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            _month_build("l_shipdate", "l_returnflag").alias("build_number"),
            _month_version("l_shipdate").alias("os_version"),
            F.col("l_returnflag").alias("flag"),
        )
        .agg(F.count("*").alias("n"), F.to_date(F.max("l_shipdate")).alias("release_date"))
    )
    beta, rc = F.col("flag") == "A", F.col("flag") == "R"
    numbered = beta & (F.col("n") % 5 != 0)
    major = F.split("os_version", r"\.")[0].cast("int")
    month = F.split("os_version", r"\.")[1].cast("int")
    maturity = F.when(beta, 2).when(rc, 1).otherwise(0)
    return groups.select(
        F.lit("macOS").alias("product"),
        "os_version",
        "build_number",
        release_name_by_major(major).alias("release_name"),
        "release_date",
        beta.alias("is_beta"),
        F.when(numbered, 1 + F.col("n") % 4).cast("int").alias("beta_number"),
        F.when(numbered & (F.col("n") % 3 == 0), 2).alias("beta_revision"),
        rc.alias("is_rc"),
        F.when(rc & (F.col("n") % 2 == 0), 1 + F.col("n") % 3).cast("int").alias("rc_number"),
        ((F.col("flag") == "N") & (F.col("n") % 4 == 0)).alias("is_device_specific"),
        # Index order is newest version first, so the position follows from the version.
        (((200 - major) * 12 + 12 - month) * 3 + maturity).cast("bigint").alias("pos"),
    )


def month_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Release texts made from orders: version, version-build, version and build, broken ones."""
    kind = F.col("o_custkey") % 5
    flag = F.when(kind == 1, "A").when(kind == 2, "R").otherwise("N").alias("flag")
    version = _month_version("o_orderdate")
    rows = table(spark, sf_dir, "orders").select("o_orderdate", kind.alias("kind"), flag)
    build = _month_build("o_orderdate", "flag")
    texts = rows.select(
        F.lit("macOS").alias("product"),
        F.when(F.col("kind") == 0, version)
        .when(F.col("kind") == 4, F.concat(version, F.lit("-")))
        .when(F.col("kind") == 3, version)
        .otherwise(F.concat_ws("-", version, build))
        .alias("spec"),
        F.when(F.col("kind") == 3, build).alias("build"),
    )
    return texts.groupBy("product", "spec", "build").agg(F.count("*").alias("n"))


def lookup_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lookup texts made from suppliers: full names, bare names, parts of names, unknown ones."""
    kind, key = F.col("s_suppkey") % 4, F.col("s_suppkey")
    text = (
        F.when(kind == 0, F.concat(F.lit("PART-"), (key * 3).cast("string")))
        .when(kind == 1, F.concat(F.lit("part-"), (key * 5).cast("string")))
        .when(kind == 2, F.concat(F.lit("T-"), key.cast("string")))
        .otherwise(F.concat(F.lit("none-"), key.cast("string")))
    )
    months = F.col("s_nationkey") % 12
    return table(spark, sf_dir, "supplier").select(
        F.lit("macOS").alias("product"),
        F.concat(F.lit("13"), F.char(65 + months), (81 + months).cast("string")).alias("build_number"),
        text.alias("request"),
    )


def order_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Releases of the order catalogue: every order is a release."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    major, minor = 11 + customer % 17, customer % 7
    beta, rc = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderpriority") == "2-HIGH"
    xcode = F.col("o_orderstatus") == "P"
    version = F.concat_ws(
        ".",
        major.cast("string"),
        minor.cast("string"),
        F.when(customer % 3 == 0, (key % 10).cast("string")),
    )
    build = F.concat(
        major.cast("string"), F.char(65 + minor), key.cast("string"), F.when(beta, "a").otherwise("")
    )
    return table(spark, sf_dir, "orders").select(
        F.when(xcode, "Xcode").otherwise("macOS").alias("product"),
        version.alias("os_version"),
        build.alias("build_number"),
        release_name_by_major(major).alias("release_name"),
        F.to_date("o_orderdate").alias("release_date"),
        beta.alias("is_beta"),
        F.when(beta & (key % 4 != 0), 1 + key % 9).cast("int").alias("beta_number"),
        F.when(beta & (key % 8 == 1), 2).alias("beta_revision"),
        rc.alias("is_rc"),
        F.when(rc & (key % 3 != 0), 1 + key % 3).cast("int").alias("rc_number"),
        (~xcode & (F.col("o_orderpriority") == "3-MEDIUM")).alias("is_device_specific"),
        F.when(xcode, F.concat(major.cast("string"), F.lit(".0"))).alias("minimum_os_version"),
        key.alias("pos"),
        key.alias("order_key"),
    )


def order_sdks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SDKs of the order catalogue: the line items of Xcode orders."""
    orders = order_releases(spark, sf_dir).where("product = 'Xcode'").select("product", "build_number", "order_key")
    part = F.col("l_partkey")
    version = F.concat_ws(".", (11 + part % 17).cast("string"), (F.col("l_linenumber") % 4).cast("string"))
    build = F.when(
        part % 6 != 0,
        F.concat((20 + part % 9).cast("string"), F.char(65 + part % 5), (part % 40).cast("string")),
    )
    lines = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_key"),
        ((part * 10 + F.col("l_linenumber")) * 100 + F.col("l_quantity").cast("int")).alias("ord"),
        version.alias("sdk_version"),
        build.alias("build_version"),
    )
    return orders.join(lines, "order_key").select(
        "product", "build_number", "ord", "sdk_version", "build_version"
    )


# Architectures of the derived kernels by nation, known and unknown ones.
ARCH_CYCLE = [
    "ARM64_T8020", "ARM64_T8101", "ARM64_T8103", "ARM64_T6000", "ARM64_T6001", "ARM64_T6002", "ARM64_T8110",
    "ARM64_T8112", "ARM64_T6020", "ARM64_T6021", "ARM64_T6022", "ARM64_T8122", "ARM64_T6030", "ARM64_T6031",
    "ARM64_T6034", "ARM64_T8132", "ARM64_T6040", "ARM64_T8140", "ARM64_T8142", "ARM64_T6050", "ARM64_T6051",
    "ARM64_VMAPPLE", "ARM64_T9999", "ARM64", "ARM64_T6032",
]
