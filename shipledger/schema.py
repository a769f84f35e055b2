"""Schemas of release documents and of the index, and the flat release columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TEXT, FLAG, NUMBER = T.StringType(), T.BooleanType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


COMPONENT = _struct(name=TEXT, version=TEXT, path=TEXT, source=TEXT)
KERNEL = _struct(
    file=TEXT,
    darwinVersion=TEXT,
    xnuVersion=TEXT,
    arch=TEXT,
    chip=TEXT,
    devices=T.ArrayType(TEXT),
    deviceChips=T.ArrayType(_struct(device=TEXT, chip=TEXT)),
)
SDK = _struct(sdkVersion=TEXT, buildVersion=TEXT)
IDENTITY = {
    "productType": TEXT,
    "osVersion": TEXT,
    "buildNumber": TEXT,
    "releaseName": TEXT,
    "releaseDate": TEXT,
    "isBeta": FLAG,
    "betaNumber": NUMBER,
    "betaRevision": NUMBER,
    "isRC": FLAG,
    "rcNumber": NUMBER,
    "isDeviceSpecific": FLAG,
}
RELEASE_DOCUMENT = _struct(
    **IDENTITY,
    ipswFile=TEXT,
    ipswURL=TEXT,
    xipFile=TEXT,
    xipURL=TEXT,
    minimumOSVersion=TEXT,
    kernels=T.ArrayType(KERNEL),
    components=T.ArrayType(COMPONENT),
    sdks=T.ArrayType(SDK),
)
INDEX_ENTRY = _struct(**IDENTITY, dataFile=TEXT)

FLAGS = ["isBeta", "isRC", "isDeviceSpecific"]
PRODUCTS = {"macOS": "macos", "Xcode": "xcode"}


def _product() -> Column:
    return F.coalesce("productType", F.lit("macOS"))


def release_columns() -> list[Column]:
    """Flat identity columns of a document or index entry, with the defaults filled in."""
    return [
        _product().alias("product"),
        F.col("osVersion").alias("os_version"),
        F.col("buildNumber").alias("build_number"),
        F.col("releaseName").alias("release_name"),
        F.try_to_date("releaseDate", "yyyy-MM-dd").alias("release_date"),
        F.coalesce("isBeta", F.lit(False)).alias("is_beta"),
        F.col("betaNumber").alias("beta_number"),
        F.col("betaRevision").alias("beta_revision"),
        F.coalesce("isRC", F.lit(False)).alias("is_rc"),
        F.col("rcNumber").alias("rc_number"),
        F.coalesce("isDeviceSpecific", F.lit(False)).alias("is_device_specific"),
    ]


def with_defaults(documents: DataFrame) -> DataFrame:
    """Fill missing flags and arrays, and add product and build_number."""
    filled = {name: F.coalesce(name, F.lit(False)) for name in FLAGS if name in documents.columns}
    for name in ("kernels", "components"):
        if name in documents.columns:
            kind = RELEASE_DOCUMENT[name].dataType
            filled[name] = F.coalesce(F.col(name), F.array().cast(kind))
    return documents.withColumns(
        filled | {"product": _product(), "build_number": F.col("buildNumber")}
    )


def index_row() -> list[Column]:
    """Index entry columns of a flat release, in document naming."""
    xcode = F.col("product") == "Xcode"
    return [
        F.col("product").alias("productType"),
        F.col("os_version").alias("osVersion"),
        F.col("build_number").alias("buildNumber"),
        F.col("release_name").alias("releaseName"),
        F.date_format("release_date", "yyyy-MM-dd").alias("releaseDate"),
        F.col("is_beta").alias("isBeta"),
        F.col("beta_number").alias("betaNumber"),
        F.col("beta_revision").alias("betaRevision"),
        F.col("is_rc").alias("isRC"),
        F.col("rc_number").alias("rcNumber"),
        F.when(~xcode, F.col("is_device_specific")).alias("isDeviceSpecific"),
        F.col("data_file").alias("dataFile"),
    ]


def data_file() -> Column:
    """Path of a release document below the product folder."""
    return F.concat(
        F.lit("releases/"),
        F.regexp_extract("os_version", "[^.]+", 0),
        F.lit("/"),
        F.col("product"),
        F.lit("-"),
        F.col("os_version"),
        F.lit("-"),
        F.col("build_number"),
        F.lit(".json"),
    )
