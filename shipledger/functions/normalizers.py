"""From a matched text to a version, by the normalizer named in a rule."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _blank(c: Column) -> Column:
    return F.btrim(c, F.lit(" \t"))


def strip_prefix(raw: Column, prefixes: list[str]) -> Column:
    """Remove the first prefix that fits, then surrounding blanks."""
    options = "|".join(re.escape(p) for p in prefixes)
    return _blank(F.regexp_replace(raw, f"^(?:{options})", ""))


def strip_vendor_suffix(raw: Column) -> Column:
    """Cut from `` (Apple Git-N)`` on."""
    return F.regexp_replace(raw, r"(?s)^(.*?) \(Apple Git-[0-9]+[0-9.]*\).*$", "$1")


def truncate_version(raw: Column, prefixes: list[str]) -> Column:
    """Keep three numbers of a longer version, two when the third is zero."""
    options = "|".join(re.escape(p) for p in prefixes)
    version = F.regexp_replace(raw, f"^(?:{options})", "")
    parts = F.regexp_extract_all(version, F.lit("[^.]+"), F.lit(0))
    kept = F.when(F.coalesce(F.get(parts, F.lit(2)).try_cast("bigint"), F.lit(0)) > 0, 3).otherwise(2)
    return F.when(F.size(parts) > 3, F.array_join(F.slice(parts, 1, kept), ".")).otherwise(version)


def quoted_define(raw: Column) -> Column:
    """The text between the first two double quotes."""
    return F.when(raw.rlike('"[^"]*"'), F.regexp_extract(raw, '"([^"]*)"', 1)).otherwise(raw)


def decode_integer(value: Column) -> Column:
    """20913 is 2.9.13; null stays null."""
    number = value.cast("bigint")
    dot = F.lit(".")
    return F.concat(
        F.floor(number / 10000).cast("string"),
        dot,
        F.floor(number % 10000 / 100).cast("string"),
        dot,
        (number % 100).cast("string"),
    )


def integer_define(raw: Column) -> Column:
    """Decode the integer at the end of a define."""
    digits = F.regexp_extract(raw, r"(\d+)\s*$", 1).try_cast("bigint")
    return F.when(digits.isNotNull(), decode_integer(digits)).otherwise(raw)


def current_version(raw: Column) -> Column:
    """The number of a ``current-version:`` entry."""
    found = F.regexp_extract(raw, "[0-9]+[0-9.]*", 0)
    return F.when(found != "", found).otherwise(raw)


def normalize(raw: Column, normalizer: str, arguments: list[str]) -> Column:
    """Apply a normalizer by name."""
    if normalizer == "identity":
        return raw
    if normalizer == "strip_prefix":
        return strip_prefix(raw, arguments)
    if normalizer == "truncate_version":
        return truncate_version(raw, arguments)
    plain = {
        "strip_vendor_suffix": strip_vendor_suffix,
        "quoted_define": quoted_define,
        "integer_define": integer_define,
        "current_version": current_version,
    }
    if normalizer not in plain:
        raise ValueError(f"unknown normalizer: {normalizer}")
    return plain[normalizer](raw)
