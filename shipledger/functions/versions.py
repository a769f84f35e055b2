"""Ordering keys for component versions, OS versions and build numbers.

Every key is a plain Catalyst value (string or struct), so ``orderBy``, ``min``/``max``,
``min_by``/``max_by`` and joins work on it without Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PARENTHETICAL = r"\s*\([^)]*\)"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_parenthetical(c: Column | str) -> Column:
    """Remove every parenthesised group and surrounding blanks."""
    return F.btrim(F.regexp_replace(_col(c), PARENTHETICAL, ""), F.lit(" \t"))


def _raw_tokens(c: Column | str) -> Column:
    from_first_digit = F.regexp_replace(
        F.regexp_replace(_col(c), PARENTHETICAL, ""), "^[^0-9]+", ""
    )
    return F.regexp_extract_all(from_first_digit, F.lit("[0-9]+|[A-Za-z]+"), F.lit(0))


def version_tokens(c: Column | str) -> Column:
    """Digit runs and lower-cased letter runs; letters before the first number are dropped."""
    return F.transform(_raw_tokens(c), F.lower)


def version_key(c: Column | str) -> Column:
    """A string whose byte order is the component-version order; null without any number.

    The order of tokens is: missing = 0 < letters < positive number. A token becomes ``!``
    (zero, or a number beyond 64 bits), ``1<letters><blank>`` or ``2<19 digits>``, and
    trailing zeros are dropped because they equal a missing token. The result is flat, so
    it can also be stored, grouped and range-partitioned.
    """

    def encode(token: Column) -> Column:
        number = F.coalesce(token.try_cast("bigint"), F.lit(0))
        return (
            F.when(token >= F.lit("A"), F.concat(F.lit("1"), F.lower(token), F.lit(" ")))
            .when(number == 0, F.lit("!"))
            .otherwise(F.concat(F.lit("2"), F.lpad(number.cast("string"), 19, "0")))
        )

    tokens = _raw_tokens(c)
    key = F.rtrim(F.array_join(F.transform(tokens, encode), ""), F.lit("!"))
    return F.when(F.size(tokens) > 0, key)


def direction_of_keys(from_key: Column, to_key: Column) -> Column:
    """Direction between two version keys; a null key (no number) never changes."""
    return (
        F.when(from_key < to_key, "upgraded")
        .when(from_key > to_key, "downgraded")
        .otherwise("unchanged")
    )


def compare_versions(a: Column | str, b: Column | str) -> Column:
    """``upgraded``, ``downgraded`` or ``unchanged`` going from ``a`` to ``b``.

    Equal texts are the common case and skip the key computation.
    """
    a, b = _col(a), _col(b)
    return F.when(a.eqNullSafe(b), "unchanged").otherwise(
        direction_of_keys(version_key(a), version_key(b))
    )


def with_direction(df: DataFrame, a: str, b: str, into: str) -> DataFrame:
    """Column form of :func:`compare_versions` for big tables.

    The keys are columns of their own projection, so each is computed once per row, and
    only for rows whose texts differ.
    """
    differs = F.col(a) != F.col(b)
    return (
        df.withColumn("_a_key", F.when(differs, version_key(a)))
        .withColumn("_b_key", F.when(differs, version_key(b)))
        .withColumn(into, direction_of_keys(F.col("_a_key"), F.col("_b_key")))
        .drop("_a_key", "_b_key")
    )


def _version_part(c: Column | str, position: int) -> Column:
    parts = F.regexp_extract_all(_col(c), F.lit("[^.]+"), F.lit(0))
    part = F.get(parts, F.lit(position))
    return F.coalesce(F.when(part.rlike("^[+-]?[0-9]+$"), part.try_cast("int")), F.lit(0))


def major(c: Column | str) -> Column:
    """First number of an OS version, 0 when it is not one."""
    return _version_part(c, 0)


def minor(c: Column | str) -> Column:
    """Second number of an OS version, 0 when missing or not a number."""
    return _version_part(c, 1)


def patch(c: Column | str) -> Column:
    """Third number of an OS version, 0 when missing or not a number."""
    return _version_part(c, 2)


def os_version_key(c: Column | str) -> Column:
    """(major, minor, patch) of an OS version."""
    return F.struct(major(c).alias("major"), minor(c).alias("minor"), patch(c).alias("patch"))


def build_key(c: Column | str) -> Column:
    """(cycle, train, build, suffix) of a build number, so 24B83 sorts before 24B2083."""
    pattern = r"^(\d*)([A-Za-z]*)(\d*)([\s\S]*)$"

    def number(group: int) -> Column:
        return F.coalesce(F.regexp_extract(_col(c), pattern, group).try_cast("bigint"), F.lit(0))

    return F.struct(
        number(1).alias("cycle"),
        F.regexp_extract(_col(c), pattern, 2).alias("train"),
        number(3).alias("build"),
        F.regexp_extract(_col(c), pattern, 4).alias("suffix"),
    )


def prerelease_rank(is_beta: Column | str = "is_beta", is_rc: Column | str = "is_rc") -> Column:
    """Beta 0, release candidate 1, final release 2."""
    return F.when(_col(is_beta), 0).when(_col(is_rc), 1).otherwise(2)


def release_key() -> Column:
    """Version order of releases: OS version, maturity, build."""
    return F.struct(
        os_version_key("os_version").alias("version"),
        prerelease_rank().alias("maturity"),
        build_key("build_number").alias("build"),
    )


def recency_key() -> Column:
    """Recency of releases as one ascending key: date, then version, then build."""
    return F.struct(
        F.col("release_date").alias("date"),
        version_key("os_version").alias("version"),
        build_key("build_number").alias("build"),
    )


def recency_order() -> list[Column]:
    """Newest first: date, then version, then build; releases without a date come last."""
    return [
        F.col("release_date").desc_nulls_last(),
        version_key("os_version").desc_nulls_last(),
        build_key("build_number").desc(),
    ]


def beta_build_flag(c: Column | str) -> Column:
    """Build numbers of betas end with a lower-case letter."""
    return F.coalesce(_col(c).rlike(r"\p{Ll}$"), F.lit(False))
