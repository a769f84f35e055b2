"""Rows for what an expensive expression found.

The optimizer moves a condition on a computed column below the projection that computes it,
and adds such a condition for every exploded array, so that the expression is evaluated
twice, and without the look-ups it shares with others. A condition on the output of an outer
explode stays where it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_found(df: DataFrame, array: str, keep: list[str], into: str, at: str | None = None) -> DataFrame:
    """One row per element of ``array``, which has no null elements, with the columns ``keep``."""
    if at is None:
        rows = df.select(*keep, F.explode_outer(array).alias(into))
    else:
        rows = df.select(*keep, F.posexplode_outer(array).alias(at, into))
    return rows.where(F.col(into).isNotNull())


def keep_found(df: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` is not null."""
    rest = [c for c in df.columns if c != column]
    rows = df.select(*rest, F.explode_outer(F.array(column)).alias(column))
    return rows.where(F.col(column).isNotNull()).select(*df.columns)


def explode_struct(df: DataFrame, keep: list[str], **columns: Column) -> DataFrame:
    """The columns ``keep`` and new ones, which later steps read instead of repeating their expressions."""
    named = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select(*keep, F.explode_outer(named).alias("_found")).select(*keep, *[f"_found.{name}" for name in columns])


def order_by_key(df: DataFrame, key: Column, *rest: str, descending: bool = False) -> DataFrame:
    """Sort by an expensive key, then by the columns ``rest``, all in one direction.

    The key becomes a column first: a sort on an expression evaluates it again in every
    comparison.
    """
    names = ["_key", *rest]
    order = [F.col(n).desc_nulls_last() if descending else F.col(n).asc() for n in names]
    return df.withColumn("_key", key).orderBy(*order).drop("_key")
