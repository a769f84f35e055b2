"""Joins of facts with a dimension whose keys repeat without bound in the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipledger.session import settle

#: Dimension rows up to which it is broadcast; a row is a few short columns, so 100 MB or so.
BROADCAST_ROWS = 500_000


def join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    keys: list[str],
    how: str = "inner",
    broadcast_rows: int = BROADCAST_ROWS,
    salts: int | None = None,
) -> DataFrame:
    """``facts`` joined with ``dimension`` on ``keys``, without bringing a key's facts to one task.

    The dimension is computed once and counted. Up to ``broadcast_rows`` rows it is broadcast and the
    facts are not shuffled. Beyond, facts of a key are spread by a hash of the whole row over ``salts``
    parts (the shuffle partitions if not given), and every dimension row is repeated for each.
    """
    dimension = settle(dimension)
    if dimension.count() <= broadcast_rows:
        return facts.join(F.broadcast(dimension), keys, how)
    parts = salts or int(facts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.pmod(F.xxhash64(*facts.columns), F.lit(parts)).cast("int")
    repeated = dimension.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return facts.withColumn("_part", part).join(repeated, [*keys, "_part"], how).drop("_part")
