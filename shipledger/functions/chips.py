"""Order of chips."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shipledger.fixed import CHIP_TIERS
from shipledger.functions.versions import _col


def tier_rank(tier: Column | str) -> Column:
    """Position of a tier: base, pro, max, ultra."""
    return F.array_position(F.array(*[F.lit(t) for t in CHIP_TIERS]), _col(tier)) - 1


def chip_sort_key(chip: Column | str) -> Column:
    """(generation, tier) of a chip label; virtual machines and unknown chips have generation 0."""
    label = _col(chip)
    pattern = r"^M(\d+)\s*(Pro|Max|Ultra)?$"
    generation = F.regexp_extract(label, pattern, 1)
    tier = F.regexp_extract(label, pattern, 2)
    named = (
        F.when(tier == "Ultra", 3).when(tier == "Max", 2).when(tier == "Pro", 1).otherwise(0)
    )
    known = label.rlike(pattern)
    return F.struct(
        F.when(label == "A18 Pro", 5)
        .when(known, generation.try_cast("int"))
        .otherwise(0)
        .alias("generation"),
        F.when(label == "A18 Pro", 4)
        .when(known, named)
        .when(label.contains("Virtual"), 0)
        .otherwise(1)
        .alias("tier"),
    )
