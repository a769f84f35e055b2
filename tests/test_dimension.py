"""Joins with a dimension, by broadcast and by salts."""

import pytest

from shipledger.operators.dimension import join_dimension


@pytest.mark.parametrize("how", ["inner", "left"])
def test_both_ways_give_the_same_rows(spark, how):
    facts = spark.createDataFrame([("hot" if i % 3 else f"k{i % 7}", i) for i in range(300)] + [(None, 1), ("none", 2)], "k string, v int")
    dimension = spark.createDataFrame([("hot", "a"), ("hot", "b"), *[(f"k{i}", f"x{i}") for i in range(5)]], "k string, d string")
    small = join_dimension(facts, dimension, ["k"], how)
    large = join_dimension(facts, dimension, ["k"], how, broadcast_rows=0, salts=5)
    assert small.columns == large.columns
    assert sorted(map(str, small.collect())) == sorted(map(str, large.collect()))
    assert "BroadcastHashJoin" in small._jdf.queryExecution().executedPlan().toString()
