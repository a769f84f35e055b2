"""The next row of a sequence, also where one key holds most rows."""

import random

from pyspark.sql import functions as F

from shipledger.operators import succession
from shipledger.operators.succession import with_next


def brute(rows):
    following = {}
    for key in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == key), key=lambda r: (-r[1], r[2]))
        for row, after in zip(ordered, [*ordered[1:], None]):
            following[row] = after[2] if after else None
    return following


def check(spark, rows, slices):
    df = spark.createDataFrame(rows, "k string, d int, id int")
    out = with_next(df, ["k"], [F.col("d").desc(), F.col("id").asc()], ["id"], slices=slices)
    got = {(r.k, r.d, r.id): r.next.id if r.next else None for r in out.collect()}
    assert got == brute(rows)


def test_hot_key_spans_slices(spark):
    rng = random.Random(1)
    rows = [("hot", rng.randint(0, 5), i) for i in range(900)]
    rows += [(f"k{i % 40}", rng.randint(0, 5), i) for i in range(900, 1300)]
    check(spark, rows, slices=16)


def test_more_slices_than_rows(spark):
    check(spark, [("a", 1, 1), ("a", 2, 2), ("b", 1, 3)], slices=12)


def test_single_rows(spark):
    check(spark, [(f"k{i}", 0, i) for i in range(50)], slices=5)


def test_groups_of_any_size(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(f"k{i % 40}", rng.randint(0, 5), i) for i in range(400)] + [(None, i % 3, 1000 + i) for i in range(30)]
    hot = [("hot", rng.randint(0, 5), i) for i in range(2000, 2300)]
    sliced = []
    whole = succession.with_next
    monkeypatch.setattr(succession, "with_next", lambda df, *rest: (sliced.append(df), whole(df, *rest))[1])
    for of, calls in ((rows, 0), (rows + hot, 1)):
        df = spark.createDataFrame(of, "k string, d int, id int")
        out = succession.with_next_in_groups(df, ["k"], [F.col("d").desc(), F.col("id").asc()], ["id"], group_rows=100)
        assert {(r.k, r.d, r.id): r.next.id if r.next else None for r in out.collect()} == brute(of)
        # Only large groups are sliced.
        assert len(sliced) == calls
    assert {r.k for r in sliced[0].collect()} == {"hot"}
