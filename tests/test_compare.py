"""Differences between releases."""

import random

import pytest

from shipledger.operators import compare as C
from tests.test_versions import plain_direction

SCHEMA = "product string, build_number string, ord int, name string, version string"


def brute(rows, a, b):
    def side(build):
        first = {}
        for _, build_number, _, name, version in sorted(rows, key=lambda r: r[2]):
            if build_number == build:
                first.setdefault(name, version or "")
        return first

    old, new = side(a), side(b)
    out = {}
    for name in old.keys() | new.keys():
        status = "added" if name not in old else "removed" if name not in new else plain_direction(old[name], new[name])
        out[name] = (old.get(name), new.get(name), status)
    return out


def random_rows():
    rng = random.Random(3)
    versions = ["1.0", "1.0.0", "1.1", "2.0a", None, "x", "10"]
    return [
        ("macOS", f"b{b}", i, f"n{rng.randint(0, 30)}", rng.choice(versions)) for b in range(5) for i in range(25)
    ]


def test_pair_and_many_agree_with_brute_force(spark):
    rows = random_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    one = {r.name: (r.from_version, r.to_version, r.status) for r in C.compare_releases(df, "macOS", "b1", "b3").collect()}
    assert one == brute(rows, "b1", "b3")
    pairs = spark.createDataFrame([("macOS", "b0", "b4"), ("macOS", "b2", "b2"), ("macOS", "b1", "b3")], "product string, from_build string, to_build string")
    got = {}
    for r in C.compare_many(df, pairs).collect():
        got.setdefault((r.from_build, r.to_build), {})[r.name] = (r.from_version, r.to_version, r.status)
    for pair in (("b0", "b4"), ("b2", "b2"), ("b1", "b3")):
        assert got[pair] == brute(rows, *pair)


def test_first_entry_of_a_name_counts(spark):
    rows = [("macOS", "a", 0, "x", "1"), ("macOS", "a", 1, "x", "9"), ("macOS", "b", 0, "x", "2")]
    row = C.compare_releases(spark.createDataFrame(rows, SCHEMA), "macOS", "a", "b").first()
    assert (row.from_version, row.to_version, row.status) == ("1", "2", "upgraded")


def test_previous_by_date_then_index_order(spark):
    rows = [("macOS", "a", "2024-01-01", 3), ("macOS", "b", "2024-02-01", 2), ("macOS", "c", "2024-02-01", 1), ("macOS", "d", None, 0), ("Xcode", "e", "2024-01-15", 0)]
    df = spark.createDataFrame(rows, "product string, build_number string, release_date string, pos int")
    got = {r.build_number: r.previous_build for r in C.previous_release(df).collect()}
    assert got == {"c": "b", "b": "a", "a": "d", "d": None, "e": None}


def test_summary_text(spark):
    rows = [("macOS", "a", 0, "x", "1"), ("macOS", "b", 0, "x", "2"), ("macOS", "b", 1, "y", "2")]
    diff = C.compare_releases(spark.createDataFrame(rows, SCHEMA), "macOS", "a", "b")
    assert C.compare_summary(diff).first().summary == "1 upgraded, 0 downgraded, 1 added, 0 removed"


def test_overlay(spark):
    schema = SCHEMA
    base = spark.createDataFrame([("macOS", "a", 0, "x", "1"), ("macOS", "a", 1, "y", "1")], schema)
    over = spark.createDataFrame([("macOS", "a", 0, "x", "2")], schema)
    assert sorted((r.name, r.version) for r in C.overlay_components(base, over).collect()) == [("x", "2"), ("y", "1")]
    assert C.overlay_components(base, over.limit(0)).count() == 2


@pytest.mark.parametrize("limit", [0, C.BROADCAST_ROWS])
def test_pairs_travel_as_numbers_while_they_are_few(spark, monkeypatch, limit):
    rows = [("macOS", b, i, f"n{i % 3}", f"{i}.{b}") for b in ("1A1", "1A2", "1A3") for i in range(4)]
    components = spark.createDataFrame(rows, "product string, build_number string, ord long, name string, version string")
    pairs = spark.createDataFrame([("macOS", "1A1", "1A2"), ("macOS", "1A2", "1A3")] * 2, "product string, from_build string, to_build string")
    monkeypatch.setattr(C, "BROADCAST_ROWS", limit)
    diff = C.compare_many(components, pairs)
    assert diff.columns == [*C.PAIR, "name", "from_version", "to_version", "status"]
    found = sorted((r.from_build, r.to_build, r.name, r.from_version, r.to_version) for r in diff.collect())
    assert found == [(a, b, f"n{i}", f"{i}.{a}", f"{i}.{b}") for a, b in (("1A1", "1A2"), ("1A2", "1A3")) for i in range(3)]
    groups = [line for line in diff._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate [" in line]
    assert any("from_build" in line for line in groups) == (limit == 0)
