"""Orders of versions and builds, against a plain reading of the rules."""

import functools
import random
import re

import pytest
from pyspark.sql import functions as F

from shipledger.functions import versions as V

# Ordered pairs that every implementation has to agree on.
VERSIONS = [
    ("8.7.1", "8.7.4", "upgraded"),
    ("9.8p1", "9.8p2", "upgraded"),
    ("9.8", "9.8p1", "upgraded"),
    ("1.0", "1.0a", "upgraded"),
    ("1.0A", "1.0a", "unchanged"),
    ("1.0.0", "1.0", "unchanged"),
    ("v1.2", "1.2", "unchanged"),
    ("3.2.57(1)", "3.2.57", "unchanged"),
    ("2.0 (a) p1 (b)", "2.0 p1", "unchanged"),
    ("10", "9", "downgraded"),
    ("2.11.4", "2.9.13", "downgraded"),
    ("15.9", "15.10", "upgraded"),
    ("13.7.10", "13.7.9", "downgraded"),
    ("", "1.0", "unchanged"),
    ("unknown", "1.0", "unchanged"),
    ("0", "1", "upgraded"),
    ("1.a", "1.0.a", "downgraded"),
    ("99999999999999999999", "0", "unchanged"),
]
BUILDS = [
    ("24B83", "24B2083", "upgraded"),
    ("20G165", "21A5268h", "upgraded"),
    ("24A5331", "24A5331a", "upgraded"),
    ("25F71", "25F5068a", "upgraded"),
    ("24B83", "24B83", "unchanged"),
    ("24B", "24B1", "upgraded"),
    ("23Z99", "24B", "upgraded"),
    ("26A5388g", "26A5378n", "downgraded"),
]


def plain_tokens(text):
    text = re.sub(r"\s*\([^)]*\)", "", text)
    tokens = []
    for run in re.findall(r"[0-9]+|[A-Za-z]+", text):
        if run[0].isdigit():
            number = int(run)
            tokens.append((2, number, "") if 0 < number < 2**63 else (0, 0, ""))
        elif tokens:
            tokens.append((1, 0, run.lower()))
    return tokens


def plain_direction(a, b):
    a, b = plain_tokens(a), plain_tokens(b)
    if not a or not b:
        return "unchanged"
    size = max(len(a), len(b))
    a, b = (x + [(0, 0, "")] * (size - len(x)) for x in (a, b))
    return "upgraded" if a < b else "downgraded" if a > b else "unchanged"


@pytest.mark.parametrize("form", ["column", "table"])
def test_fixed_pairs(spark, form):
    df = spark.createDataFrame(VERSIONS, "a string, b string, expected string")
    if form == "column":
        df = df.withColumn("got", V.compare_versions("a", "b"))
    else:
        df = V.with_direction(df, "a", "b", "got")
    assert df.where("got <> expected").collect() == []


def test_random_pairs(spark):
    rng = random.Random(7)
    parts = ["0", "1", "2", "10", "007", "00", "a", "B", "rc", "p1", ".", "-", " ", "(x)", " (1.2)", "é", "99999999999999999999"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 7))) for _ in range(1500)]
    pairs = [(a, b, plain_direction(a, b)) for a, b in zip(texts, rng.sample(texts, len(texts)))]
    df = spark.createDataFrame(pairs, "a string, b string, expected string")
    assert df.where(V.compare_versions("a", "b") != F.col("expected")).collect() == []


def test_sort_by_key(spark):
    texts = ["1.0", "1.0a", "0.9", "1.0.1", "1.10", "1.9", "2", "1.0b1", "1.0B"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").orderBy(V.version_key("v"), "v")
    compare = {"upgraded": -1, "downgraded": 1, "unchanged": 0}
    expected = sorted(sorted(texts), key=functools.cmp_to_key(lambda a, b: compare[plain_direction(a, b)]))
    assert [r.v for r in rows.collect()] == expected


def test_tokens(spark):
    row = spark.range(1).select(V.version_tokens(F.lit("Beta-1.02RC (x) 3")).alias("t")).first()
    assert row.t == ["1", "02", "rc", "3"]


def test_builds(spark):
    df = spark.createDataFrame(BUILDS, "a string, b string, expected string")
    got = V.direction_of_keys(V.build_key("a"), V.build_key("b"))
    assert df.where(got != F.col("expected")).collect() == []


def test_os_version_parts(spark):
    texts = ["15.1.2", "15", "15.x.3", "", "15..4", "+7.1"]
    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", V.os_version_key("v").alias("k"))
    got = {r.v: tuple(r.k) for r in rows.collect()}
    assert got == {
        "15.1.2": (15, 1, 2), "15": (15, 0, 0), "15.x.3": (15, 0, 3), "": (0, 0, 0), "15..4": (15, 4, 0), "+7.1": (7, 1, 0),
    }


def test_beta_flag(spark):
    rows = spark.createDataFrame([("24A1a",), ("24A1",), ("24A1B",), ("",)], "b string")
    assert [r[0] for r in rows.select(V.beta_build_flag("b")).collect()] == [True, False, False, False]


def test_release_key_ranks_betas_first(spark):
    rows = [("15.1", "24B83", False, False), ("15.1", "24B5070a", True, False), ("15.1", "24B82", False, True), ("15.0", "24A335", False, False)]
    df = spark.createDataFrame(rows, "os_version string, build_number string, is_beta boolean, is_rc boolean")
    order = [r.build_number for r in df.orderBy(V.release_key()).collect()]
    assert order == ["24A335", "24B5070a", "24B82", "24B83"]
