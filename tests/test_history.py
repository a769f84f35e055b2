"""Histories."""

from datetime import date

from pyspark.sql import functions as F

from shipledger.operators import history as H

RELEASES = "product string, os_version string, build_number string, release_name string, release_date date, is_beta boolean, beta_number int, beta_revision int, is_rc boolean, rc_number int, pos bigint"
COMPONENTS = "product string, build_number string, ord int, name string, version string, path string, source string"


def releases(spark):
    rows = [
        ("macOS", "15.1", "c", "Sequoia", date(2024, 3, 1), False, None, None, False, None, 0),
        ("macOS", "15.1", "b", "Sequoia", date(2024, 2, 1), True, 2, None, False, None, 1),
        ("macOS", "15.0", "a", "Sequoia", date(2024, 2, 1), False, None, None, False, None, 2),
        ("macOS", "14.0", "z", "Sonoma", None, False, None, None, True, 3, 3),
    ]
    return spark.createDataFrame(rows, RELEASES)


def components(spark):
    rows = [
        ("macOS", "a", 0, "Tool (x)", "1.0", "/a", "sdk"), ("macOS", "b", 0, "Tool", "1.0", "/b", "sdk"),
        ("macOS", "c", 0, "Tool", "1.2", "/c", "sdk"), ("macOS", "z", 0, "Tool", "2.0", "/z", "sdk"),
        ("macOS", "a", 1, "Old", None, "/o", "sdk"), ("macOS", "c", 1, "Tool", "9", "/dup", "sdk"),
    ]
    return spark.createDataFrame(rows, COMPONENTS)


def test_latest_components(spark):
    got = {r.name: (r.version, r.path) for r in H.latest_components(components(spark), releases(spark)).collect()}
    assert got == {"Tool": ("1.2", "/c"), "Tool (x)": ("1.0", "/a"), "Old": ("", "/o")}


def test_history_takes_the_earliest_release(spark):
    history = H.component_history(components(spark), releases(spark))
    got = {(r.slug, r.version): (r.first_release, r.first_release_slug) for r in history.collect()}
    assert got[("tool", "1.0")] == ("macOS 15.1 Sequoia beta 2", "15.1-b")
    assert got[("tool", "2.0")] == ("macOS 14.0 Sonoma RC 3", "14.0-z")
    assert got[("old", "")] == ("macOS 15.0 Sequoia", "15.0-a")


def test_direction_goes_up_to_the_lowest(spark):
    history = H.component_history(components(spark), releases(spark))
    got = {(r.slug, r.version): r.direction for r in H.history_direction(history).collect()}
    assert got == {("tool", "9"): "upgraded", ("tool", "2.0"): "upgraded", ("tool", "1.2"): "upgraded", ("tool", "1.0"): "added", ("old", ""): "added"}


def test_sdk_history(spark):
    rows = [("macOS", "a", 0, "15.0", "24A1"), ("macOS", "b", 0, "15.0", "24A1"), ("macOS", "c", 0, "15.0", None), ("macOS", "c", 1, "15.0", "24A9"), ("macOS", "c", 2, "15.1", "24B1")]
    sdks = spark.createDataFrame(rows, "product string, build_number string, ord int, sdk_version string, build_version string")
    got = {(r.sdk_version, r.build_number): (r.sdk_build, r.is_first_shipping_build, r.latest_build) for r in H.sdk_history(sdks, releases(spark)).collect()}
    assert got == {
        ("15.0", "b"): ("24A1", True, "24A1"), ("15.0", "a"): ("24A1", False, "24A1"),
        ("15.0", "c"): (None, False, "24A1"), ("15.1", "c"): ("24B1", True, "24B1"),
    }
    assert [r.sdk_version for r in H.sdk_versions(sdks).collect()] == ["15.1", "15.0"]
    assert H.dedupe_sdks(sdks).where("build_number = 'c'").collect()[1].build_version is None


def test_direction_shuffles_a_history_once(spark):
    rows = [("macOS", f"s{i % 50}", f"1.{i}", i) for i in range(1000)]
    history = spark.createDataFrame(rows, "product string, slug string, version string, min_pos int")
    directed = H.history_direction(history)
    plan = directed._jdf.queryExecution().executedPlan().toString()
    # One shuffle brings a slug together, and no version key is computed again for its direction.
    assert plan.count("Exchange") == 1 and "regexp" not in plan
    assert sorted(r.n for r in directed.groupBy("direction").agg(F.count("*").alias("n")).collect()) == [50, 950]
