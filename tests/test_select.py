"""Selection, resolution and lookup."""

from pyspark.sql import functions as F

from shipledger.operators import select as S

RELEASE = (
    "product string, os_version string, build_number string, release_name string, release_date date, is_beta boolean, "
    "beta_number int, beta_revision int, is_rc boolean, rc_number int, is_device_specific boolean, pos bigint"
)


def releases(spark, rows):
    full = []
    for i, row in enumerate(rows):
        base = dict(
            product="macOS", os_version="15.1", build_number="b", release_name="Sequoia", release_date=None, is_beta=False,
            beta_number=None, beta_revision=None, is_rc=False, rc_number=None, is_device_specific=False, pos=i,
        )
        full.append(tuple({**base, **row}.values()))
    return spark.createDataFrame(full, RELEASE).withColumn("release_date", F.col("release_date"))


def test_preferred_build(spark):
    df = releases(spark, [
        dict(build_number="24B2083", is_device_specific=True),
        dict(build_number="24B83"),
        dict(build_number="24B5070a", is_beta=True, beta_number=9),
        dict(os_version="16.0", build_number="25A1a", is_beta=True, beta_number=2),
        dict(os_version="16.0", build_number="25A1b", is_beta=True, beta_number=2, beta_revision=2),
        dict(os_version="16.1", build_number="25B10", is_rc=True, rc_number=1),
        dict(os_version="16.1", build_number="25B9", is_rc=True, rc_number=2),
        dict(os_version="17", build_number="26A9"),
        dict(os_version="17", build_number="26A10"),
    ])
    got = {r.os_version: r.build_number for r in S.preferred_release(df).collect()}
    assert got == {"15.1": "24B83", "16.0": "25A1b", "16.1": "25B9", "17": "26A10"}


def test_list_is_ascending(spark):
    df = releases(spark, [
        dict(build_number="24B2083"), dict(build_number="24B83"), dict(os_version="14.0", build_number="23A344"), dict(os_version="15.0", build_number="24A335"),
    ])
    assert [r.build_number for r in S.list_releases(df).collect()] == ["23A344", "24A335", "24B83", "24B2083"]
    assert [r.build_number for r in S.list_releases(df, 14).collect()] == ["23A344"]


def test_resolve(spark):
    df = releases(spark, [dict(build_number="24B2083", is_device_specific=True), dict(build_number="24B83")])
    specs = [("macOS", "15.1", None), ("macOS", "15.1-24B2083", None), ("macOS", "15.1", "24B2083"), ("macOS", "15.1-", None),
             ("macOS", "-24B83", None), ("macOS", "9.9", None), ("Xcode", "15.1", None), ("macOS", "15.1-a-b", None)]
    out = S.resolve_specs(spark.createDataFrame(specs, "product string, spec string, build string"), df)
    got = {(r.product, r.spec, r.build): (r.status, r.build_number) for r in out.collect()}
    assert got == {
        ("macOS", "15.1", None): ("resolved", "24B83"),
        ("macOS", "15.1-24B2083", None): ("resolved", "24B2083"),
        ("macOS", "15.1", "24B2083"): ("resolved", "24B2083"),
        ("macOS", "15.1-", None): ("invalid", None),
        ("macOS", "-24B83", None): ("invalid", None),
        ("macOS", "9.9", None): ("unmatched", None),
        ("Xcode", "15.1", None): ("unmatched", None),
        ("macOS", "15.1-a-b", None): ("unmatched", None),
    }


def test_lookup_tiers(spark):
    names = ["libbz2 (bzip2)", "libbz2-extra", "curl", "Curl", "OpenSSH", "libcurl"]
    rows = [("macOS", "b", i, n, "1", f"/{n}", "filesystem") for i, n in enumerate(names)]
    components = spark.createDataFrame(rows, "product string, build_number string, ord int, name string, version string, path string, source string")
    asked = ["CURL", "libbz2", "lib", "ss", "s", "", "zzz", "libbz2 (other)", "ibcu"]
    requests = spark.createDataFrame([("macOS", "b", a) for a in asked], "product string, build_number string, request string")
    got = {}
    for r in S.lookup_components(requests, components).collect():
        got.setdefault(r.request, []).append((r.tier, r.name))
    assert {k: sorted(v) for k, v in got.items()} == {
        "CURL": [(1, "curl")],
        "libbz2": [(2, "libbz2 (bzip2)")],
        "libbz2 (other)": [(2, "libbz2 (bzip2)")],
        "lib": [(3, "libbz2 (bzip2)"), (3, "libbz2-extra"), (3, "libcurl")],
        "ss": [(3, "OpenSSH")],
        "s": [(3, "OpenSSH")],
        "": sorted((3, n) for n in names),
        "ibcu": [(3, "libcurl")],
    }


def latest(spark, rows):
    from datetime import date

    df = releases(spark, [{**r, "release_date": date.fromisoformat(r["release_date"])} for r in rows])
    row = S.latest_releases(df).first()
    return row and (row.ga and row.ga.build_number, row.prerelease and row.prerelease.build_number)


def test_latest(spark):
    ga = dict(os_version="26.6", build_number="g", release_date="2026-06-25")
    beta = dict(os_version="27.0", build_number="p", release_date="2026-06-22", is_beta=True)
    own = dict(os_version="26.6", build_number="q", release_date="2026-06-10", is_rc=True)
    assert latest(spark, [ga, beta]) == ("g", "p")
    assert latest(spark, [ga, own]) == ("g", None)
    assert latest(spark, [beta]) == (None, "p")
    assert latest(spark, [ga]) == ("g", None)


def test_projection_order(spark):
    rows = [("macOS", "b", n, "1", "/p", "sdk") for n in ["b", "curl", "A", "B", "Ruby", "a"]]
    df = spark.createDataFrame(rows, "product string, build_number string, name string, version string, path string, source string")
    assert [r.name for r in S.component_projection(df).collect()] == ["a", "A", "b", "B", "curl", "Ruby"]


def test_lookup_reads_components_once(spark):
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(name):
        read.add(1)
        return name

    # Other releases than those asked for are read too, but no component twice.
    rows = [("macOS", f"b{i % 4}", i, f"lib{i}", "1", f"/{i}", "filesystem") for i in range(200)]
    components = spark.createDataFrame(rows, "product string, build_number string, ord int, name string, version string, path string, source string")
    requests = spark.createDataFrame([("macOS", "b1", a) for a in ("LIB1", "lib5 (x)", "b19", "none")], "product string, build_number string, request string")
    out = S.lookup_components(requests, components.withColumn("name", counted("name"))).collect()
    assert sorted((r.request, r.tier, r.name) for r in out) == sorted(
        [("LIB1", 1, "lib1"), ("lib5 (x)", 2, "lib5"), *(("b19", 3, f"lib{i}") for i in (193, 197))]
    )
    assert read.value <= len(rows)


def test_containing_names_meet_only_in_results(spark):
    words = ["", "a", "ab", "part-12", "part-12 (compat)", "com.example.framework.one", "com.example.framework.two", "Ünïcode", "aaaaaaaaaaaaaaaaaaaaaaaa"]
    names = words + [f"part-{i}" for i in range(300)]
    terms = words + [None, "t-1", "t-12", "rt-29", "zzz", "example.framework.t", "example.framework.zz", "aaaaaaaaaaaaaaaaa"]
    frame = lambda of, column: spark.createDataFrame([(x,) for x in of], f"{column} string")
    want = {(t, n) for t in terms if t is not None for n in names if t in n}
    for some in (terms, [t for t in terms if t is None or len(t) <= S.PIECE], ["x" * 30], []):
        out = S._containing_names(frame(some, "term").distinct(), frame(names, "lname").distinct())
        got = [(r.term, r.lname) for r in out.collect()]
        assert len(got) == len(set(got)) and set(got) == {p for p in want if p[0] in some}
    # Short terms need no check after they met, however many names share their letters.
    plan = S._containing_names(frame(["t-1", "t-12"], "term"), frame(names, "lname"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains(" not in plan
