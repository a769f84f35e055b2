"""Reading, writing, index, quality, digests, change logs and the stream."""

import hashlib
import importlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from shipledger.functions import labels as L
from shipledger.operators import changelog, digest, flatten
from shipledger.operators import extract as X
from shipledger.operators import index as I
from shipledger.operators import quality as Q
from shipledger.plans import load_all
from shipledger.schema import data_file
from shipledger.sources import forms, readers, writers
from shipledger.streaming.upsert import stream_upsert_index


def document(**changes):
    base = {
        "productType": "macOS", "osVersion": "15.1", "buildNumber": "24B83", "releaseName": "Sequoia", "releaseDate": "2024-10-28",
        "isBeta": False, "isRC": False, "isDeviceSpecific": False,
        "ipswFile": "UniversalMac_15.1_24B83_Restore.ipsw",
        "ipswURL": "https://updates.cdn-apple.com/x/UniversalMac_15.1_24B83_Restore.ipsw",
        "components": [{"name": "curl", "version": "8.7.1", "path": "/usr/bin/curl", "source": "filesystem"}],
        "kernels": [{
            "file": "kernelcache.release.Mac16,1", "darwinVersion": "24.1.0", "xnuVersion": "1.2.3", "arch": "ARM64_T8132", "chip": "M4",
            "devices": ["Mac16,1"], "deviceChips": [{"device": "Mac16,1", "chip": "M4"}],
        }],
    }
    return {k: v for k, v in {**base, **changes}.items() if v is not ...}


def violations(spark, *documents, product="macOS", names=None):
    rows = []
    for i, d in enumerate(documents):
        name = names[i] if names else "macOS-15.1-24B83.json"
        rows.append((name, d if isinstance(d, str) else json.dumps(d)))
    raw = spark.createDataFrame(rows, "file_name string, raw string")
    return sorted((r.field, r.rule) for r in Q.validate_releases(raw, product).collect())


def test_good_document(spark):
    assert violations(spark, document()) == []


CASES = [
    (dict(releaseName=...), [("", "missing_fields")]),
    (dict(scannerVersion="1"), [("", "unexpected_fields")]),
    (dict(isBeta="yes"), [("isBeta", "not_bool")]),
    (dict(isBeta=None), [("isBeta", "not_bool")]),
    (dict(isBeta=True, betaNumber=True), []),
    (dict(isBeta=True, betaNumber=1.5), [("betaNumber", "not_positive")]),
    (dict(isBeta=True, betaNumber=1, betaRevision=True), [("betaRevision", "revision_below_two")]),
    (dict(isBeta=True, betaNumber=2, betaRevision=2), []),
    (dict(betaNumber=2, betaRevision=2), [("betaNumber", "set_without_beta")]),
    (dict(isRC=True, rcNumber=1), []),
    (dict(rcNumber=1), [("rcNumber", "set_without_rc")]),
    (dict(releaseDate="2024-13-01"), [("releaseDate", "date_invalid")]),
    (dict(osVersion="15.1 "), [("ipswURL", "url_version"), ("osVersion", "file_name_version"), ("osVersion", "version_format")]),
    (dict(ipswURL="https://evilapple.com/UniversalMac_15.1_24B83_Restore.ipsw"), [("ipswURL", "url_host")]),
    (dict(ipswURL="https://apple.com/UniversalMac_15.1_24B83_Restore.ipsw"), []),
    (dict(ipswURL="javascript:alert(1)"), [("ipswFile", "file_not_in_url"), ("ipswURL", "url_not_https")]),
    (dict(ipswURL=7), [("ipswURL", "empty")]),
    (dict(components={}), [("components", "no_entries")]),
    (dict(components=["x", {"name": "a", "version": "1", "path": "/a", "source": "sdk"}]), [("components[0]", "not_object"), ("components[1]", "component_source")]),
    (dict(components=[{"name": "a", "version": None, "path": "/a", "source": "filesystem"}]), [("components[0]", "component_version")]),
    (dict(components=[{"name": "a", "version": "1", "path": "/a", "source": "filesystem"}] * 3), [("components[1]", "component_duplicate"), ("components[2]", "component_duplicate")]),
    (dict(kernels=[]), [("kernels", "no_entries")]),
    (dict(kernels=[{"file": "f", "darwinVersion": None, "xnuVersion": "1", "arch": "a", "chip": "A12Z (DTK)", "devices": []}]), []),
    (dict(kernels=[{"file": "f", "darwinVersion": "1", "xnuVersion": "1", "arch": "a", "chip": "M1", "devices": []}]), [("kernels[0]", "no_devices")]),
]


def test_rules(spark):
    """All cases in one job; the case number stands for the file name."""
    rows = [(str(i), "24B83", "15.1", json.dumps(document(**c))) for i, (c, _) in enumerate(CASES)]
    documents = spark.createDataFrame(rows, "file_name string, build string, version string, raw string")
    found = Q.validate_documents(documents.withColumn("v", F.try_parse_json("raw")), "macOS")
    got = {}
    for r in found.collect():
        got.setdefault(int(r.file_name), []).append((r.field, r.rule))
    for i, (changes, expected) in enumerate(CASES):
        assert sorted(got.get(i, [])) == sorted(expected), changes


def test_other_files_and_broken_json(spark):
    names = ["macOS-15.1-24B83.json", "Xcode-15.1-1.json", "readme.json"]
    assert violations(spark, "{", "{", "{", names=names) == [("", "invalid_json")]


def numbered(count, rare=1):
    docs = []
    for i in range(count):
        name = "rare" if i < rare else "curl"
        part = {"name": name, "version": "1", "path": "/p", "source": "filesystem"}
        docs.append(document(buildNumber=f"24B{i}", ipswFile="f", ipswURL="https://a.apple.com/f", components=[part]))
    return docs, [f"macOS-15.1-24B{i}.json" for i in range(count)]


def test_rare_names_need_more_than_ten_releases(spark):
    docs, names = numbered(11)
    assert violations(spark, *docs, names=names) == [("components", "rare_component")]
    docs, names = numbered(10)
    assert violations(spark, *docs, names=names) == []
    docs, names = numbered(12, rare=3)
    assert violations(spark, *docs, names=names) == []


def test_duplicate_builds(spark):
    other = document(osVersion="15.2", ipswFile="f", ipswURL="https://a.apple.com/f")
    names = ["macOS-15.1-24B83.json", "macOS-15.1-24B83.json", "macOS-15.2-24B83.json"]
    assert violations(spark, document(), document(), other, names=names) == [("buildNumber", "duplicate_build")] * 2


def order_brute(builds, keys):
    expected = sorted(range(len(builds)), key=lambda i: (-keys[i], i))
    for position, i in enumerate(expected):
        if i != position:
            return position, builds[position], builds[i]
    return None


def test_index_order_random(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for case in range(25):
        size = rng.randint(1, 9)
        keys = [rng.randint(0, 5) for _ in range(size)]
        if case % 3 == 0:
            keys.sort(reverse=True)
        builds = [f"b{i}" for i in range(size)]
        rows += [(f"p{case}", b, i * 3, k) for i, (b, k) in enumerate(zip(builds, keys))]
        bad = order_brute(builds, keys)
        if bad:
            want[f"p{case}"] = bad
    df = spark.createDataFrame(rows, "product string, build_number string, pos bigint, k int")
    got = {r.product: (r.position, r.actual, r.expected) for r in I.index_order_check(df, F.col("k")).collect()}
    assert got == want


def flat(spark, rows):
    return spark.createDataFrame(
        [("macOS", v, b, n, None, False, None, None, False, None, False) for v, b, n in rows],
        "product string, os_version string, build_number string, release_name string, release_date date, is_beta boolean, "
        "beta_number int, beta_revision int, is_rc boolean, rc_number int, is_device_specific boolean",
    ).withColumn("data_file", data_file())


def test_index_upsert_round_trip(spark, tmp_path):
    base = str(tmp_path / "index")
    assert readers is not None and writers.read_index(spark, base) is None
    writers.write_index(flat(spark, [("15.1", "24B83", "old"), ("15.0", "24A335", "x")]), base)
    new = flat(spark, [("15.1", "24B83", "new"), ("15.1", "24B2083", "y")])
    writers.write_index(I.upsert_index(writers.read_index(spark, base), new), base)
    lines = [json.loads(r.value) for r in writers.index_json(writers.read_index(spark, base)).collect()]
    assert [(d["buildNumber"], d["releaseName"]) for d in lines] == [("24B2083", "y"), ("24B83", "new"), ("24A335", "x")]
    assert list(lines[0]) == sorted(lines[0]) and lines[0]["dataFile"] == "releases/15/macOS-15.1-24B2083.json"


def ranges(spark, base):
    manifest = spark.read.parquet(f"{base}/m-{writers.current_version(spark, base)}")
    return sorted((r.low.build_number, r.high.build_number, r.rows, r.folder) for r in manifest.collect())


def test_merge_touches_only_its_ranges(spark, tmp_path):
    base = str(tmp_path / "index")
    rows = {f"24B{i:03d}": f"name {i}" for i in range(100)}
    index = lambda of: flat(spark, [("15.1", build, name) for build, name in of.items()])
    writers.write_index(index(rows), base, range_rows=10)
    before = ranges(spark, base)
    assert len(before) == 10 and all(a[1] < b[0] for a, b in zip(before, before[1:]))
    changes = {"24A": "first", "24B031": "new", "24B0315": "between", "24C": "last"}
    writers.merge_index(index(changes), base, range_rows=10)
    after = ranges(spark, base)
    touched = [r for r in after if r[3] not in {b[3] for b in before}]
    assert [sum(r[2] for r in touched), len(after)] == [33, 10]
    assert {r.build_number: r.release_name for r in writers.read_index(spark, base).collect()} == rows | changes
    # A range that grows is split; a replay changes nothing.
    many = {f"24B050-{i:02d}": "m" for i in range(30)}
    for _ in range(2):
        writers.merge_index(index(many).withColumn("note", F.lit("n")), base, range_rows=10)
        final = ranges(spark, base)
        assert all(a[1] < b[0] for a, b in zip(final, final[1:])) and max(r[2] for r in final) <= 20
        found = writers.read_index(spark, base).collect()
        assert {r.build_number: r.release_name for r in found} == rows | changes | many
        assert len(found) == 133 and sum(r.note == "n" for r in found) == 30
    writers.merge_index(index({f"25{i}": "x" for i in range(200)}), base, range_rows=10)
    assert writers.read_index(spark, base).count() == 333
    names = [p.name for p in (tmp_path / "index").iterdir()]
    assert sum(n.startswith("m-") for n in names) == 2


def test_publish_current(spark, tmp_path):
    out = str(tmp_path)
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, `v.w` string")
    read = lambda: sorted(r.value for r in spark.read.text(writers.published(spark, out, "set")).collect())
    assert writers.published(spark, out, "set") is None
    of = writers.fingerprint(rows)
    assert of == writers.fingerprint(rows.orderBy(F.desc("id"))) != writers.fingerprint(rows.limit(1)) and writers.fingerprint(rows.where("false")) == "0-0-0"
    assert writers.publish_current(rows, "set", out, of=of) and read() == ['{"id":1,"v.w":"a"}', '{"id":2}']
    first = writers.published(spark, out, "set")
    assert not writers.publish_current(rows, "set", out, of=of) and writers.published(spark, out, "set") == first
    broken = rows.withColumn("id", F.expr("CAST(raise_error('stopped') AS INT)"))
    with pytest.raises(Exception):
        writers.publish_current(broken, "set", out, of="other")
    assert writers.published(spark, out, "set") == first and len(read()) == 2
    assert writers.publish_current(rows.where("id = 1"), "set", out) and read() == ['{"id":1,"v.w":"a"}']
    assert spark.read.text(first).count() == 2  # readers of the one before can finish
    assert writers.publish_current(rows.where("id = 2"), "set", out) and read() == ['{"id":2}']
    assert sum(p.name.startswith("v-") for p in (tmp_path / "set").iterdir()) == 2


def test_broken_index_is_not_replaced(spark, tmp_path):
    base = tmp_path / "index"
    writers.write_index(flat(spark, [("15.1", "24B83", "x")]), str(base))
    (base / "CURRENT").write_text("missing")
    (base / ".CURRENT.crc").unlink(missing_ok=True)
    with pytest.raises(Exception):
        writers.read_index(spark, str(base))


def test_scan_tree(spark, tmp_path):
    folder = tmp_path / "releases" / "15"
    folder.mkdir(parents=True)
    (folder / "macOS-15.1-24B83.json").write_text(json.dumps(document(scannerVersion="9", isDeviceSpecific=..., isRC=...), indent=2))
    (folder / "bad.json").write_text('{"osVersion": "1"}')
    docs = readers.scan_releases(spark, str(tmp_path))
    row = readers.flat_releases(docs).first()
    assert (row.product, row.build_number, row.is_rc, row.is_device_specific) == ("macOS", "24B83", False, False)
    assert docs.count() == 1
    assert flatten.explode_components(docs).first().name == "curl"
    assert flatten.explode_device_chips(docs).first().chip == "M4"
    assert flatten.explode_kernels(docs).first().devices == ["Mac16,1"]
    located = readers.relative_data_file(docs)
    entries = [{"osVersion": "15.1", "buildNumber": "24B83", "releaseName": "S", "dataFile": "releases/15/macOS-15.1-24B83.json"}, {"osVersion": "1", "buildNumber": "e", "releaseName": "S", "dataFile": "../x.json"}]
    (tmp_path / "index.txt").write_text(json.dumps(entries))
    index = readers.scan_index(spark, str(tmp_path / "index.txt"))
    assert [(r.pos, r.id, r.is_beta) for r in index.orderBy("pos").collect()] == [(0, "15.1-24B83", False), (1, "1-e", False)]
    loaded, refused = readers.load_indexed(index, located)
    assert loaded.first().document.osVersion == "15.1" and refused.first().build_number == "e"


def test_nest_and_flatten(spark):
    releases = flat(spark, [("15.1", "a", "x"), ("15.1", "b", "y")]).withColumns(
        {"file": F.lit("f"), "url": F.lit("u"), "minimum_os_version": F.lit(None).cast("string")}
    )
    rows = [("macOS", "a", 1, "n1", "1", "/p", "sdk"), ("macOS", "a", 0, "n0", None, "/p", "sdk")]
    components = spark.createDataFrame(rows, "product string, build_number string, ord int, name string, version string, path string, source string")
    nested = flatten.nest_release(releases, components)
    assert {r.build_number: [c.name for c in r.components] for r in nested.collect()} == {"a": ["n0", "n1"], "b": []}
    assert sorted(r.name for r in flatten.explode_components(nested).collect()) == ["n0", "n1"]


def test_digests(spark, tmp_path):
    good = hashlib.sha256(b"abc").hexdigest()
    files = spark.createDataFrame([("a", 3, bytearray(b"abc")), ("b", 3, bytearray(b"abc")), ("c", 3, bytearray(b"abc"))], "path string, length bigint, content binary")
    cars = spark.createDataFrame([("a", good.upper() + "  a.ipsw\n"), ("b", "\n0  b")], "path string, value string")
    assert {r.path: r.status for r in digest.archive_digest(files, cars).collect()} == {"a": "verified", "b": "failed", "c": "hashed"}
    assert {r.status for r in digest.archive_digest(files, cars, rehash=True).collect()} == {"hashed"}

    large = b"0123456789abcdef" * (1 << 16) * 20  # several reads
    (tmp_path / "large.ipsw").write_bytes(large)
    paths = [(f"file:{tmp_path}/large.ipsw", len(large)), (f"{tmp_path}/none.ipsw", 1)]
    found = digest.archive_digest(spark.createDataFrame(paths, "path string, length bigint"), cars).collect()
    assert {r.path.rpartition("/")[2]: (r.status, r.digest) for r in found} == {
        "large.ipsw": ("hashed", hashlib.sha256(large).hexdigest()), "none.ipsw": ("unreadable", None)
    }


def test_index_text(spark):
    def rules(*values):
        return [r.rule for r in Q.validate_index_text(spark.createDataFrame([(v,) for v in values], "value string")).collect()]

    assert rules('[{"buildNumber": "A"}, 3, null]') == [] and rules("[]") == []
    assert rules('[{"a": 1}, {"b"') == ["invalid_json"] and rules("{}") == ["not_array"] and rules() == ["index_missing"]
    entries = Q.index_entries(spark.createDataFrame([('[{"b": 1,  "a": [2, "x"]}, 3, {"c": null}]',)], "value string")).collect()
    assert [(r.pos, json.loads(r.raw)) for r in entries] == [(0, {"b": 1, "a": [2, "x"]}), (1, 3), (2, {"c": None})]


def test_large_index_text(spark):
    count = 700_000
    texts = spark.createDataFrame([("x",)], "v string").select(F.expr("repeat('n', 170)").alias("n")).select(
        F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.concat(F.lit('{"buildNumber": "B'), i.cast("string"), F.lit('", "releaseName": "'), F.col("n"), F.lit('"}'))), ","), F.lit("]")).alias("value")
    )
    assert texts.select(F.length("value")).first()[0] > Q.VARIANT_BYTES
    assert Q.validate_index_text(texts).count() == 0
    assert Q.index_entries(texts).count() == count


def test_rejected_documents(spark, tmp_path):
    good = {"osVersion": "15.1", "buildNumber": "A1", "releaseName": "n"}
    (tmp_path / "a.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b.json").write_text("{ not json")
    (tmp_path / "c.json").write_text(json.dumps({"osVersion": "15.1", "releaseName": "n"}))
    rejected = {r.file_path.rpartition("/")[2]: r.reason for r in readers.scan_rejected(spark, str(tmp_path)).collect()}
    assert rejected == {"b.json": "invalid_json", "c.json": "buildNumber"}
    assert [r.build_number for r in readers.flat_releases(readers.scan_releases(spark, str(tmp_path))).collect()] == ["A1"]


@pytest.mark.parametrize("whole_bytes", [forms.WHOLE_BYTES, 0])
def test_scan_takes_every_line(spark, tmp_path, monkeypatch, whole_bytes):
    """Small files are read whole, large ones by line; both give the same."""
    monkeypatch.setattr(forms.document_texts, "__defaults__", (None, whole_bytes))

    def row(build, **more):
        return {"osVersion": "15.1", "buildNumber": build, "releaseName": "n", **more}

    lines = [json.dumps(row(f"L{i}")) for i in range(3)]
    (tmp_path / "lines.json").write_text("\n".join(lines))
    (tmp_path / "first.json").write_text("{\"torn\":\n" + "\n\n".join(json.dumps(row(f"F{i}")) for i in range(2)))
    (tmp_path / "middle.json").write_text("\r\n".join([json.dumps(row("M0")), "# comment", json.dumps(row("M1")), '{"osVersion": "1"}']))
    (tmp_path / "mark.json").write_text("\ufeff" + json.dumps(row("B0")) + "\n" + json.dumps(row("B1")))
    (tmp_path / "two.json").write_text(json.dumps(row("T0")) + " " + json.dumps(row("T1")))
    parts = ",\n".join(json.dumps({"name": n, "version": "1", "path": "/p", "source": "sdk"}) for n in "ab")
    (tmp_path / "pretty.json").write_text(json.dumps(row("P0"))[:-1] + ',\n"components": [\n' + parts + "\n]\n}\n")
    (tmp_path / "array.json").write_text(json.dumps([row("A0"), row("A1"), 7], indent=1))
    (tmp_path / "broken.json").write_text("{ broken\n document }")
    docs = readers.scan_releases(spark, str(tmp_path)).collect()
    assert sorted(r.build_number for r in docs) == ["A0", "A1", "B0", "B1", "F0", "F1", "L0", "L1", "L2", "M0", "M1", "P0"]
    assert [len(r.components) for r in docs if r.build_number == "P0"] == [2]
    rejected = sorted((r.file_path.rpartition("/")[2], r.reason) for r in readers.scan_rejected(spark, str(tmp_path)).collect())
    assert rejected == [
        ("array.json", "invalid_json"), ("broken.json", "invalid_json"), ("first.json", "invalid_json"),
        ("middle.json", "buildNumber"), ("middle.json", "invalid_json"), ("two.json", "invalid_json"),
    ]


def test_stream_takes_both_forms_and_keeps_rejects(spark, tmp_path):
    def row(build, name):
        return {"osVersion": "15.1", "buildNumber": build, "releaseName": name}

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text(json.dumps(row("A1", "pretty"), indent=2))
    (tmp_path / "in" / "2.json").write_text("\n".join(json.dumps(row("B1", n)) for n in ("x", "y", "z")) + "\nnot json\n")
    (tmp_path / "in" / "3.json").write_text("{ broken\n document")
    stream_upsert_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    index = {r.build_number: r.release_name for r in writers.read_index(spark, str(tmp_path / "index")).collect()}
    assert index == {"A1": "pretty", "B1": "z"}
    assert sorted(r.document for r in spark.read.json(str(tmp_path / "index-rejects")).collect()) == ["not json", "{ broken\n document"]


def test_stream_rejects_only_broken_lines(spark, tmp_path):
    def row(build):
        return json.dumps({"osVersion": "15.1", "buildNumber": build, "releaseName": "n"})

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "first[1].json").write_text("\n".join(["torn line", row("A1"), row("A2")]))
    (tmp_path / "in" / "middle.json").write_text("\n".join([row("B1"), "# comment", row("B2"), '{"torn":', row("B3")]))
    (tmp_path / "in" / "mark.json").write_text("\ufeff" + row("C1") + "\n" + row("C2"))
    stream_upsert_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()
    index = sorted(r.build_number for r in writers.read_index(spark, str(tmp_path / "index")).collect())
    assert index == ["A1", "A2", "B1", "B2", "B3", "C1", "C2"]
    assert sorted(r.document for r in spark.read.json(str(tmp_path / "index-rejects")).collect()) == ["# comment", "torn line", '{"torn":']


def test_large_files_give_the_texts_of_small_ones(spark, tmp_path):
    texts = {
        "cut.json": '{\n  "a": [1,\n  2\n', "pretty.json": json.dumps([{"a": 1}, {"b": [{"c": 2}]}], indent=2), "row.json": '[\n{"a":1},\n{"b":2}\n]',
        "lines.json": '{"a": 1}\n{broken\n[2]\n', "words.json": "no\njson\n", "torn.json": '{"x":\n{"a": 1}\n', "one.json": '{"a": {"b": 1}}',
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    small, large = (
        sorted((r.file_path.rpartition("/")[2], r.line, r.item, r.text.strip()) for r in forms.document_texts(spark, str(tmp_path), "*.json", size).collect())
        for size in (forms.WHOLE_BYTES, 0)
    )
    numbered = lambda rows: [(name, text) for name, _, _, text in sorted(rows)]
    assert numbered(small) == numbered(large) and len(small) == 13


@pytest.mark.parametrize("whole_bytes", [forms.WHOLE_BYTES, 0])
def test_stream_orders_a_build_over_files(spark, tmp_path, monkeypatch, whole_bytes):
    """A build in two files of a batch: the order field decides, also in files read by line."""
    monkeypatch.setattr(forms.document_texts, "__defaults__", (None, whole_bytes))

    def row(name, seq):
        return json.dumps({"osVersion": "15.1", "buildNumber": "A", "releaseName": name, "seq": seq})

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text("\n".join([row("third", "3"), row("last", "4"), row("second", "2")]))
    os.utime(tmp_path / "in" / "1.json", (1_000_000_000, 1_000_000_000))
    (tmp_path / "in" / "2.json").write_text("\n".join([row("first", "1"), row("zero", "0")]))
    for order, expected in (("seq", "last"), (None, "zero")):
        out = str(tmp_path / f"index-{order}")
        stream_upsert_index(spark, str(tmp_path / "in"), out, f"{out}-check", order=order).awaitTermination()
        assert [r.release_name for r in writers.read_index(spark, out).collect()] == [expected]


def test_change_lines(spark):
    lines = [
        "## What's Changed", "* feat(site): add page by @a-b in https://x/1", "* fix: typo", "* chore: bump by @x in https://x/2",
        "* plain words in https://x/3", "**Full Changelog**: https://x/compare/a...b", "* odd: kept", "  * perf: fast  ", "*nospace",
        "* feat(a:b): scoped by @x", "* fix(open: no scope", "* Fix: capital", "* feat:", "* docs(x) : no", "**Full Changelog**: ftp://x", "* x by @y in z",
    ]
    df = spark.createDataFrame([(1, i, line) for i, line in enumerate(lines)], "doc_id int, ord int, line string")
    rows = changelog.section_lists(changelog.classify_change_lines(df)).collect()
    assert [(r.section, r.entries) for r in rows] == [
        ("What's New", ["add page", "scoped"]), ("Fixes", ["typo"]), ("Performance", ["fast"]), ("Other", ["plain words", "kept", "fix(open: no scope", "Fix: capital", "feat:", "docs(x) : no", "x by @y in z"]),
        ("Full Changelog", ["https://x/compare/a...b"]),
    ]


def test_stream_keeps_the_last_entry(spark, tmp_path):
    def deliver(number, rows):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{number}.json").write_text("\n".join(json.dumps(r) for r in rows))
        stream_upsert_index(spark, str(tmp_path / "in"), str(tmp_path / "index"), str(tmp_path / "check")).awaitTermination()

    def row(build, name, **more):
        return {"osVersion": "15.1", "buildNumber": build, "releaseName": name, **more}

    deliver(0, [row("a", "1"), row("a", "2"), row("b", "1"), {"osVersion": "x"}, row("c", "1", productType="watchOS")])
    deliver(1, [row("b", "3")])
    index = writers.read_index(spark, str(tmp_path / "index"))
    assert {r.build_number: r.release_name for r in index.collect()} == {"a": "2", "b": "3"}
    assert index.columns.count("data_file") == 1


def test_labels(spark):
    rows = [("macOS", "15.1", "b", "Sequoia", True, 3, 2, False, None), ("Xcode", "16.0", "b", "Xcode 16.0", False, None, None, True, 2), ("macOS", "15.1", "b", "Sequoia", True, None, None, False, None)]
    df = spark.createDataFrame(rows, "product string, os_version string, build_number string, release_name string, is_beta boolean, beta_number int, beta_revision int, is_rc boolean, rc_number int")
    got = [tuple(r) for r in df.select(L.display_name(), L.cli_display_name()).collect()]
    assert got == [
        ("macOS 15.1 Sequoia beta 3 v.2", "macOS 15.1 Sequoia Developer Beta 3 v.2"), ("Xcode 16.0 RC 2", "Xcode 16.0"),
        ("macOS 15.1 Sequoia", "macOS 15.1 Sequoia Beta"),
    ]
    slugs = ["libbz2 (bzip2)", " A (b) c (d) ", "x(y)", "Plain"]
    out = spark.createDataFrame([(s,) for s in slugs], "name string").select(L.component_slug()).collect()
    assert [r[0] for r in out] == ["libbz2", "a", "x", "plain"]


def test_folders_are_pruned(spark, tmp_path):
    releases = flat(spark, [("15.1", "a", "x"), ("14.1", "b", "y")]).withColumns(
        {"file": F.lit("f"), "url": F.lit("u"), "minimum_os_version": F.lit(None).cast("string")}
    )
    rows = [("macOS", "a", 0, "n", "1", "/p", "sdk")]
    components = spark.createDataFrame(rows, "product string, build_number string, ord int, name string, version string, path string, source string")
    nested = flatten.nest_release(releases, components)
    for fmt in ("json", "parquet"):
        writers.write_releases(nested, str(tmp_path / fmt), fmt)
        found = readers.scan_release_lines(spark, str(tmp_path / fmt), "macOS", 15, fmt)
        assert [r.build_number for r in found.collect()] == ["a"]
        assert len(found.inputFiles()) >= 1


def test_sdk_settings(spark, tmp_path):
    for name, text in (("MacOSX15.0.sdk", '{"Version": "15.0"}'), ("DriverKit.sdk", '{"Version": "24"}'), ("MacOSX.sdk", "{}")):
        folder = tmp_path / "SDKs" / name
        folder.mkdir(parents=True)
        (folder / "SDKSettings.json").write_text(text)
    found = readers.scan_sdk_settings(spark, str(tmp_path)).select(
        F.lit("Xcode").alias("product"), F.lit("b").alias("build_number"), "sdk_dir", F.lit(0).alias("ord"), "version"
    )
    builds = found.select("product", "build_number", "sdk_dir", F.lit("24A336").alias("sdk_build"))
    assert [(r.sdk_version, r.build_version) for r in X.sdk_rows(found, builds).collect()] == [("15.0", "24A336")]


@pytest.mark.parametrize("query, source, key, text", [("scan_texts", "documents", "doc_id", "text"), ("scan_artifacts", "pages", "page_id", "html")])
def test_files_follow_bytes_not_rows(spark, tmp_path, monkeypatch, query, source, key, text):
    load_all()
    plans = importlib.import_module("shipledger.plans.documents")
    texts = ["", "\n", "a\nb\n\n", '{"x": "\\n"}', "  é 😀\r\n\t\x00", *[f"t {i}" for i in range(600)]]
    rows = spark.createDataFrame(list(enumerate(texts)), f"{key} long, {text} string").coalesce(1)
    rows.write.parquet(str(tmp_path / f"{source}.parquet"))
    monkeypatch.setattr(plans, "scratch", lambda spark, name: str(tmp_path / name))
    found = {r[key]: r.digest for r in getattr(plans, query)(spark, str(tmp_path)).collect()}
    assert found == {str(i): hashlib.sha256(f"{t}\n".encode()).hexdigest() for i, t in enumerate(texts)}
    assert len(list(tmp_path.glob("*s/**/*.txt"))) == -(-len(texts) // plans.BUNDLE_ROWS)


def test_written_json_can_be_compressed(spark, tmp_path):
    rows = spark.createDataFrame([("macOS", f"1A{i}", "15.1") for i in range(50)], "product string, buildNumber string, osVersion string")
    writers.publish(rows, "p", str(tmp_path), by=["product"], compression="gzip")
    writers.write_releases(rows, str(tmp_path / "r"), compression="gzip")
    assert not list(tmp_path.rglob("*.txt")) + list(tmp_path.rglob("*.json"))
    for folder in ("p", "r"):
        back = spark.read.schema("buildNumber string").json(str(tmp_path / folder))
        assert sorted(r.buildNumber for r in back.collect()) == sorted(f"1A{i}" for i in range(50))


def test_judging_looks_into_a_document_once(spark):
    documents = spark.createDataFrame([("macOS-15.1-24B83.json", json.dumps(document()))], "file_name string, raw string")
    plan = Q.judge_documents(Q.catalog_documents(documents, "macOS"), "macOS")._jdf.queryExecution().optimizedPlan().toString()
    assert "$.osVersion" not in plan


def test_ranges_stay_few(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "MAX_RANGES", 4)
    base = str(tmp_path / "index")
    rows = {f"24B{i:03d}": f"name {i}" for i in range(100)}
    index = lambda of: flat(spark, [("15.1", build, name) for build, name in of.items()])
    writers.write_index(index(rows), base, range_rows=2)
    assert len(ranges(spark, base)) == 4
    # Builds that only arrive at the end split the last range, until the whole is written anew.
    counts = []
    for batch in range(3):
        more = {f"25{batch}{i:03d}": "m" for i in range(12 * (batch + 1) + 28)} | {"24B031": f"new {batch}"}
        rows |= more
        writers.merge_index(index(more), base, range_rows=2)
        found = ranges(spark, base)
        counts.append(len(found))
        assert all(a[1] < b[0] for a, b in zip(found, found[1:])) and sum(r[2] for r in found) == len(rows)
    assert max(counts) <= 3 * 4
    assert {r.build_number: r.release_name for r in writers.read_index(spark, base).collect()} == rows
