"""Splittable JSON arrays against the json module."""

import json
import random

import pytest

from shipledger.sources import readers
from shipledger.sources.arrays import array_entries


@pytest.fixture
def ranges(spark):
    """Set the size of the byte ranges that files are read in."""
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        for k in kept:
            spark.conf.set(k, str(size))

    yield use
    for k, v in kept.items():
        spark.conf.set(k, v)


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 0:
        return rng.randint(-5, 10**6)
    if kind == 1:
        return "".join(rng.choice('ab,:"\\{}[] \n漢\t') for _ in range(rng.randint(0, 30)))
    if kind in (2, 3, 4):
        return rng.choice([None, True, 1.5, "", "}", "[,", '\\"'])
    if kind == 5:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {f'k"{i}}}': value(rng, depth + 1) for i in range(rng.randint(0, 4))}


@pytest.mark.parametrize("size", [7, 64, 500, 1 << 27])
def test_entries_of_any_range(spark, tmp_path, ranges, size):
    ranges(size)
    rng = random.Random(size)
    written = {}
    for i in range(3):
        entries = [value(rng) if rng.random() < 0.7 else {"n": k, "of": [{"a": "}"}] * 3} for k in range(rng.randint(1, 40))]
        text = json.dumps(entries, ensure_ascii=i > 0, indent=i or None)
        (tmp_path / f"f{i}.json").write_text(("﻿" if i == 2 else "") + text + "\n", encoding="utf-8")
        written[f"f{i}.json"] = entries
    found = {}
    for r in array_entries(spark, str(tmp_path)).collect():
        assert r.closed_by in ",]"
        found.setdefault(r.file_path.rpartition("/")[2], {})[r.pos] = json.loads(r.raw)
    assert {name: [e[i] for i in range(len(e))] for name, e in found.items()} == written


@pytest.mark.parametrize("size", [5, 1 << 27])
def test_forms_that_are_no_array(spark, tmp_path, ranges, size):
    ranges(size)
    texts = {
        "empty": "", "none": " [ ] ", "object": '{"a": [1, {"b": 2}], "c": {}}', "open": '[{"a": 1}, {"b": ', "cut": '[{"a": 1}',
        "hole": "[1,,2]", "text": "nothing",
    }
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    found = {}
    for r in array_entries(spark, str(tmp_path)).collect():
        found.setdefault(r.file_path.rpartition("/")[2], []).append((r.pos, r.raw.strip(), r.closed_by))
    found = {name: sorted(rows) for name, rows in found.items()}
    assert found.pop("object")[0][2] == "not_array" and found.pop("text") == [(-1, "nothing", "not_array")]
    assert found == {
        "open": [(0, '{"a": 1}', ","), (1, '{"b":', "")],
        "cut": [(0, '{"a": 1', "")],
        "hole": [(0, "1", ","), (1, "", ","), (2, "2", "]")],
    }


@pytest.mark.parametrize("size", [40, 1 << 27])
def test_scan_index_rejects_entries_not_the_file(spark, tmp_path, ranges, size):
    ranges(size)

    def entry(i):
        return {"osVersion": f"14.{i}", "buildNumber": f"23A{i}", "releaseName": "Sonoma, {x}", "dataFile": f"releases/14/{i}.json"}

    entries = [entry(0), 5, entry(1) | {"osVersion": None}, "a}, {", entry(2), [entry(3)], entry(4) | {"note": {"a": [1, 2]}}]
    (tmp_path / "releases.json").write_text(json.dumps(entries))
    path = str(tmp_path)
    assert sorted((r.pos, r.id) for r in readers.scan_index(spark, path).collect()) == [(0, "14.0-23A0"), (4, "14.2-23A2"), (6, "14.4-23A4")]
    rejected = {r.pos: r.reason for r in readers.scan_index_rejected(spark, path).collect()}
    assert rejected == {1: "invalid_json", 2: "osVersion", 3: "invalid_json", 5: "invalid_json"}
