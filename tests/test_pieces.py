"""Contents searched in pieces, as values and as files."""

import pathlib
import random
import re

import pytest
from pyspark.sql import functions as F

from shipledger.operators import extract as X
from shipledger.operators import hardware as W
from shipledger.sources import pieces as P
from shipledger.sources.readers import scan_artifacts

SIZES = [7, 64, X.PIECE_BYTES]


def noise(rng, size):
    return bytes(rng.choice(b"ab~ 1.9\x00\x1f\x7f\xe9\n") if rng.random() < 0.5 else 120 for _ in range(size))


def contents():
    rng = random.Random(3)
    marks = [b"Apache/2.4.62 (Unix)", b"\x002.39.5 (Apple Git-154)\x00", b"20913 \x00 21209", b"OpenSSH_9.8p1, LibreSSL 3.3.6"]
    found = [
        noise(rng, rng.randint(0, 90)) + rng.choice([b"", b"\x00"]) + (marks[i % 4] if i % 7 else b"none") + b"\x00" + noise(rng, rng.randint(0, 90))
        for i in range(60)
    ]
    return found + [b"", b"x" * 40, b"\x00" * 16, b"Apache/2.4.1 " * 3 + b"\x00Apache/2.4.9", b"20913\x00" + b"y" * 50 + b" 21209"]


PATHS = ["usr/sbin/httpd", "usr/bin/git", "/usr/lib/libxml2.2.dylib", "usr/bin/ssh"]


def artifacts(spark):
    rows = [("macOS", str(i), PATHS[i % 4], bytearray(c)) for i, c in enumerate(contents())]
    return spark.createDataFrame(rows, "product string, build_number string, path string, content binary")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out = tmp_path_factory.mktemp("files")
    for i, c in enumerate(contents()):
        (out / f"{i}.bin").write_bytes(c)
    return out


@pytest.mark.parametrize("size", SIZES)
def test_components_are_the_same_for_any_piece(spark, folder, size):
    expected = sorted(map(tuple, X.extract_components(artifacts(spark)).collect()))
    assert len(expected) > 20
    assert sorted(map(tuple, X.extract_components(artifacts(spark), piece_bytes=size).collect())) == expected
    number = F.regexp_extract("path", r"(\d+)\.bin$", 1)
    files = P.scan_artifact_pieces(spark, str(folder), piece_bytes=size).select(
        F.lit("macOS").alias("product"), number.alias("build_number"), "piece", "content",
        F.element_at(F.array(*map(F.lit, PATHS)), (number.cast("int") % 4 + 1)).alias("path"),
    )
    assert sorted(map(tuple, X.extract_components(files).collect())) == expected


@pytest.mark.parametrize("size", SIZES)
def test_runs_of_file_pieces(spark, folder, size):
    found = {}
    files = P.scan_artifact_pieces(spark, str(folder), exts=["BIN"], piece_bytes=size)
    for r in X.printable_runs(files).orderBy("path", "piece", "run_ord").collect():
        found.setdefault(int(r.path.rpartition("/")[2][:-4]), []).append(r.run.encode())
    assert found == {i: runs for i, c in enumerate(contents()) if (runs := re.findall(rb"[\x20-\x7e]{4,}", c))}
    sizes = {r.path: r.length for r in scan_artifacts(spark, str(folder)).select("path", "length").collect()}
    counts = files.groupBy("path").agg(F.count("*").alias("n")).collect()
    assert {r.path: r.n for r in counts} == {path: max(1, -(-n // size)) for path, n in sizes.items()}


KERNELS = {
    "front": b"Darwin Kernel Version 24.1.0: root:xnu-11215.41.3~2/RELEASE_ARM64_T6000\x00" + b"\xff" * 500,
    "back": b"\xff" * 300 + b"Darwin Kernel Version 23.1.0\x00xnu-10002.1.3.4~1\x00RELEASE_ARM64_VMAPPLE",
    "part": b"\x00Darwin Kernel Version 22.5.0\x00Darwin Kernel Version 21.1.1",
    "none": b"xnu-1.2.3 RELEASE_ARM64_T8103",
    "empty": b"",
}


@pytest.mark.parametrize("size", SIZES)
def test_kernels_are_the_same_for_any_piece(spark, tmp_path, size):
    rows = [(name, f"kernelcache.release.{name}", bytearray(c)) for name, c in KERNELS.items()]
    df = spark.createDataFrame(rows, "id string, file string, content binary")
    archs = W.arch_table(spark)
    expected = sorted(map(str, X.kernel_fields(df, archs, keys=["id"]).collect()))
    assert len(expected) == 3
    assert sorted(map(str, X.kernel_fields(df, archs, keys=["id"], piece_bytes=size).collect())) == expected
    for name, c in KERNELS.items():
        (tmp_path / f"kernelcache.release.{name}").write_bytes(c)
    name = F.substring_index("path", "/", -1)
    listed = scan_artifacts(spark, str(tmp_path)).select("path", "length", name.alias("file"), F.substring_index(name, ".", -1).alias("id"))
    heads = P.kernel_heads(listed, piece_bytes=size)
    assert sorted(map(str, X.kernel_fields(heads, archs, keys=["id"]).collect())) == expected
    cut = P.scan_artifact_pieces(spark, str(tmp_path), piece_bytes=size).select(
        "piece", "content", name.alias("file"), F.substring_index(name, ".", -1).alias("id")
    )
    assert sorted(map(str, X.kernel_fields(cut, archs, keys=["id"]).collect())) == expected
    read = {r.id: r.pieces_read for r in heads.select("id", "pieces_read").collect()}
    assert read["front"] <= -(-75 // size) and read["part"] == max(1, -(-len(KERNELS["part"]) // size))


@pytest.mark.parametrize("size", [8, X.PIECE_BYTES])
def test_python_runtime_is_the_same_for_any_piece(spark, size):
    rows = [
        ("a", "3.9", "L/3.9/libpython3.9.dylib", b"x" * 30 + b"\x003.9.6\x003.9.7"),
        ("a", "3.10", "L/3.10/libpython3.10.dylib", b"3.10.1 is no run by itself"),
        ("b", "3.11", "L/3.11/libpython3.11.dylib", b"\x00\x00\x00\x00\x003.11.4\x00"),
    ]
    df = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "id string, version_dir string, path string, content binary")
    found = X.python_runtime_pick(df, keys=["id"], piece_bytes=size).collect()
    assert sorted((r.id, r.version) for r in found) == [("a", "3.9.6"), ("b", "3.11.4")]
    cut = df.select("id", "version_dir", "path", F.lit(1).alias("piece"), "content").union(df.select("id", "version_dir", "path", F.lit(0), F.lit(b"3.1\x00")))
    assert sorted((r.id, r.version) for r in X.python_runtime_pick(cut, keys=["id"]).collect()) == [("a", "3.9.6"), ("b", "3.11.4")]


def test_every_row_becomes_a_file_without_a_folder_of_its_own(spark, tmp_path):
    contents = [b"", b"\x00\xff\n", *[b"%d" % i for i in range(600)]]
    rows = spark.createDataFrame([(i, f"k-{i}", bytearray(c)) for i, c in enumerate(contents)], "id long, name string, content binary")
    files = P.write_files(rows, str(tmp_path / "out")).collect()
    assert sorted((f.id, f.length) for f in files) == [(i, len(c)) for i, c in enumerate(contents)]
    assert all(pathlib.Path(f.path).read_bytes() == contents[f.id] for f in files)
    below = list((tmp_path / "out").rglob("*"))
    assert sum(p.is_file() for p in below) == len(contents) and sum(p.is_dir() for p in below) <= P.FOLDERS


def test_few_bytes_of_many_kernels_are_read_by_many_tasks(spark):
    files = spark.range(1000).select(F.concat(F.lit("/k/"), "id").alias("path"), F.lit(9).cast("long").alias("length"))
    for read in (P.kernel_heads(files), P._with_contents(files, 8)):
        exchange = next(line for line in read._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in line)
        assert exchange.rstrip().endswith(", 4")
