"""Runs, rules and normalizers."""

import random
import re

import pytest
from pyspark.sql import functions as F

from shipledger.functions import normalizers as N
from shipledger.operators import extract as X
from shipledger.operators import hardware as W
from shipledger.plans import extraction

ARTIFACT = "product string, build_number string, path string, content binary"


def runs(spark, content, **options):
    df = spark.createDataFrame([(1, bytearray(content))], "id int, content binary")
    return [r.run for r in X.printable_runs(df, **options).orderBy("run_ord").collect()]


@pytest.mark.parametrize("content, expected", [
    (b"\x00abcd\x00efg\x00hijkl", ["abcd", "hijkl"]),
    (b"ab\x1fcdef\x20gh\x7eij\x7fklmn", ["cdef gh~ij", "klmn"]),
    (b"", []),
    (b"abc", []),
    ("naïve text é done".encode(), ["ve text ", " done"]),
    (b"\x80\xffversion\xfe", ["version"]),
])
def test_runs(spark, content, expected):
    assert runs(spark, content) == expected


def test_long_run_keeps_its_start(spark):
    assert runs(spark, b"x" * 100 + b"\x00" + b"yyyy", max_len=10) == ["x" * 10, "yyyy"]
    assert runs(spark, b"ab\x00abc", min_len=2) == ["ab", "abc"]


def test_long_runs_are_whole(spark):
    long = b"v" * (3 * 1024 * 1024) + b" version 9"
    df = spark.createDataFrame([(1, bytearray(b"\x00" + long + b"\x00tail"))], "id int, content binary")
    for size in (1 << 20, X.PIECE_BYTES):
        rows = X.printable_runs(df, piece_bytes=size).orderBy("run_ord").collect()
        assert [r.run.encode() for r in rows] == [long, b"tail"]


def test_pieces_give_the_same_runs(spark):
    rng = random.Random(11)
    contents = [bytes(rng.choice(b"ab~ \x00\x1f\x7f\xe9\n") if rng.random() < 0.4 else 120 for _ in range(rng.randint(0, 60))) for _ in range(150)]
    contents += [b"x" * 40, b"x" * 16, b"\x00" * 16, b"", b"abcd\n", b"abcdefgh\nabcdefgh"]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(contents)], "id int, content binary")
    for size, cap in ((1, None), (5, 100), (8, 9), (8, None), (64, 6)):
        got = {}
        for r in X.printable_runs(df, max_len=cap, piece_bytes=size).orderBy("id", "run_ord").collect():
            got.setdefault(r.id, []).append(r.run)
        for i, content in enumerate(contents):
            expected = [m.decode()[:cap] for m in re.findall(rb"[\x20-\x7e]{4,}", content)]
            assert got.get(i, []) == expected, (size, cap, content)


def test_look_behind_and_highest_integer(spark):
    df = spark.createDataFrame([(1, bytearray(b"2147483647 20913 x 21209 9"))], "id int, content binary")
    pattern = next(r.pattern for r in X.binary_rules() if r.name == "libxml2")
    matches = X.find_all(X.printable_runs(df), pattern)
    assert sorted(r.match for r in matches.collect()) == ["20913", "21209"]
    assert X.integer_version_decode(matches, ["id"]).first().version == "2.12.9"


# Texts in binaries and the versions they stand for.
FOUND = [
    ("usr/sbin/httpd", b"Server: Apache/2.4.62 (Unix)", "httpd", "2.4.62"),
    ("usr/bin/ssh", b"OpenSSH_9.8p1, LibreSSL 3.3.6", "OpenSSH", "9.8p1"),
    ("usr/bin/ruby", b"ruby 2.6.10\x002.6.10p210", "Ruby", "2.6.10"),
    ("bin/zsh", b"zsh-5.9-0-g73d3173", "zsh", "5.9"),
    ("usr/bin/vim", b"VIM - Vi IMproved 9.1", "vim", "9.1"),
    ("/usr/lib/libncurses.5.4.dylib", b"ncurses 6.0.20150808", "libncurses", "6.0.20150808"),
    ("/usr/lib/libxml2.2.dylib", b"2147483647 and 20913", "libxml2", "2.9.13"),
    ("usr/bin/swift-frontend", b"swiftlang-5.9.0.128.108", "Swift", "5.9"),
    ("usr/bin/ld", b"PROJECT:ld64-711", "ld", "711"),
    ("usr/bin/git", b"2.39.5 (Apple Git-154)", "Git", "2.39.5"),
    ("Contents/SharedFrameworks/LLDB.framework/LLDB", b"lldb-2100.0.16.4", "lldb", "2100.0.16.4"),
]


def test_rules(spark):
    rows = [("macOS", "b", path, bytearray(b"\x00" + content + b"\x01")) for path, content, _, _ in FOUND]
    rows.append(("macOS", "b", "usr/bin/curl", bytearray(b"no version here")))
    out = X.extract_components(spark.createDataFrame(rows, ARTIFACT))
    got = {r.name: (r.version, r.path) for r in out.collect()}
    assert got == {name: (version, "/" + path.lstrip("/")) for path, _, name, version in FOUND}


def test_fallback_only_without_primary(spark):
    rows = [
        ("Xcode", "a", "usr/bin/swift", bytearray(b"Swift version 5.5.2")),
        ("Xcode", "b", "usr/bin/swift", bytearray(b"Swift version 5.5.2")),
        ("Xcode", "b", "usr/bin/swift-frontend", bytearray(b"swiftlang-6.3.1.123.5")),
        ("Xcode", "c", "usr/bin/swift", bytearray(b"Swift version 5.1")),
        ("Xcode", "c", "usr/bin/swift-frontend", bytearray(b"nothing")),
    ]
    out = X.extract_components(spark.createDataFrame(rows, ARTIFACT))
    got = {(r.build_number, r.version, r.path) for r in out.collect()}
    assert got == {("a", "5.5.2", "/usr/bin/swift"), ("b", "6.3.1", "/usr/bin/swift-frontend")}


def test_texts(spark):
    rows = [
        ("Xcode", "b", "include/expat.h", "#define XML_MAJOR_VERSION 2\n# define XML_MINOR_VERSION 6\n#define XML_MICRO_VERSION 3\n"),
        ("Xcode", "b", "include/curses.h", "#define NCURSES_VERSION_MAJOR 6\n#define NCURSES_VERSION_MINOR 0\n"),
        ("Xcode", "b", "include/zlib.h", '#define ZLIB_VERSION "1.2.12"\n#define ZLIB_VERNUM 0x12c0'),
        ("Xcode", "b", "include/libexslt/exsltconfig.h", "#define LIBEXSLT_VERSION 820"),
        ("Xcode", "b", "lib/libbz2.1.0.tbd", "tbd-version: 4\ncurrent-version: 1.0.8\n"),
        ("Xcode", "b", "include/ffi/ffi.h", "libffi 3.4-rc1 - Copyright"),
        ("Xcode", "b", "other.h", '#define ZLIB_VERSION "9"'),
    ]
    df = spark.createDataFrame(rows, "product string, build_number string, path string, value string")
    got = {r.name: r.version for r in X.text_components(df).collect()}
    assert got == {"expat": "2.6.3", "zlib": "1.2.12", "libexslt": "0.8.20", "bzip2": "1.0.8", "libffi": "3.4-rc1"}


def test_kernel_fields(spark):
    rows = [
        ("macOS", "b", "kernelcache.release.Mac16,1_2", bytearray(b"\x00xnu-11417.1.2~3/RELEASE_ARM64_T8132\x00Darwin Kernel Version 24.1.0: x\x00")),
        ("macOS", "b", "no-darwin", bytearray(b"xnu-1.2.3")),
        ("macOS", "b", "plain", bytearray(b"Darwin Kernel Version 20.0.0")),
        ("macOS", "b", "strange", bytearray(b"Darwin Kernel Version 20.0.0 RELEASE_ARM64_T9")),
    ]
    df = spark.createDataFrame(rows, "product string, build_number string, file string, content binary")
    got = {r.file: (r.darwin_version, r.xnu_version, r.arch, r.chip, r.devices) for r in X.kernel_fields(df, W.arch_table(spark)).collect()}
    assert got == {
        "kernelcache.release.Mac16,1_2": ("24.1.0", "11417.1.2", "ARM64_T8132", "M4", ["Mac16,1", "Mac16,2"]),
        "plain": ("20.0.0", None, "ARM64", "Unknown", []),
        "strange": ("20.0.0", None, "ARM64_T9", "T9", []),
    }


def test_versioned_path(spark):
    wanted = spark.createDataFrame([("/usr/lib/libssl.35.dylib",), ("/usr/lib/libbz2.1.0.dylib",), ("/usr/lib/none.1.dylib",), ("/usr/lib/nodot",)], "wanted string")
    names = ["/usr/lib/libssl.48.tbd", "/usr/lib/libssl.46.dylib", "/usr/lib/libssl.40.dylib", "/usr/lib/libbz2.1.0.dylib", "/usr/lib/libsslx.1.dylib"]
    paths = spark.createDataFrame([(p, i) for i, p in enumerate(names)], "path string, ord int")
    got = {r.wanted: r.resolved for r in X.resolve_versioned_path(wanted, paths).collect()}
    assert got == {
        "/usr/lib/libssl.35.dylib": "/usr/lib/libssl.46.dylib", "/usr/lib/libbz2.1.0.dylib": "/usr/lib/libbz2.1.0.dylib",
        "/usr/lib/none.1.dylib": None, "/usr/lib/nodot": None,
    }


def test_normalizers_leave_other_texts(spark):
    row = spark.range(1).select(
        N.quoted_define(F.lit("no quotes")).alias("q"), N.integer_define(F.lit("A x")).alias("i"),
        N.strip_vendor_suffix(F.lit("2.1")).alias("v"), N.truncate_version(F.lit("swiftlang-6.1"), ["swiftlang-"]).alias("t"),
        N.truncate_version(F.lit("swiftlang-6.1.2.3"), ["swiftlang-"]).alias("u"),
    ).first()
    assert tuple(row) == ("no quotes", "A x", "2.1", "6.1", "6.1.2")


def test_assemble(spark):
    schema = (
        "product string, os_version string, build_number string, release_name string, release_date date, url string, source_file string, "
        "is_beta boolean, beta_number int, beta_revision int, is_rc boolean, rc_number int, is_device_specific boolean, minimum_os_version string"
    )
    rows = [
        ("macOS", "15.1", "24B5070a", None, None, "https://x.apple.com/a/U.ipsw", "s", None, 3, None, False, None, True, None),
        ("macOS", "99.0", "1A2b", None, None, None, "s.ipsw", None, 3, None, True, 1, False, None),
        ("Xcode", "16.0", "16A242d", None, None, "https://x.apple.com/services-account/download?path=/D/Xcode_16.xip", "s", None, None, None, False, None, True, "14.5"),
    ]
    got = [(r.release_name, r.file, r.is_beta, r.beta_number, r.is_device_specific) for r in X.assemble_release(spark.createDataFrame(rows, schema)).collect()]
    assert got == [("Sequoia", "U.ipsw", True, 3, True), ("macOS 99", "s.ipsw", False, None, False), ("Xcode 16.0", "Xcode_16.xip", False, None, False)]


def test_kernel_fields_of_pages_named_like_a_chip(spark, tmp_path):
    rows = [(6001, "x"), (6000, "x"), (8101, "x"), (7, "x")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    found = extraction.kernel_fields(spark, str(tmp_path)).select("page_id", "arch", "chip").collect()
    assert sorted(map(tuple, found)) == [(6000, "ARM64_T6000", "M1 Pro"), (6001, "ARM64_T6001", "T6001"), (8101, "ARM64_T8101", "T8101")]
