"""Kernels, devices and chips."""

import pytest
from pyspark.sql import functions as F

from shipledger.functions.chips import chip_sort_key
from shipledger.operators import hardware as W

KERNELS = "product string, build_number string, ord int, file string, darwin_version string, xnu_version string, arch string, chip string, devices array<string>"


@pytest.mark.parametrize("file, devices", [
    ("kernelcache.release.Mac16,1_2_3_10", ["Mac16,1", "Mac16,2", "Mac16,3", "Mac16,10"]),
    ("kernelcache.release.MacBookAir10,1_MacBookPro17,1", ["MacBookAir10,1", "MacBookPro17,1"]),
    ("kernelcache.release.VirtualMac2,1", ["VirtualMac2,1"]),
    ("kernelcache.development.Mac16,1_2", ["Mac16,1", "Mac16,2"]),
    ("kernelcache.release.mac13g", []),
    ("kernelcache.release.1_2", []),
    ("Mac14,5_code_6", ["Mac14,5", "Mac14,6"]),
])
def test_devices_from_filename(spark, file, devices):
    row = spark.range(1).select(W.devices_from_filename(F.lit(file)).alias("d")).first()
    assert row.d == devices


def kernels(spark, rows):
    return spark.createDataFrame([("macOS", "b", i, f, "24.0.0", "1", a, c, d) for i, (f, a, c, d) in enumerate(rows)], KERNELS)


def test_devices_and_chips(spark):
    ks = kernels(spark, [
        ("kernelcache.release.mac13g", "ARM64_T8101", "Unknown", []),
        ("kernelcache.development.mac13j", "ARM64_T6000", "Unknown", []),
        ("listed", "ARM64_T8132", "M4", ["Mac16,1", "Nope1,1"]),
        ("mapped", "ARM64", "Unknown", []),
        ("nothing", "ARM64_VMAPPLE", "Multiple", []),
    ])
    manifest = spark.createDataFrame([("macOS", "b", "mapped", ["Mac17,2"])], "product string, build_number string, file string, devices array<string>")
    full = W.resolve_kernel_devices(ks, manifest, W.board_devices_table(spark))
    sizes = {r.file: len(r.devices) for r in full.collect()}
    assert sizes == {"kernelcache.release.mac13g": 5, "kernelcache.development.mac13j": 6, "listed": 2, "mapped": 1, "nothing": 0}
    chips = W.resolve_device_chips(full, W.devices_table(spark))
    assert {r.device for r in chips.where("kernel_file = 'listed'").collect()} == {"Mac16,1"}
    labels = {r.file: r.chip for r in W.chip_label(full, chips).collect()}
    assert labels == {"kernelcache.release.mac13g": "M1", "kernelcache.development.mac13j": "Multiple", "listed": "M4", "mapped": "M5", "nothing": "Multiple"}
    supported = W.supported_chips(full, chips, W.chips_table(spark), W.arch_table(spark)).first().chips
    assert supported == ["M1", "M1 Max", "M1 Ultra", "M1 Pro", "M4", "M5", "Virtual Mac"]


def test_summary_order(spark):
    ks = kernels(spark, [
        ("kernelcache.development.x", "ARM64_T6041", "M4 Max", []), ("vm", "ARM64_VMAPPLE", "Virtual Mac", []),
        ("m1", "ARM64_T8103", "M1", []), ("m4", "ARM64_T6041", "M4 Max", ["Mac16,9", "Mac16,8"]),
    ])
    chips = W.resolve_device_chips(ks, W.devices_table(spark))
    rows = W.kernel_summary(ks, chips).orderBy("is_dev", F.col("generation").desc(), "tier", "ord").collect()
    assert [r.file for r in rows] == ["m4", "m1", "vm", "kernelcache.development.x"]
    assert rows[0].chips == ["M4 Pro", "M4 Max"]


def test_chip_sort_key(spark):
    labels = {"M4 Pro": (4, 1), "A18 Pro": (5, 4), "Virtual Mac": (0, 0), "T9": (0, 1), "M1": (1, 0), "M2 Ultra": (2, 3)}
    rows = spark.createDataFrame([(k,) for k in labels], "c string").select("c", chip_sort_key("c").alias("k")).collect()
    assert {r.c: tuple(r.k) for r in rows} == labels


def test_grid_keeps_first_positions(spark):
    rows = [("macOS", "b", "k", 1, 0, "d1", "M1"), ("macOS", "b", "j", 0, 1, "d2", "M1"), ("macOS", "b", "j", 0, 0, "d1", "M1")]
    df = spark.createDataFrame(rows, "product string, build_number string, kernel_file string, kernel_ord int, ord int, device string, chip string")
    got = [(r.device, tuple(r["first"])) for r in W.chip_grid(df).orderBy("chip_first", "first").collect()]
    assert got == [("d1", (0, 0)), ("d2", (0, 1))]
