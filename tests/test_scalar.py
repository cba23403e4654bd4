import pytest
from pyspark.sql import functions as F

from orrery.functions import scalar


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("key", "want"), [(1, 2086509542), (65535, 2095915235), (123456789, 2087454537)])
def test_djb2(spark, key, want):
    assert one(spark, scalar.djb2(F.lit(key))) == want


def test_radix_and_modulo(spark):
    assert one(spark, scalar.radix_hash(F.lit(-7), 16256, 7)) == 127
    assert one(spark, scalar.sim_hash(F.lit(-1), 1000)) == 4294967295 % 1000


@pytest.mark.parametrize(("v", "want"), [(1, 1), (2, 2), (3, 4), (4, 4), (5, 8), (16, 16), (17, 32), (1000, 1024), (65537, 131072), (2**31, 2**31)])
def test_next_pow2(spark, v, want):
    assert one(spark, scalar.next_pow2(F.lit(v))) == want


@pytest.mark.parametrize(("n", "want"), [(1, 1024), (1024, 1024), (1025, 2048), (4096, 4096)])
def test_align(spark, n, want):
    assert one(spark, scalar.align(F.lit(n), 32, 32 * 1024)) == want


@pytest.mark.parametrize(("mask", "num", "packed"), [(0, 0, 0), (3, 2, 8), (7, 3, 136), (255, 8, 16434824)])
def test_decode_mask(spark, mask, num, packed):
    assert one(spark, scalar.mask_count(F.lit(mask))) == num
    assert one(spark, scalar.decode_mask(F.lit(mask))) == packed


def test_fixed_point(spark):
    assert one(spark, scalar.to_fixed(F.lit(0.125), 23)) == 1048576
    assert one(spark, scalar.to_fixed(F.lit(-0.3), 2)) == -1  # toward zero
    assert one(spark, scalar.from_fixed(F.lit(1048576), 23)) == 0.125
