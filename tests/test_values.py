"""Casts, derived values and keys."""

import math

import pytest
from pyspark.sql import functions as F

from partgraph.functions import casts, derive
from partgraph.operators.project import upper_headers


def values(spark, rows, kind, expression):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [r[0] for r in df.select(expression(F.col("v"))).collect()]


def test_to_int64(spark):
    given = [" 12 ", "12.0", "12.5", "x", "", None, "1e3", "1d", "-7", "99999999999999999999"]
    assert values(spark, given, "string", casts.to_int64) == [12, None, None, None, None, None, None, None, -7, None]
    assert values(spark, [12.9, -12.9, math.nan, 1e30], "double", casts.to_int64) == [12, -12, None, None]


def test_to_float2(spark):
    given = [" 12 ", "12.0", "12.5", "x", "", None, "1e3", "1d", "2.5F", "0x1p3"]
    expected = [12.0, 12.0, 12.5, None, None, None, 1000.0, None, None, None]
    assert values(spark, given, "string", casts.to_float2) == expected
    numbers = [0.125, 1.015, 2.675, 1e30, -0.125, 1e308]
    assert values(spark, numbers, "double", casts.to_float2) == [0.12, 1.01, 2.68, 1e30, -0.12, 1e308]
    assert math.isnan(values(spark, [math.nan], "double", casts.to_float2)[0])
    assert values(spark, ["inf", "-Infinity"], "string", casts.to_float2) == [math.inf, -math.inf]


def test_to_string(spark):
    assert values(spark, [12.0, None], "double", casts.to_string) == ["12.0", None]
    assert values(spark, [True], "boolean", casts.to_string) == ["true"]


@pytest.mark.parametrize(
    ("kind", "length", "number", "volume", "area"),
    [
        ("non-returnable", 1340, "A 1340-560-440", 0.33, 0.75),
        ("returnable", 1340, "B 1340-560-440", 0.33, 0.75),
        (None, 1340, "B 1340-560-440", 0.33, 0.75),
        ("returnable", None, None, None, None),
    ],
)
def test_packaging(spark, kind, length, number, volume, area):
    df = spark.createDataFrame([(kind, length, 560, 440)], "t string, l bigint, w bigint, h bigint")
    t, l, w, h = (F.col(c) for c in "tlwh")
    row = df.select(derive.packaging_number(t, l, w, h), derive.volume_m3(l, w, h), derive.area_m2(l, w)).first()
    assert tuple(row) == (number, volume, area)


def test_keys_tell_null_and_shifted_parts_apart(spark):
    rows = [("ab", "c"), ("a", "bc"), (None, "abc"), ("abc", None), ("-", "abc"), ("", "abc"), (None, None)]
    df = spark.createDataFrame(rows, "a string, b string")
    keys = [r[0] for r in df.select(derive.surrogate_key("SUP_", [F.col("a"), F.col("b")])).collect()]
    assert keys[-1] is None
    assert len(set(keys)) == len(rows)
    assert all(len(k) == 12 and k.startswith("SUP_") and k[4:].isalnum() for k in keys[:-1])


def test_keys_do_not_depend_on_partitioning(spark):
    df = spark.range(1000).select(F.col("id").cast("string").alias("PART_NUMBER"))
    one = {tuple(r) for r in df.coalesce(1).select("*", derive.key_for("PART_ID")).collect()}
    many = {tuple(r) for r in df.repartition(16).select("*", derive.key_for("PART_ID")).collect()}
    assert one == many


def test_key_width():
    assert derive.key_width(100) == derive.KEY_WIDTH
    assert derive.key_width(20_000_000_000) > 12
    assert derive.key_width(10**12) > derive.key_width(10**9)


def test_change_label(spark):
    df = spark.createDataFrame([("P1", "P2")], "a string, b string")
    assert df.select(derive.change_label(F.col("a"), F.col("b"))).first()[0] == "Change: P1 → P2"


def test_upper_headers(spark):
    assert upper_headers(spark.createDataFrame([(1, 2)], ["PART_per_BOX", " x "])).columns == ["PART_PER_BOX", "X"]
