import math

import pytest
from pyspark.sql import functions as F

from gridloom.functions import scalar as sc


def values(spark, rows, schema, **exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*[e.alias(n) for n, e in exprs.items()]).collect()]


def test_wind_classes_have_gaps_and_no_nan(spark):
    winds = [None, math.nan, 34.9, 35.0, 63.0, 63.5, 64.0, 82.5, 95.5, 112.5, 136.0, 136.5, 200.0, math.inf]
    got = [r[0] for r in values(spark, [(w,) for w in winds], "w double", c=sc.ss_category("w"))]
    assert got == [None, None, None, 0, 0, None, 1, None, None, None, 4, 5, 5, 5]


def test_midpoints(spark):
    got = values(spark, [(i,) for i in range(-1, 9)], "c int", a=sc.midpoint("c"), b=sc.midpoint_general("c"))
    assert [g[0] for g in got] == [145, 49, 73, 89, 104, 124.5, 145, 145, 145, 145]
    assert [g[1] for g in got] == [49, 49, 73, 89, 104, 124.5, 145, 0, 145, 145]


def test_storm_bins(spark):
    got = values(spark, [(12, -9.9, 4), (3, 10.0, 5), (7, -29.9, 30), (10, math.nan, 31), (5, None, 13)], "m int, l double, n int", s=sc.season("m"), b=sc.lat_bin("l"), d=sc.dur_bin("n"))
    assert got == [("DJF", "lat0_10", "n1_4"), ("MAM", "lat10_20", "n5_12"), ("JJA", "lat20_30", "n13_30"), ("SON", "lat30p", "n31p"), ("MAM", "lat30p", "n13_30")]


def test_index_prefix_and_relative_path(spark):
    got = values(spark, [("a/b/12-x.nc",), ("x-1.nc",), ("7.nc",)], "p string", i=sc.index_prefix("p"))
    assert [g[0] for g in got] == [12, None, None]
    got = values(spark, [("file:///data/set/a/1.nc",), ("/data/set/2.nc",), ("/other/3.nc",)], "p string", r=sc.relative_path("p", "file:///data/set"))
    assert [g[0] for g in got] == ["a/1.nc", "2.nc", "/other/3.nc"]


def test_condition_features(spark):
    got = values(spark, [(0.0, 6), (10.0, -3), (35.0, 0), (102.5, 3), (500.0, 9)], "w double, l int", c=sc.wind_clip("w"), s=sc.wind_scaled("w"), k=sc.label_clip("l"))
    assert got == [(0.0, -2.0, 6), (35.0, -1.0, 0), (35.0, -1.0, 0), (102.5, 0.0, 3), (170.0, 1.0, 5)]


@pytest.mark.parametrize("dim", [1, 2, 8, 9])
def test_time_embedding(spark, dim):
    got = values(spark, [(17,)], "t int", e=sc.time_embedding("t", dim))[0][0]
    half = dim // 2
    f = [math.exp(-math.log(10000) * i / max(half - 1, 1)) for i in range(half)]
    want = [math.sin(17 * x) for x in f] + [math.cos(17 * x) for x in f] + [0.0] * (dim % 2)
    assert got == pytest.approx(want)


def test_wind_targets(spark):
    m = F.create_map(F.lit("0"), F.lit("50"), F.lit("1"), F.lit("x"))
    assert values(spark, [(0,), (1,), (2,)], "c int", t=sc.wind_target(m, "c")) == [(50.0,), (73.0,), (89.0,)]


def test_finite(spark):
    got = values(spark, [(1.0,), (None,), (math.nan,), (-math.inf,)], "x double", f=sc.is_finite("x"))
    assert [g[0] for g in got] == [True, False, False, False]
