import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import images as im
from gridloom.operators import metrics as me

NAN, INF = math.nan, math.inf


def one(df):
    return df.collect()[0][0]


def test_two_ways_of_cleaning(spark):
    df = spark.createDataFrame([([NAN, INF, -INF, 400.0, 245.0],)], "bt array<double>")
    assert one(df.select(im.normalize("bt"))) == [-1, -1, -1, 1, 0]
    assert one(df.select(im.eval_clean("bt"))) == [180, 310, 180, 310, 245]
    assert one(df.select(im.denormalize(im.normalize("bt")))) == [180, 180, 180, 310, 245]


def test_rotation_and_shift(spark):
    x = np.arange(16.0).reshape(4, 4)
    df = spark.createDataFrame([(x.ravel().tolist(), k, dy, dx) for k, dy, dx in [(0, 0, 0), (1, 2, -1), (2, -2, 2), (3, 1, 1), (4, 0, -2)]], "x array<double>, k int, dy int, dx int")
    for r in df.select("k", "dy", "dx", im.rot90("x", 4, "k").alias("t"), im.shift_reflect("x", 4, "dy", "dx").alias("s")).collect():
        assert np.array(r.t).reshape(4, 4).tolist() == np.rot90(x, r.k).tolist()
        padded = np.pad(x, 2, mode="reflect")
        assert np.array(r.s).reshape(4, 4).tolist() == padded[2 + r.dy : 6 + r.dy, 2 + r.dx : 6 + r.dx].tolist()


def test_four_turns_are_none(spark):
    df = spark.range(1).selectExpr("transform(sequence(0, 8), x -> cast(x as double)) as x")
    y = df
    for _ in range(4):
        y = y.select(im.rot90("x", 3, F.lit(1)).alias("x"))
    assert one(y) == one(df)


def test_policy_interpolates(spark):
    assert [tuple(r) for r in im.augment_policy(spark).collect()] == [(k, p, 2, b) for k, (p, b) in enumerate(zip(im.AUGMENT_P, im.AUGMENT_BARS))]
    assert [r.max_bars for r in im.augment_policy(spark, 3).collect()] == [1, 2, 3]
    with pytest.raises(ValueError):
        im.augment_policy(spark, 0)


@pytest.fixture(scope="module")
def pictures(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(240, 20, (6, 16, 16))
    x[5] = 250.0
    return x, spark.createDataFrame([(0, "real", i, v.ravel().tolist()) for i, v in enumerate(x)], "class int, set string, id long, bt array<double>")


def test_moments_and_quantiles(spark, pictures):
    x, df = pictures
    px = im.pixels(df)
    for r in me.moments(px, ["id"]).collect():
        v = x[r.id].ravel()
        z = v - v.mean()
        sd = v.std()
        assert (r.mean, r.std) == pytest.approx((v.mean(), sd))
        if r.id == 5:
            assert (r.skew, r.kurt) == (0.0, -3.0)
        else:
            assert (r.skew, r.kurt) == pytest.approx(((z**3).mean() / sd**3, (z**4).mean() / sd**4 - 3))
    qs = [0.0, 0.01, 0.05, 0.5, 0.95, 0.99, 1.0]
    got = {(r.id, r.q): r.value for r in me.quantiles(px, ["id"], "v", qs, cells=7).collect()}
    for i in range(6):
        assert [got[i, q] for q in qs] == pytest.approx(np.quantile(x[i], qs).tolist())


def test_quantiles_with_ties_and_nulls(spark):
    rows = [(1, v) for v in [2.0] * 50 + [3.0] * 3 + [1.0, None, NAN]] + [(2, 7.0)]
    got = {(r.g, r.q): r.value for r in me.quantiles(spark.createDataFrame(rows, "g int, v double"), ["g"], "v", [0.0, 0.5, 0.97, 1.0]).collect()}
    v = [2.0] * 50 + [3.0] * 3 + [1.0]
    assert [got[1, q] for q in (0.0, 0.5, 0.97, 1.0)] == pytest.approx(np.quantile(v, [0, 0.5, 0.97, 1]).tolist())
    assert got[2, 0.5] == 7.0


def test_profiles_and_spectra(spark, pictures):
    x, df = pictures
    n, rb, tb = 16, 6, 8
    yy, xx = np.mgrid[0:n, 0:n] - (n - 1) / 2
    r = np.hypot(yy, xx)
    bins = np.minimum((r / (r.max() + 1e-12) * rb).astype(int), rb - 1)
    theta = np.minimum(((np.arctan2(yy, xx) + np.pi) / (2 * np.pi) * tb).astype(int), tb - 1)
    for row in me.profiles(df, ["id"], n, rb, tb).collect():
        own = bins == row.rbin
        v, t = x[row.id][own], theta[own]
        means = [v[t == k].mean() for k in np.unique(t)]
        assert row.radial_mean == pytest.approx(v.mean()) and row.azimuthal_std == pytest.approx(np.std(means), abs=1e-9)
    fast = {q.id: q.log_power for q in me.psd(df, ["id"], n, 5).collect()}
    slow = {}
    for q in me.psd_relational(df, ["id"], n, 5).collect():
        slow.setdefault(q.id, {})[q.kbin] = q.log_power
    for i in range(5):
        p = np.fft.fftshift(np.abs(np.fft.fft2(x[i] - x[i].mean())) ** 2)
        b = np.minimum((r / (r.max() + 1e-12) * 5).astype(int), 4)
        want = [np.log10(p[b == k].mean() + 1e-12) for k in range(5)]
        assert fast[i] == pytest.approx(want, abs=1e-6) and [slow[i][k] for k in range(5)] == pytest.approx(want, abs=1e-6)


def test_histogram_distances(spark):
    df = spark.createDataFrame([("real", v) for v in (180.0, 310.0, 245.0, 100.0)] + [("gen", v) for v in (180.0, 180.5, 310.0)], "set string, v double")
    h = me.histogram(df, ["set"])
    got = {(r.set, r.bin): r.p for r in h.collect()}
    assert len(got) == 256 and got["real", 127] == pytest.approx(1 / 3) and sum(v for (s, _), v in got.items() if s == "gen") == pytest.approx(1)
    same = h.where("set = 'real'").selectExpr("1 as g", "bin", "p as a", "p as b")
    assert one(me.js_divergence(same, ["g"]).select("js")) == pytest.approx(0, abs=1e-9) and one(me.w1_distance(same, ["g"]).select("w1")) == 0
    pair = me.paired(h.withColumn("g", h["bin"] * 0), ["g"])
    js = one(me.js_divergence(pair, ["g"]).select("js"))
    back = one(me.js_divergence(pair.selectExpr("g", "bin", "b as a", "a as b"), ["g"]).select("js"))
    assert 0 < js < math.log(2) and js == pytest.approx(back)


def test_eye_bins_of_the_default_size():
    assert me.eye_bins(96) == (11, 20, 28) and me.eye_bins(4) == (1, 0, 3)


def test_pearson_needs_variance(spark):
    q = lambda rows: one(spark.createDataFrame(rows, "x double, y double").agg(me.pearson("x", "y")))
    assert q([(1.0, 2.0)]) is None and q([(1.0, 2.0), (1.0, 3.0)]) is None and q([(1.0, 2.0), (2.0, 1.0)]) == pytest.approx(-1)


def test_mmd_is_symmetric_and_matches(spark):
    rng = np.random.default_rng(2)
    a, b = rng.normal(size=(9, 3)), rng.normal(size=(7, 3)) + 1
    f = lambda x: spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "class int, id long, z array<double>")
    x, y = one(me.mmd2(f(a), f(b), ["class"], "id").select("mmd2")), one(me.mmd2(f(b), f(a), ["class"], "id").select("mmd2"))
    z = np.concatenate([a, b])
    d = ((z[:, None] - z[None]) ** 2).sum(-1)
    k = np.exp(-d / (2 * (np.median(d[d > 0]) + 1e-12)))
    rr, gg, rg = k[:9, :9], k[9:, 9:], k[:9, 9:]
    want = (rr.sum() - 9) / 72 + (gg.sum() - 7) / 42 - 2 * rg.mean()
    assert x == pytest.approx(want) and y == pytest.approx(want)


def test_limits(spark):
    q = lambda v: tuple(me.shared_limits(spark.createDataFrame([(x,) for x in v], "v double")).first())
    assert q([NAN]) == (0, 1) and q([0.0, 0.0]) == (-0.5, 0.5) and q([200.0]) == (198, 202) and q([1.0, INF, 3.0]) == (1, 3)


def test_curves_of_an_image_need_no_shuffle(spark):
    images = spark.range(3).selectExpr("id", "transform(sequence(0, 65535), i -> cast((i * 7 + id * 13) % 131 as double)) AS bt")
    got = me.image_curves(images, ["id"], 256)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.collect()
    assert all(len(r[c]) == 96 for r in rows for c in me.FEATURES)
    # the plain way: sectors of each ring by masks
    y, x = (np.indices((256, 256)) - 127.5).reshape(2, -1)
    ring = np.clip(np.floor(np.hypot(y, x) / (np.hypot(127.5, 127.5) + 1e-12) * 96), 0, 95)
    sector = np.clip(np.floor((np.arctan2(y, x) + np.pi) / (2 * np.pi) * 360), 0, 359)
    v = (np.arange(65536) * 7 + 13) % 131
    mine = next(r for r in rows if r.id == 1)
    for k in (0, 1, 40, 95):
        own = ring == k
        means = [v[own & (sector == t)].mean() for t in np.unique(sector[own])]
        assert mine.radial_mean[k] == pytest.approx(v[own].mean()) and mine.azimuthal_std[k] == pytest.approx(np.std(means) if len(means) > 1 else 0)
    nothing = me.image_curves(spark.sql("SELECT 1 AS id, CAST(NULL AS array<double>) AS bt"), ["id"], 8, 4, 16, 4).first()
    assert nothing.radial_mean == [0.0] * 4 and nothing.azimuthal_std == [0.0] * 4


@pytest.mark.parametrize("cells,few", [(8, 20), (128, 1000), (2, 1), (128, 100_000)])
def test_quantiles_of_heavy_tails(spark, cells, few):
    rng = np.random.default_rng(6)
    v = np.concatenate([rng.lognormal(0, 3, 3000), [1e12, -1e12], np.full(900, 2.0), rng.integers(0, 4, 500)])
    rows = [("a", float(x)) for x in v] + [("b", float(x)) for x in (1.0, 1.0, 5.0)] + [(None, 7.0), ("c", None), ("c", NAN)] + [("i", x) for x in (-INF, 1.0, 2.0, 3.0, INF)]
    qs = [0.0, 0.01, 0.37, 0.5, 0.9, 0.999, 1.0]
    got = {(r.g, r.q): r.value for r in me.quantiles(spark.createDataFrame(rows, "g string, v double").repartition(4), ["g"], "v", qs, cells, few).collect()}
    for g, x in (("a", v), ("b", [1.0, 1.0, 5.0]), (None, [7.0])):
        assert [got[g, q] for q in qs] == pytest.approx(np.quantile(x, qs).tolist(), rel=1e-12)
    assert {g for g, _ in got} == {"a", "b", None, "i"} and got["i", 0.0] == -INF and got["i", 1.0] == INF and got["i", 0.5] == 2.0


def test_cells_follow_the_shares_and_not_the_range(spark):
    values = spark.createDataFrame([(1, float(x)) for x in [1e12, *np.random.default_rng(1).lognormal(0, 2, 20_000)]], "g int, v double")
    sketch = values.groupBy("g").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", [i / 64 for i in range(1, 64)], 6400))).alias("xs"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"))
    counts = me._places(values, sketch, ["g"]).collect()
    assert sum(r.c for r in counts) == 20_001 and max(r.c for r in counts) < 2 * 20_001 / 64
