import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import config as cf
from gridloom.operators import diffusion as di
from gridloom.operators import history as hi
from gridloom.operators import layers as la
from gridloom.streaming.sampler import sample_stream, take_batches


def test_schedules(spark):
    s = di.schedule(di.betas(spark)).orderBy("t").toPandas()
    beta = np.linspace(1e-4, 2e-2, 1000)
    abar = np.cumprod(1 - beta)
    before = np.concatenate([[1], abar[:-1]])
    for name, want in (("beta", beta), ("abar", abar), ("abar_prev", before), ("post_var", beta * (1 - before) / (1 - abar))):
        assert np.allclose(s[name], want, atol=1e-14)
    c = di.betas(spark, "cosine").orderBy("t").toPandas().beta
    f = np.cos((np.arange(1001) / 1000 + 0.008) / 1.008 * np.pi / 2) ** 2
    assert np.allclose(c, np.clip(1 - f[1:] / f[:-1], 1e-8, 0.999))
    for bad in (lambda: di.betas(spark, "other"), lambda: di.betas(spark, steps=0), lambda: di.prediction_type("other")):
        with pytest.raises(ValueError):
            bad()


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(1)
    data = [(i, t, rng.normal(size=9).tolist(), rng.normal(size=9).tolist(), rng.normal(size=9).tolist()) for i, t in enumerate([0, 1, 500, 999])]
    return di.at_step(spark.createDataFrame(data, "id int, t int, x0 array<double>, eps array<double>, noise array<double>"), di.schedule(di.betas(spark)))


def test_forms_invert_one_another(rows):
    r = rows.withColumns({"xt": di.q_sample(), "v": di.v_target()}).select("x0", "eps", di.x0_from_v("xt", "v").alias("a"), di.eps_from_v("xt", "v").alias("b"), di.target("v_mse").alias("c"), "v", di.target("eps").alias("e"))
    for x in r.collect():
        assert x.a == pytest.approx(x.x0) and x.b == pytest.approx(x.eps) and x.c == x.v and x.e == x.eps


def test_threshold_and_guidance(spark):
    x = np.random.default_rng(3).normal(size=200) * 3
    df = spark.createDataFrame([(x.tolist(), (x * 2).tolist())], "x array<double>, u array<double>")
    s = np.sort(np.abs(x))[round(0.9 * 199)]
    assert df.select(di.dynamic_threshold("x", 0.9)).first()[0] == pytest.approx((np.clip(x, -s, s) / (s + 1e-8)).tolist())
    small = spark.createDataFrame([([0.5, -0.2],)], "x array<double>")
    assert small.select(di.dynamic_threshold("x")).first()[0] == pytest.approx([0.5, -0.2])
    for g, want in ((2.0, x * 2 + 2 * (x - x * 2)), (0.0, x), (None, x), (1.0, x)):
        assert df.select(di.guided("x", "u", g)).first()[0] == pytest.approx(want.tolist())


@pytest.mark.parametrize("kind", ["eps", "v"])
def test_reverse_step(rows, kind):
    got = di.reverse_step(rows.withColumns({"xt": F.col("x0"), "pred": F.col("eps")}), kind, 0.9)
    for r in got.collect():
        x, p, z = (np.array(v) for v in (r.xt, r.pred, r.noise))
        a, b = math.sqrt(r.abar), math.sqrt(1 - r.abar)
        x0 = (x - b * p) / (a + 1e-8) if kind == "eps" else a * x - b * p
        s = max(np.sort(np.abs(x0))[7], 1)
        x0 = np.clip(x0, -s, s) / (s + 1e-8)
        e = (x - a * x0) / (b + 1e-8)
        want = np.clip(x0, -1, 1) if r.t == 0 else (x - r.beta / (b + 1e-8) * e) / math.sqrt(r.alpha) + math.sqrt(r.post_var) * z
        assert r.x_prev == pytest.approx(want.tolist())


def test_weights_and_conditions(spark, rows):
    assert rows.select(di.min_snr_weight("v", None)).first()[0] == 1
    for r in rows.select("abar", di.min_snr_weight("v", 2.5).alias("v"), di.min_snr_weight("eps", 2.5).alias("e")).collect():
        snr = r.abar / max(1 - r.abar, 1e-8)
        assert (r.v, r.e) == pytest.approx((min(snr, 2.5) / (snr + 1), min(snr, 2.5) / max(snr, 1e-8)))
    got = di.prepare_condition(spark.createDataFrame([(0, None), (6, None), (2, 91.0)], "label int, wind_kt double")).collect()
    assert [r.wind_kt for r in got] == [49, 0, 91]
    assert di.prepare_condition(spark.createDataFrame([(3,)], "label int")).first().wind_kt == 104


def test_sampling_repeats(spark):
    asked = spark.createDataFrame([(i, i % 6) for i in range(8)], "id long, label int")
    run = lambda d: {r.id: r.x for r in di.sample_loop(d, lambda x, t, y, w: -x * 0.5 + y[:, None] * 0.01, 16, 15).collect()}
    a, b = run(asked), run(asked.repartition(3))
    assert a == b and all(len(v) == 16 and max(map(abs, v)) <= 1 for v in a.values())


@pytest.mark.parametrize(("name", "kind"), [("eps", "eps"), ("eps_mse", "eps"), ("epsilon", "eps"), ("epsilon_mse", "eps"), ("v", "v"), ("V_MSE ", "v"), ("vpred", "v"), ("v_pred", "v"), ("v_prediction", "v"), ("noise", None), ("mse", None), ("", None)])
def test_loss_types(name, kind):
    if kind:
        assert di.prediction_type(name) == kind
    else:
        with pytest.raises(ValueError):
            di.prediction_type(name)


@pytest.mark.parametrize(("schedule", "kind", "guidance"), [("linear", "v", 0.0), ("cosine", "v", 1.5), ("cosine", "eps", 0.0)])
def test_sample_loop_against_single_steps(spark, schedule, kind, guidance):
    """The loop, and the same steps one by one as DataFrame operations."""
    steps, size = 6, 9
    ask = lambda x, labels, winds: x * 0.3 + labels[:, None] * 0.01 - winds[:, None] * 0.001
    requests = spark.createDataFrame([(1, 2, None), (5, None, None), (9, 4, 77.0)], "id long, label int, wind_kt double")
    got = di.sample_loop(requests, lambda x, t, y, w: ask(x, y, w), size, steps, kind, 0.9, 3, schedule, guidance).orderBy("id").collect()
    assert [(r.id, r.label, r.wind_kt) for r in got] == [(1, 2, 89.0), (5, 6, 0.0), (9, 4, 77.0)]
    labels, winds = np.array([2, 6, 4]), np.array([89.0, 0.0, 77.0])
    draw = di.seeded_noise(3, np.array([1, 5, 9]), size)
    table = di.schedule(di.betas(spark, schedule, steps))
    x = draw()
    for t in range(steps - 1, -1, -1):
        c, u = ask(x, labels, winds), ask(x, np.full(3, 6), np.zeros(3))
        pred = u + guidance * (c - u) if guidance else c
        noise = draw() if t else np.zeros((3, size))
        rows = spark.createDataFrame([(i, t, x[i].tolist(), pred[i].tolist(), noise[i].tolist()) for i in range(3)], "i int, t int, x array<double>, p array<double>, z array<double>")
        stepped = di.reverse_step(di.at_step(rows, table), kind, 0.9, "x", "p", "z", "y").orderBy("i").collect()
        x = np.array([r.y for r in stepped])
    assert np.allclose([r.x for r in got], x, atol=1e-8)


def test_histories(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([5.0, 4.0, None, 3.99, 3.98, 3.97, 1.0])], "g string, k long, v double")
    r = hi.early_stop(df, "g", "k", "v", 3, 0.5).first()
    assert (r.best_epoch, r.best_metric, r.stopped_epoch) == (1, 4.0, 5)
    r = hi.early_stop(df, "g", "k", "v", 9, 0.5).first()
    assert (r.best_epoch, r.best_metric, r.stopped_epoch) == (6, 1.0, None)
    e = {r.k: r.ema for r in hi.ema(df.where("v is not null"), "g", "k", "v", 0.5).collect()}
    assert (e[0], e[1], e[3]) == (5.0, 4.5, 4.245)
    x = spark.createDataFrame([("g", i, float(i)) for i in range(9)], "g string, i long, l double")
    assert tuple(hi.batch_mean_loss(x, "g", "i", "l", 4).first()) == ("g", 3, (1.5 + 5.5 + 8) / 3)
    assert tuple(hi.batch_mean_loss(x, "g", "i", "l", 4, True).first()) == ("g", 2, 3.5)


def test_layers(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4, 4))
    cells = spark.createDataFrame([(0, int(i), float(v)) for i, v in enumerate(x.ravel())], "id int, i int, v double")
    k = rng.normal(size=9)
    padded = np.pad(x, 1)
    want = [[(padded[y : y + 3, z : z + 3] * k.reshape(3, 3)).sum() for z in range(4)] for y in range(4)]
    got = {r.i: r.v for r in la.conv3x3(cells, k.tolist(), 4).collect()}
    assert [got[i] for i in range(16)] == pytest.approx(np.ravel(want).tolist())
    pooled = {r.i: r.v for r in la.avg_pool(cells, 4).collect()}
    assert [pooled[i] for i in range(4)] == pytest.approx(x.reshape(2, 2, 2, 2).mean((1, 3)).ravel().tolist())
    assert la.norm_groups(48) == 24 and la.norm_groups(7, 4) == 1
    tokens = spark.createDataFrame([(0, t, v.tolist()) for t, v in enumerate(x)], "id int, t int, x array<double>")
    w = np.exp(x @ x.T / 2)
    want = (w / w.sum(1, keepdims=True)) @ x
    assert {r.t: r.z for r in la.attention(tokens).collect()} == {t: pytest.approx(v.tolist()) for t, v in enumerate(want)}
    dense = tokens.select(la.swish(la.dense("x", [[1.0, 0, 0, 2.0]], [0.5])).alias("y")).first().y[0]
    h = x[0, 0] + 2 * x[0, 3] + 0.5
    assert dense == pytest.approx(h / (1 + math.exp(-h)))
    doubled = la.infer(cells, lambda: lambda b: b.assign(v=b.v * 2), "id int, i int, v double")
    assert sum(r.v for r in doubled.collect()) == pytest.approx(2 * x.sum())


def test_stream(spark, tmp_path):
    index = spark.createDataFrame([(f"a{i}", i % 2) for i in range(20)], "rel_path string, ss_cat int")
    n = take_batches(sample_stream(spark, index, 1.0, 1, 50), f"{tmp_path}/rows", f"{tmp_path}/cp", 2)
    got = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert n == 2 and len(got) == 100 and {r.ss_cat for r in got} == {0, 1} and all(0 <= r.place < 10 for r in got)


def test_configuration(tmp_path):
    (tmp_path / "a.yaml").write_text("x: {y: 1, z: [1, 2]}\nlr: 1e-4\n")
    (tmp_path / "b.yaml").write_text("_base_: a.yaml\nx: {z: [3]}\n")
    (tmp_path / "c.yaml").write_text("_base_: [a.yaml, b.yaml]\nx: {w: true}\n")
    got = cf.load(tmp_path / "c.yaml", ["x.y=2.5", "x.new=false", "name=a=b"])
    assert got == {"x": {"y": 2.5, "z": [3], "w": True, "new": False}, "lr": "1e-4", "name": "a=b"}
    with pytest.raises(KeyError):
        cf.load(tmp_path / "c.yaml", ["q.r=1"])
    (tmp_path / "a.yaml").write_text("_base_: c.yaml\n")
    with pytest.raises(ValueError, match="circle"):
        cf.load(tmp_path / "c.yaml")
    (tmp_path / "l.yaml").write_text("- 1\n")
    with pytest.raises(ValueError):
        cf.load(tmp_path / "l.yaml")
    assert [cf.parse_scalar(v) for v in ("True", "3", "0.5", "x")] == [True, 3, 0.5, "x"]
    e = cf.evaluation({"evaluation": {"n_plot_per_group": 7}})
    assert e["n_per_class_light"] == 7 and e["seed"] == 123
    e = cf.evaluation({"evaluation": {"proxy_classifier": {"C": 2.0}}})
    assert (e["n_per_class_heavy"], e["n_per_class_light"], e["every_epochs"], e["heavy_every_epochs"], e["sampler"], e["enabled"]) == (50, 25, 5, 25, "ddpm", True)
    assert e["proxy_classifier"] == {"enabled": True, "max_train_per_class": 2000, "C": 2.0, "solver": "lbfgs", "max_iter": 200}
    with pytest.raises(ValueError):
        cf.evaluation({"evaluation": {"psd_bins": 0}})
