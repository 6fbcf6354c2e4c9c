"""Noise schedules and the deterministic arithmetic of forward noising and denoising steps.

Images and noise are arrays; a step is zip_with on them with scalars from the schedule, a table of one row per
time step (1,000 by default), which is what bounds its broadcast.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import col, midpoint_general, seeded
from gridloom.session import written

# Names of loss types and the prediction that each stands for.
PREDICTION_OF = {"eps": "eps", "eps_mse": "eps", "epsilon": "eps", "epsilon_mse": "eps", "v": "v", "v_mse": "v", "vpred": "v", "v_pred": "v", "v_prediction": "v"}


def prediction_type(loss_type: str) -> str:
    try:
        return PREDICTION_OF[str(loss_type).strip().lower()]
    except KeyError:
        raise ValueError(f"unknown loss type: {loss_type}") from None


def betas(spark: SparkSession, name: str = "linear", steps: int = 1000) -> DataFrame:
    """t and beta."""
    if steps <= 0:
        raise ValueError("steps must be positive")
    t = F.col("id").cast("double")
    if name == "linear":
        return spark.range(steps).select(F.col("id").cast("int").alias("t"), (F.lit(1e-4) + t * ((2e-2 - 1e-4) / max(steps - 1, 1))).alias("beta"))
    if name == "cosine":
        f = lambda x: F.pow(F.cos((x / steps + 0.008) / 1.008 * (math.pi / 2)), F.lit(2.0))
        beta = F.lit(1.0) - f(t + 1) / f(t)
        return spark.range(steps).select(F.col("id").cast("int").alias("t"), F.least(F.greatest(beta, F.lit(1e-8)), F.lit(0.999)).alias("beta"))
    raise ValueError(f"unknown schedule: {name}")


def schedule(table: DataFrame) -> DataFrame:
    """t, beta, alpha, abar (running product), abar_prev (1 first) and post_var."""
    upto = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    out = table.withColumn("alpha", F.lit(1.0) - F.col("beta")).withColumn("abar", F.product("alpha").over(upto))
    out = out.withColumn("abar_prev", F.lag("abar", 1, 1.0).over(Window.orderBy("t")))
    return out.withColumn("post_var", F.col("beta") * (F.lit(1.0) - F.col("abar_prev")) / (F.lit(1.0) - F.col("abar")))


def at_step(rows: DataFrame, sched: DataFrame) -> DataFrame:
    """Each row with the schedule of its ``t``."""
    return rows.join(F.broadcast(sched), "t")


def mix(a: str | Column, x: str, b: str | Column, y: str) -> Column:
    """a x + b y of two arrays."""
    return F.zip_with(x, y, lambda u, v: col(a) * u + col(b) * v)


def q_sample(x0: str = "x0", eps: str = "eps") -> Column:
    return mix(F.sqrt("abar"), x0, F.sqrt(F.lit(1.0) - F.col("abar")), eps)


def v_target(x0: str = "x0", eps: str = "eps") -> Column:
    return mix(F.sqrt("abar"), eps, -F.sqrt(F.lit(1.0) - F.col("abar")), x0)


def target(kind: str, x0: str = "x0", eps: str = "eps") -> Column:
    return F.col(eps) if prediction_type(kind) == "eps" else v_target(x0, eps)


def x0_from_eps(xt: str, eps: str) -> Column:
    return F.zip_with(xt, eps, lambda x, e: (x - F.sqrt(F.lit(1.0) - F.col("abar")) * e) / (F.sqrt("abar") + 1e-8))


def x0_from_v(xt: str, v: str) -> Column:
    return mix(F.sqrt("abar"), xt, -F.sqrt(F.lit(1.0) - F.col("abar")), v)


def eps_from_v(xt: str, v: str) -> Column:
    return mix(F.sqrt(F.lit(1.0) - F.col("abar")), xt, F.sqrt("abar"), v)


def min_snr_weight(kind: str, gamma: float | None) -> Column:
    if gamma is None:
        return F.lit(1.0)
    snr = F.col("abar") / F.greatest(F.lit(1.0) - F.col("abar"), F.lit(1e-8))
    capped = F.least(snr, F.lit(gamma))
    return capped / F.greatest(snr, F.lit(1e-8)) if prediction_type(kind) == "eps" else capped / (snr + 1.0)


def mse(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x) / F.size(a)


def order_stat(x: str, p: float) -> Column:
    """The k-th smallest magnitude, k = p (n - 1) rounded half to even."""
    n = F.size(x)
    k = F.least(F.greatest(F.bround((n - 1) * F.lit(p)).cast("int"), F.lit(0)), n - 1)
    return F.element_at(F.array_sort(F.transform(x, F.abs)), k + 1)


def dynamic_threshold(x: str, p: float = 0.995, eps: float = 1e-8) -> Column:
    limit = F.array(F.greatest(order_stat(x, p), F.lit(1.0)))  # one value, bound by the outer lambda so that it is found once
    return F.element_at(F.transform(limit, lambda s: F.transform(x, lambda v: F.least(F.greatest(v, -s), s) / (s + eps))), 1)


def guided(conditional: str, unconditional: str, scale: float | None) -> Column:
    """u + g (c - u) for g above 0; without it the conditional prediction."""
    if scale is None or scale <= 0:
        return F.col(conditional)
    return F.zip_with(conditional, unconditional, lambda c, u: u + (c - u) * scale)


def reverse_step(rows: DataFrame, kind: str = "v", p: float | None = 0.995, xt: str = "xt", pred: str = "pred", noise: str = "noise", out: str = "x_prev") -> DataFrame:
    """One denoising step of rows with the schedule's columns. At t = 0 it is the clipped prediction of x0."""
    x0 = x0_from_eps(xt, pred) if prediction_type(kind) == "eps" else x0_from_v(xt, pred)
    rows = rows.withColumn("__x0", x0)
    if p is not None:
        rows = rows.withColumn("__x0", dynamic_threshold("__x0", p))
    root = F.sqrt(F.lit(1.0) - F.col("abar")) + 1e-8
    eps = F.zip_with(xt, "__x0", lambda x, z: (x - F.sqrt("abar") * z) / root)
    rows = rows.withColumn("__eps", eps)
    mean = F.zip_with(xt, "__eps", lambda x, e: (x - F.col("beta") / root * e) / F.sqrt("alpha"))
    rows = rows.withColumn("__mean", mean)
    last = F.transform("__x0", lambda v: F.least(F.greatest(v, F.lit(-1.0)), F.lit(1.0)))
    step = F.zip_with("__mean", noise, lambda m, z: m + F.sqrt("post_var") * z)
    return rows.withColumn(out, F.when(F.col("t") == 0, last).otherwise(step)).drop("__x0", "__eps", "__mean")


def prepare_condition(rows: DataFrame, classes: int = 6) -> DataFrame:
    """Fills a missing ``wind_kt`` from the label."""
    wind = F.col("wind_kt") if "wind_kt" in rows.columns else F.lit(None).cast("double")
    return rows.withColumn("wind_kt", F.coalesce(wind, midpoint_general("label", classes)))


Predictor = Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def step_table(name: str, steps: int) -> dict[str, np.ndarray]:
    """beta, alpha, abar and post of a schedule as arrays: a thousand numbers, for loops inside a task."""
    t = np.arange(steps, dtype=float)
    if name == "linear":
        beta = np.linspace(1e-4, 2e-2, steps)
    elif name == "cosine":
        f = lambda x: np.cos((x / steps + 0.008) / 1.008 * (math.pi / 2)) ** 2
        beta = np.clip(1 - f(t + 1) / f(t), 1e-8, 0.999)
    else:
        raise ValueError(f"unknown schedule: {name}")
    abar = np.cumprod(1 - beta)
    before = np.concatenate([[1.0], abar[:-1]])
    return {"beta": beta, "alpha": 1 - beta, "abar": abar, "post": beta * (1 - before) / (1 - abar)}


def seeded_noise(seed: int, ids: np.ndarray, size: int) -> Callable[[], np.ndarray]:
    """Normal numbers from a generator seeded by each id: a row of ``size`` for each at every call."""
    sources = [np.random.default_rng([seed, abs(int(i)), int(i < 0)]) for i in ids]
    return lambda: np.stack([g.standard_normal(size) for g in sources])


def sample_loop(
    requests: DataFrame, predict: Predictor, size: int, steps: int = 1000, kind: str = "v", p: float | None = 0.995, seed: int = 0, schedule_name: str = "linear", guidance: float | None = 0.0, null_label: int = 6, null_wind: float = 0.0, noise=seeded_noise
) -> DataFrame:
    """id, label, wind_kt and the image x of each request: all reverse steps in one Spark stage.

    A request has ``id``, ``label`` (null: unconditional) and perhaps ``wind_kt`` (null: the label's midpoint).
    ``predict(x, t, labels, winds)`` is the caller's network; with ``guidance`` above 0 it is asked once for the
    conditions and the null condition together, and the answers are combined. Noise comes from ``noise``, by each
    id, so retried tasks give the same images.
    """
    kind = prediction_type(kind)
    table = step_table(schedule_name, steps)

    def run(batches):
        for batch in batches:
            if not len(batch):
                continue
            labels, winds = batch["label"].to_numpy(), batch["wind_kt"].to_numpy(float)
            draw, n = noise(seed, batch["id"].to_numpy(), size), len(batch)
            x = draw()
            for t in range(steps - 1, -1, -1):
                if guidance and guidance > 0:
                    both = predict(np.concatenate([x, x]), t, np.concatenate([labels, np.full(n, null_label)]), np.concatenate([winds, np.full(n, null_wind)]))
                    out = both[n:] + guidance * (both[:n] - both[n:])
                else:
                    out = predict(x, t, labels, winds)
                a, b = math.sqrt(table["abar"][t]), math.sqrt(1 - table["abar"][t])
                x0 = (x - b * out) / (a + 1e-8) if kind == "eps" else a * x - b * out
                if p is not None:
                    k = min(max(int(np.rint(p * (size - 1))), 0), size - 1)
                    s = np.maximum(np.sort(np.abs(x0), axis=1)[:, k : k + 1], 1.0)
                    x0 = np.clip(x0, -s, s) / (s + 1e-8)
                if t == 0:
                    x = np.clip(x0, -1, 1)
                    break
                eps = (x - a * x0) / (b + 1e-8)
                x = (x - table["beta"][t] / (b + 1e-8) * eps) / math.sqrt(table["alpha"][t]) + math.sqrt(table["post"][t]) * draw()
            yield pd.DataFrame({"id": batch["id"], "label": batch["label"], "wind_kt": winds, "x": list(x)})

    wind = F.col("wind_kt").cast("double") if "wind_kt" in requests.columns else F.lit(None).cast("double")
    wind = F.when(F.col("label").isNull(), F.lit(float(null_wind))).otherwise(F.coalesce(wind, midpoint_general("label")))
    asked = requests.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("label"), F.lit(null_label)).cast("int").alias("label"), wind.alias("wind_kt"))
    return asked.mapInPandas(run, "id long, label int, wind_kt double, x array<double>")


def digest_normal(seed: int, size: int) -> Callable[[int], Column]:
    """Normal numbers of each ``id``, call and place, from a digest."""
    from gridloom.operators.feed import normal

    return lambda call: F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: normal(seeded(seed, "id", F.lit(call)), i))


def sample_by_steps(
    requests: DataFrame, predict: Predictor, size: int, steps: int = 1000, kind: str = "v", p: float | None = 0.995, seed: int = 0, schedule_name: str = "linear", guidance: float | None = 0.0, null_label: int = 6, null_wind: float = 0.0, noise: Callable[[int], Column] | None = None, every: int = 25
) -> DataFrame:
    """id, label, wind_kt and the image x of each request, by reverse steps that are DataFrame steps.

    Only the caller's network runs in Python, on Arrow batches; a step's arithmetic is ``reverse_step``. All images are
    written after ``every`` steps, so plans stay short and an executor that is lost costs that many steps and not the
    loop. A request has ``id``, ``label`` (null: unconditional) and perhaps ``wind_kt`` (null: the label's midpoint).
    Noise is a column of the id and the number of the call, so retried tasks give the same images.
    """
    if steps <= 0 or every <= 0:
        raise ValueError("steps and every must be positive")
    noise = noise or digest_normal(seed, size)
    wind = F.col("wind_kt").cast("double") if "wind_kt" in requests.columns else F.lit(None).cast("double")
    wind = F.when(F.col("label").isNull(), F.lit(float(null_wind))).otherwise(F.coalesce(wind, midpoint_general("label")))
    rows = requests.select(F.col("id").cast("long").alias("id"), F.coalesce(F.col("label"), F.lit(null_label)).cast("int").alias("label"), wind.alias("wind_kt"))
    rows = rows.withColumn("x", noise(0))
    table = step_table(schedule_name, steps)
    before = np.concatenate([[1.0], table["abar"][:-1]])
    guide = guidance is not None and guidance > 0

    def answers(t: int) -> Callable:
        def run(batches):
            for batch in batches:
                if not len(batch):
                    continue
                x, labels, winds, n = np.stack(batch["x"].to_list()), batch["label"].to_numpy(), batch["wind_kt"].to_numpy(float), len(batch)
                if guide:  # one call for the conditions and the null condition
                    both = predict(np.concatenate([x, x]), t, np.concatenate([labels, np.full(n, null_label)]), np.concatenate([winds, np.full(n, null_wind)]))
                    yield batch.assign(cond=list(both[:n]), free=list(both[n:]))
                else:
                    out = predict(x, t, labels, winds)
                    yield batch.assign(cond=list(out), free=list(out))

        return run

    schema = "id long, label int, wind_kt double, x array<double>, cond array<double>, free array<double>"
    for k, t in enumerate(range(steps - 1, -1, -1)):
        asked = rows.mapInPandas(answers(t), schema).withColumn("pred", guided("cond", "free", guidance))
        asked = asked.withColumns({"t": F.lit(t), "beta": F.lit(float(table["beta"][t])), "alpha": F.lit(float(table["alpha"][t])), "abar": F.lit(float(table["abar"][t])), "abar_prev": F.lit(float(before[t])), "post_var": F.lit(float(table["post"][t])), "noise": noise(k + 1)})
        rows = reverse_step(asked, kind, p, xt="x").select("id", "label", "wind_kt", F.col("x_prev").alias("x"))
        if (k + 1) % every == 0 and t:
            rows = written(rows, "images")
    return rows
