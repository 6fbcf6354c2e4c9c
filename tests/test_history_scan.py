import math
import random

import pytest
from pyspark.sql import functions as F

from gridloom.operators import history as hi
from gridloom.sources import files as fi


def folded(xs, decay):
    out, s = [], None
    for x in xs:
        s = x if s is None else None if x is None else decay * s + (1 - decay) * x
        out.append(s)
    return out


@pytest.mark.parametrize("decay", [0.0, 0.3, 0.999])
def test_blocks_give_what_one_fold_gives(spark, decay, monkeypatch):
    monkeypatch.setattr(hi, "FOLD", 4)  # three levels and more
    rng = random.Random(2)
    runs = {g: [None if rng.random() < 0.1 else rng.gauss(0, 10 ** rng.randint(-3, 3)) for _ in range(n)] for g, n in (("a", 150), ("b", 1), ("c", 37), (None, 9), ("n", 3))}
    runs["n"] = [None, None, 1.5]
    rows = [(g, k, x) for g, xs in runs.items() for k, x in enumerate(xs)]
    rng.shuffle(rows)
    got = hi.ema(spark.createDataFrame(rows, "run string, step long, value double"), "run", "step", "value", decay).collect()
    assert len(got) == len(rows)
    for g, xs in runs.items():
        mine = [r.ema for r in sorted((r for r in got if r.run == g), key=lambda r: r.step)]
        for a, b in zip(mine, folded(xs, decay), strict=True):
            assert a == b if a is None or b is None else math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12)


def test_a_long_run_is_spread_over_tasks(spark):
    n = 200_000
    series = spark.range(n).select(F.lit(1).alias("run"), F.col("id").alias("step"), (F.col("id") % 10).cast("double").alias("value"))
    got = hi.ema(series, "run", "step", "value", 0.5)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan.split("AdaptiveSparkPlan")[1]
    last = {r.step % 10: r.ema for r in got.where(F.col("step") >= n - 10).collect()}
    s, want = 0.0, {}
    for k in range(200):
        s = s * 0.5 + (k % 10) * 0.5
        want[k % 10] = s
    assert last == pytest.approx(want) and got.count() == n
    with pytest.raises(ValueError):
        hi.ema(series, "run", "step", "value", 1.0)


def plain(epochs, patience, delta):
    best, at, bad, fair, fair_at, stop, last = math.inf, None, 0, math.inf, None, None, None
    for k, f, b in sorted(epochs):
        last = k
        if f is not None:
            if best - f > delta:
                best, at, bad = f, k, 0
            else:
                bad += 1
        if b is not None and fair - b > delta:
            fair, fair_at = b, k
        if f is not None and bad >= patience:
            stop = k
            break
    return last, at, best, bad, fair_at, fair, stop


def test_halves_agree_with_the_whole(spark, tmp_path):
    rng = random.Random(4)
    runs = {g: [(k, None if rng.random() < 0.2 else 10 - min(k, 8) + rng.random(), None if rng.random() < 0.3 else 9 - 0.2 * k + rng.random()) for k in range(n)] for g, n in (("a", 30), ("b", 9), ("c", 3), (None, 12))}
    frame = lambda keep: spark.createDataFrame([(g, *e) for g, es in runs.items() for e in es if keep(e[0])], "run string, epoch int, full double, balanced double")
    args = ("run", "epoch", "full", "balanced", 4, 0.1)
    want = {g: plain(es, 4, 0.1) for g, es in runs.items()}
    whole = {r.run: tuple(r)[1:] for r in hi.track(frame(lambda k: True), *args).collect()}
    assert whole == want and any(w[-1] is not None for w in want.values()) and any(w[-1] is None for w in want.values())
    state = None
    for low, high in ((0, 5), (3, 9), (9, 11), (11, 99)):  # epochs that were seen are ignored
        fi.append_state(hi.track(frame(lambda k: low <= k < high), *args, state), f"{tmp_path}/s")
        state = fi.read_state(spark, f"{tmp_path}/s", "run")
    assert {r.run: tuple(r)[1:] for r in state.collect()} == want
    with pytest.raises(ValueError):
        hi.track(frame(lambda k: True), "run", "epoch", "full", "balanced", 0, 0.1)
