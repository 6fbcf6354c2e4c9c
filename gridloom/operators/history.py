"""Training bookkeeping: averages of batches, exponential averages, early stopping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.catalog import dense_index
from gridloom.session import written


def batch_mean_loss(losses: DataFrame, group: str, row: str, loss: str, batch: int, drop_last: bool = False) -> DataFrame:
    """The mean of batch means (a short last batch weighs as much as a full one, unless it is dropped)."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    means = losses.groupBy(group, F.floor(F.col(row) / batch).alias("__batch")).agg(F.avg(loss).alias("m"), F.count(F.lit(1)).alias("n"))
    means = means.where(F.col("n") == batch) if drop_last else means
    return means.groupBy(group).agg(F.count(F.lit(1)).alias("batches"), F.avg("m").alias("loss"))


FOLD = 64  # maps a block: a block is folded in one expression


def _then(first: Column, second: Column) -> Column:
    """The effect of ``first`` and then ``second``. An effect has (a, b), what becomes of a value s: a s + b or, if a is
    null, none; and v, what becomes of none: a value, or none if it is null."""
    value = F.when(first["v"].isNull(), second["v"]).when(second["a"].isNotNull(), second["a"] * first["v"] + second["b"])
    lost = F.when(second["v"].isNotNull(), F.lit(0.0))  # none, then none's value: the same for any s
    a = F.when(first["a"].isNull(), lost).when(second["a"].isNotNull(), second["a"] * first["a"])
    b = F.when(first["a"].isNull(), second["v"]).when(second["a"].isNotNull(), second["a"] * first["b"] + second["b"])
    return F.struct(a.alias("a"), b.alias("b"), value.alias("v"))


def _after(state: Column, effect: Column) -> Column:
    """The value after an effect on ``state`` (null: none)."""
    return F.when(state.isNull(), effect["v"]).when(effect["a"].isNotNull(), effect["a"] * state + effect["b"])


NOTHING = "struct<a:double,b:double,v:double>"


def _blocks(rows: DataFrame, group: str, number: str, *keep: str) -> DataFrame:
    """Rows of a group (numbered, with ``m``, an effect) in arrays of up to ``FOLD``, in order."""
    item = F.struct(number, "m", *keep)
    return rows.groupBy(group, F.floor(F.col(number) / FOLD).alias("__block")).agg(F.array_sort(F.collect_list(item), lambda x, y: (x[number] - y[number]).cast("int")).alias("xs"))


def ema(series: DataFrame, group: str, step: str, value: str, decay: float) -> DataFrame:
    """group, step and the recursion s = decay s + (1 - decay) value, which starts at the first value. A null value gives
    none, and the next one starts again.

    Each row is an affine map of s. Rows are numbered over range partitions, and blocks of ``FOLD`` of them are folded to
    one map each, those again, and so on to one block a group; then every level hands its blocks the value that they
    begin with. No group is ordered or held in one task, however long the run.
    """
    if not 0 <= decay < 1:
        raise ValueError("decay must be in [0, 1)")
    rows = series.select(F.col(group), F.col(step).cast("long").alias(step), F.col(value).cast("double").alias("__x"))
    rows = dense_index(rows, [group, step, "__x"], "__n")
    a, b = F.when(F.col("__x").isNotNull(), F.lit(decay)), F.col("__x") * (1 - decay)
    level = written(_blocks(rows.withColumn("m", F.struct(a.alias("a"), b.alias("b"), F.col("__x").alias("v"))), group, "__n", step), "ema")
    levels = [level]
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(None).cast("double").alias("v")).cast(NOTHING)
    while not levels[-1].where("__block > 0").isEmpty():
        folded = levels[-1].select(group, F.col("__block").alias("__n"), F.aggregate("xs", start, lambda s, x: _then(s, x["m"]).cast(NOTHING)).alias("m"))
        levels.append(written(_blocks(folded, group, "__n"), "ema"))
    # a prefix of at most FOLD maps is folded anew for each place
    upto = lambda xs, n, s: F.aggregate(F.slice(xs, 1, n), s, lambda t, x: _after(t, x["m"]))
    begun = levels[-1].select(group, "__block", F.lit(None).cast("double").alias("__s"))
    for above, below in zip(reversed(levels), reversed(levels[:-1])):
        given = above.join(begun.withColumnRenamed(group, "__g").withColumnRenamed("__block", "__b"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
        given = given.select(group, F.explode(F.transform("xs", lambda x, i: F.struct(x["__n"].alias("n"), upto("xs", i, F.col("__s")).alias("s")))).alias("o"))
        begun = given.select(group, F.col("o.n").alias("__block"), F.col("o.s").alias("__s"))
    last = levels[0].join(begun.withColumnRenamed(group, "__g").withColumnRenamed("__block", "__b"), F.col(group).eqNullSafe(F.col("__g")) & (F.col("__block") == F.col("__b")))
    out = last.select(group, F.explode(F.transform("xs", lambda x, i: F.struct(x[step].alias("k"), upto("xs", i + 1, F.col("__s")).alias("s")))).alias("o"))
    return out.select(group, F.col("o.k").alias(step), F.col("o.s").alias("ema"))


def early_stop(history: DataFrame, group: str, epoch: str, metric: str, patience: int, min_delta: float) -> DataFrame:
    """group, best_epoch, best_metric, stopped_epoch (null: ran to the end). The best moves only by more than
    ``min_delta``; null metrics are skipped; what follows a stop is ignored."""
    ordered = history.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("bigint").alias("k"), F.col(metric).cast("double").alias("v")))).alias("xs"))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(None).cast("bigint").alias("at"), F.lit(0).alias("bad"), F.lit(None).cast("bigint").alias("stop"))

    def step(a, x):
        better = a["best"] - x["v"] > min_delta
        bad = F.when(better, F.lit(0)).otherwise(a["bad"] + 1)
        new = F.struct(F.when(better, x["v"]).otherwise(a["best"]).alias("best"), F.when(better, x["k"]).otherwise(a["at"]).alias("at"), bad.alias("bad"), F.when(bad >= patience, x["k"]).alias("stop"))
        return F.when(a["stop"].isNotNull() | x["v"].isNull(), a).otherwise(new)

    return ordered.select(group, F.aggregate("xs", start, step).alias("r")).select(group, F.col("r.at").alias("best_epoch"), F.col("r.best").alias("best_metric"), F.col("r.stop").alias("stopped_epoch"))


RUN_STATE = "last_epoch bigint, best_epoch bigint, best_full double, bad int, best_balanced_epoch bigint, best_balanced double, stopped_epoch bigint"


def track(history: DataFrame, group: str, epoch: str, full: str, balanced: str, patience: int, min_delta: float, state: DataFrame | None = None) -> DataFrame:
    """group and its run state after the epochs of ``history``, carried on from ``state`` where given.

    The full metric drives early stopping: its best moves by more than ``min_delta``, any other measured epoch counts
    against ``patience``. The balanced metric has a best of its own and stops nothing. Null metrics are skipped, an epoch
    that the state has seen or that follows a stop is ignored, and groups without new epochs keep their state. A run
    has a row an epoch, so a group's epochs are folded in order in one expression.
    """
    if patience <= 0:
        raise ValueError("patience must be positive")
    item = F.struct(F.col(epoch).cast("bigint").alias("k"), F.col(full).cast("double").alias("f"), F.col(balanced).cast("double").alias("b"))
    epochs = history.groupBy(group).agg(F.array_sort(F.collect_list(item)).alias("__xs"))
    kind = f"struct<{', '.join(f'{n}:{t}' for n, t in (c.split() for c in RUN_STATE.split(', ')))}>"
    fresh = F.struct(F.lit(None).alias("last_epoch"), F.lit(None).alias("best_epoch"), F.lit(float("inf")).alias("best_full"), F.lit(0).alias("bad"), F.lit(None).alias("best_balanced_epoch"), F.lit(float("inf")).alias("best_balanced"), F.lit(None).alias("stopped_epoch")).cast(kind)
    names = [c.split()[0] for c in RUN_STATE.split(", ")]
    if state is None:
        rows = epochs.withColumn("__state", fresh)
    else:
        known = state.select(F.col(group).alias("__g"), F.struct(*names).cast(kind).alias("__known"))
        rows = epochs.join(known, F.col(group).eqNullSafe(F.col("__g")), "full_outer")
        rows = rows.select(F.coalesce(group, "__g").alias(group), F.coalesce("__xs", F.array()).alias("__xs"), F.coalesce("__known", fresh).alias("__state"))

    def step(s: Column, x: Column) -> Column:
        better, fairer = s["best_full"] - x["f"] > min_delta, s["best_balanced"] - x["b"] > min_delta
        better, fairer = F.coalesce(better, F.lit(False)), F.coalesce(fairer, F.lit(False))
        bad = F.when(x["f"].isNull(), s["bad"]).when(better, 0).otherwise(s["bad"] + 1)
        new = F.struct(
            x["k"].alias("last_epoch"), F.when(better, x["k"]).otherwise(s["best_epoch"]).alias("best_epoch"), F.when(better, x["f"]).otherwise(s["best_full"]).alias("best_full"), bad.alias("bad"),
            F.when(fairer, x["k"]).otherwise(s["best_balanced_epoch"]).alias("best_balanced_epoch"), F.when(fairer, x["b"]).otherwise(s["best_balanced"]).alias("best_balanced"), F.when(bad >= patience, x["k"]).alias("stopped_epoch"),
        ).cast(kind)
        return F.when(s["stopped_epoch"].isNotNull() | (x["k"] <= s["last_epoch"]), s).otherwise(new)

    return rows.select(group, F.aggregate("__xs", F.col("__state"), step).alias("s")).select(group, "s.*")
