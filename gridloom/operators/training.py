"""Epochs of a training run: weighted draws with a ramped weight, a shuffle buffer, augmentation by class, batches; the two
validation sets; history, early stopping and going on after a stop. The network and its step are the caller's."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import images as im
from gridloom.operators import catalog, feed, history, sampling
from gridloom.sources import files


@dataclass(frozen=True)
class Settings:
    epochs: int = 1
    steps: int = 2000
    batch: int = 8
    alpha: float = 1.0
    seed: int = 42
    ramp: dict[str, Any] | None = None  # start_alpha, end_alpha, start_epoch, ramp_epochs and mode, instead of alpha
    augment: bool = False
    per_class: int = 5  # rows of each class in the balanced validation set
    patience: int | None = None  # epochs without improvement before the run stops; None: never
    min_delta: float = 0.0

    @classmethod
    def of(cls, config: dict[str, Any], **given: Any) -> Settings:
        """From a configuration tree; what is given and not None goes before it."""
        data, training = config.get("data") or {}, config.get("training") or {}
        ramp, stop = data.get("class_balance_curriculum") or {}, training.get("early_stopping") or {}
        found = {
            "epochs": training.get("num_epochs"), "steps": training.get("steps_per_epoch"), "batch": data.get("batch_size"), "alpha": data.get("class_balance_alpha"), "per_class": data.get("val_balanced_per_class"),
            "ramp": ramp if ramp.get("enabled") else None, "patience": int(stop.get("patience_epochs", 10)) if stop.get("enabled") else None, "min_delta": stop.get("min_delta"),
        }
        return cls(**{k: v for k, v in {**found, **{k: v for k, v in given.items() if v is not None}}.items() if v is not None})


def alphas(spark: SparkSession, s: Settings) -> list[float]:
    """The weight of each epoch."""
    if s.ramp is None:
        return [float(s.alpha)] * s.epochs
    r = s.ramp
    table = sampling.alpha_ramp(spark, s.epochs, float(r.get("start_alpha", 1.0)), float(r.get("end_alpha", s.alpha)), int(r.get("start_epoch", 0)), int(r.get("ramp_epochs", 40)), r.get("mode", "cosine"))
    return [x.alpha for x in table.orderBy("epoch").collect()]  # a row an epoch


def epoch_order(spark: SparkSession, n: int, batch: int, seed: int, epoch: int) -> DataFrame:
    """draw and its place in the epoch after the shuffle buffer: draws 0 to n - 1 in partitions, each its own stream."""
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), n // (8 * batch)))
    rows = feed.buffered(spark.range(0, n, 1, parts), batch, seed, epoch)
    at = F.monotonically_increasing_id()
    first = F.floor(F.shiftright(at, 33) * n / parts)  # the partitions of a range begin there
    return rows.select(F.col("id").alias("draw"), (first + at % (1 << 33)).cast("long").alias("place"))


def epoch_batches(index: DataFrame, images: DataFrame, s: Settings, epoch: int, alpha: float) -> DataFrame:
    """batch, place, draw, rel_path, bt and cond of an epoch. ``index`` has rel_path, ss_cat and wind_kt."""
    spark, n = index.sparkSession, s.steps * s.batch
    order = epoch_order(spark, n, s.batch, s.seed, epoch)
    ranges = sampling.cumulative(sampling.class_probabilities(index, alpha))
    hit = sampling.drawn(order.withColumnRenamed("place", "at"), ranges, f"{s.seed}-{epoch}")
    drawn = hit.join(sampling.class_places(index), ["ss_cat", "place"]).select("draw", "rel_path", F.col("at").alias("place"))
    elements = feed.elements(images, index.select("rel_path", "ss_cat", "wind_kt"))
    rows = drawn.join(elements, "rel_path")
    if s.augment:
        side = int(elements.select(F.sqrt(F.size("bt")).cast("int").alias("n")).first().n)
        policy = F.broadcast(im.augment_policy(spark).select("ss_cat", "p_aug"))  # six rows
        rows = feed.augment(rows.withColumn("ss_cat", F.col("cond.ss_cat")).join(policy, "ss_cat"), "bt", side, "p_aug", s.seed, "draw").drop("ss_cat", "p_aug")
    return feed.batches(rows, "place", s.batch, True)


def validation(index: DataFrame, images: DataFrame, s: Settings) -> dict[str, DataFrame]:
    """The whole validation set and a fixed one with as many rows of each class, as batches in path order."""

    def batched(rows: DataFrame) -> DataFrame:
        placed = catalog.dense_index(rows, ["rel_path"], "place")
        elements = feed.elements(images, placed.select("rel_path", "ss_cat", "wind_kt"))
        return feed.batches(elements.join(placed.select("rel_path", "place"), "rel_path"), "place", s.batch, False)

    return {"full": batched(index), "balanced": batched(sampling.per_class(index, s.per_class, s.seed))}


def run(spark: SparkSession, index: DataFrame, images: DataFrame, step: Callable[[DataFrame, dict[str, Any]], dict[str, float] | None], s: Settings, folder: str | None = None, resume: bool = False, held_out: DataFrame | None = None, about: dict[str, Any] | None = None) -> int:
    """Runs epochs; the number of the last one. ``step(batches, about)`` trains on an epoch's batches and returns its
    losses (train_loss, val_full and val_balanced, each or none). ``about`` has epoch, alpha and the validation sets.

    With a ``folder``, history and run state are added there after every epoch, and ``resume`` goes on after the last
    epoch of the state; a run that had stopped stays stopped."""
    state, begin = None, 0
    if resume:
        if folder is None:
            raise ValueError("resume needs a folder")
        state = files.read_state(spark, f"{folder}/state", "run")
        row = state.first()
        begin = row.last_epoch
        if row.stopped_epoch is not None:
            return begin
    sets = validation(held_out, images, s) if held_out is not None else {}
    weights, last = alphas(spark, s), begin
    for epoch in range(begin, s.epochs):
        batches = epoch_batches(index, images, s, epoch, weights[epoch])
        losses = step(batches, {**(about or {}), "epoch": epoch + 1, "alpha": weights[epoch], "validation": sets}) or {}
        last = epoch + 1
        if folder is None:
            continue
        schema = "epoch int, train_loss double, val_full double, val_balanced double"
        rows = spark.createDataFrame([(last, *(losses.get(k) for k in ("train_loss", "val_full", "val_balanced")))], schema)
        files.append_history(rows, f"{folder}/history")
        state = history.track(rows.withColumn("run", F.lit(0)), "run", "epoch", "val_full", "val_balanced", s.patience or 1 << 30, s.min_delta, state)
        state = spark.createDataFrame(state.collect(), state.schema)  # one row
        files.append_state(state, f"{folder}/state")
        if state.first().stopped_epoch is not None:
            break
    return last
