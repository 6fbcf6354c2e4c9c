"""The training and evaluation feed: normalized elements with conditions, augmentation, batches, grids."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from pathlib import Path
from typing import Any

import numpy as np
import pyarrow as pa
import yaml
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions import images as im
from gridloom.functions.scalar import col, seeded, uniform


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df``, or an error if it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df


def require_some_wind(elements: DataFrame) -> DataFrame:
    """An error if every wind of ``wind_fallback`` rows is a fallback."""
    if elements.where(~F.col("is_fallback")).isEmpty():
        raise ValueError("no file has wind metadata")
    return elements


def elements(images: DataFrame, conditions: DataFrame, use_wind: bool = True) -> DataFrame:
    """rel_path, bt in [-1, 1] and cond (class, and wind if asked) of images with a condition. The narrow
    conditions are joined before the images' arrays are touched."""
    fields = [F.col("ss_cat").cast("int").alias("ss_cat"), *([F.col("wind_kt").cast("float").alias("wind_kt")] if use_wind else [])]
    joined = images.select("rel_path", "bt").join(conditions, "rel_path")
    return joined.select("rel_path", im.normalize("bt").alias("bt"), F.struct(*fields).alias("cond"))


def _byte(digest: Column, at: int) -> Column:
    return F.conv(F.substring(digest, at, 2), 16, 10).cast("int")


def normal(digest: Column, i: Column) -> Column:
    """A normal number from a digest and a place: two uniform numbers turned by Box and Muller."""
    own = F.md5(F.concat(digest, F.lit("#"), i.cast("string")))
    return F.sqrt(-2.0 * F.log(uniform(own) + 2.0**-33)) * F.cos(2.0 * math.pi * uniform(own, 9))


def augment(rows: DataFrame, x: str, n: int, p: str | Column, seed: int, key: str, shift: int = 2, max_bars: int = 0) -> DataFrame:
    """Images turned and moved with probability ``p``, all choices from one digest of the key. Erasing bars is off
    unless ``max_bars`` is above 0: then 0 to that many, each across the whole image, 1 to 5 wide, filled with the
    image's mean and noise of a tenth of its deviation."""
    d = seeded(seed, key)
    out = rows.withColumns({"__on": uniform(d) < col(p), "__k": _byte(d, 9) % 4, "__dy": _byte(d, 11) % (2 * shift + 1) - shift, "__dx": _byte(d, 13) % (2 * shift + 1) - shift})
    out = out.withColumn("__x", im.turn_and_shift(x, n, "__k", "__dy", "__dx"))
    if max_bars > 0:
        out = out.withColumn("__bars", _byte(d, 15) % (max_bars + 1))
        for k in range(max_bars):
            own = F.md5(F.concat(d, F.lit(f"|{k}")))
            mean = F.aggregate("__x", F.lit(0.0), lambda a, v: a + v) / F.size("__x")
            out = out.withColumns({"__v": _byte(own, 1) % 2 == 0, "__w": F.least(_byte(own, 3) % 5 + 1, F.lit(n)), "__f": mean})
            out = out.withColumn("__s", _byte(own, 5) % (n - F.col("__w") + 1))
            std = F.sqrt(F.aggregate("__x", F.lit(0.0), lambda a, v: a + (v - F.col("__f")) * (v - F.col("__f"))) / F.size("__x"))
            noise = lambda digest, mean, scale: F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), lambda i: mean + normal(digest, i) * 0.1 * scale)
            out = out.withColumn("__fill", im.held(noise, own, "__f", std + 1e-6))
            out = out.withColumn("__x", F.when(F.lit(k) < F.col("__bars"), im.erase_bar("__x", n, "__v", "__s", "__w", "__fill", by_pixel=True)).otherwise(F.col("__x")))
    out = out.withColumn(x, F.when(F.col("__on"), F.col("__x")).otherwise(F.col(x)))
    return out.drop("__on", "__k", "__dy", "__dx", "__x", "__v", "__s", "__w", "__f", "__fill", "__bars")


def shuffled(df: DataFrame, seed: int, key: str) -> DataFrame:
    """A seeded order of the rows that repeats on any cluster."""
    return df.orderBy(seeded(seed, key), key)


def buffered(df: DataFrame, batch: int, seed: int, epoch: int = 0) -> DataFrame:
    """The rows of each partition's stream through a buffer of four batches: every row that comes in once it is full sends
    out a random one of those held, and the rest follow in random order at the end. Choices depend on seed, epoch and
    partition alone, so a task that runs again gives the same order; nothing moves between partitions, and no more than
    the buffer and an Arrow batch is held."""
    if batch <= 0:
        raise ValueError("batch must be positive")
    size = 4 * batch

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, epoch, part])
        held = None
        for incoming in stream:
            if not incoming.num_rows:
                continue
            rows = pa.Table.from_batches([incoming] if held is None else [held, incoming])
            slots = list(range(min(size, rows.num_rows)))  # the rows that the buffer holds, by number
            out = np.empty(max(rows.num_rows - size, 0), np.int64)
            for k, pick in enumerate(rng.integers(0, size, len(out)).tolist()):
                out[k], slots[pick] = slots[pick], size + k
            if len(out):
                yield from rows.take(pa.array(out)).combine_chunks().to_batches()
            held = rows.take(pa.array(slots)).combine_chunks().to_batches()[0]
        if held is not None:
            yield held.take(pa.array(rng.permutation(held.num_rows)))

    return df.mapInArrow(run, df.schema)


def batches(df: DataFrame, row: str, size: int, drop_last: bool) -> DataFrame:
    """``batch`` of rows numbered from 0; a short last batch is kept for evaluation and dropped for training. The
    rows of each batch are counted from the number of rows, not by gathering them."""
    if size <= 0:
        raise ValueError("size must be positive")
    out = df.withColumn("batch", F.floor(F.col(row) / size).cast("long"))
    if not drop_last:
        return out
    full = df.agg((F.count(F.lit(1)) / size).cast("long").alias("__full"))
    return out.join(F.broadcast(full), F.col("batch") < F.col("__full")).drop("__full")  # one row


def epoch(df: DataFrame, steps: int, size: int, row: str) -> DataFrame:
    """The rows of the first ``steps`` batches."""
    return df.where(F.col(row) < steps * size)


def sample_grid(images: DataFrame, place: str, columns: int, n: int) -> DataFrame:
    """y, x and v of a grid of n x n images by their place; blank cells are 0."""
    px = im.pixels(images.select(F.col(place).alias("__p"), "bt"))
    at = lambda p, i: ((F.floor(p / columns) * n + F.floor(i / n)).cast("int").alias("y"), ((p % columns) * n + i % n).cast("int").alias("x"))
    drawn = px.select(*at(F.col("__p"), F.col("i")), "v")
    count = images.agg(F.count(F.lit(1)).alias("c"))
    cells = count.select(F.explode(F.sequence(F.lit(0), (F.ceil(F.col("c") / columns) * columns * n * n - 1).cast("int"))).alias("j"))
    cells = cells.select(*at(F.floor(F.col("j") / (n * n)).cast("int"), (F.col("j") % (n * n)).cast("int")))
    return cells.join(drawn, ["y", "x"], "left").select("y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


def write_run(folder: str | Path, config: dict[str, Any], meta: dict[str, Any]) -> None:
    """A run's resolved configuration and launch metadata, on the driver."""
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    (folder / "config.yaml").write_text(yaml.safe_dump(config, sort_keys=False))
    (folder / "run.json").write_text(json.dumps(meta, indent=2))
