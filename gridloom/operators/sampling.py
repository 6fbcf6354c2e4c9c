"""Class-reweighted and fixed balanced samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import col, seeded, uniform


def class_probabilities(index: DataFrame, alpha: float) -> DataFrame:
    """ss_cat, n and prob proportional to (n / N) ** alpha over the classes that have files (a handful of rows)."""
    counts = index.groupBy("ss_cat").agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    every = Window.partitionBy()
    weight = F.pow(F.col("n") / F.sum("n").over(every), F.lit(alpha))
    return counts.withColumn("__w", weight).select("ss_cat", "n", (F.col("__w") / F.sum("__w").over(every)).alias("prob"))


def set_probabilities(counts: DataFrame) -> DataFrame:
    """Drops classes without files or probability and rescales the rest to 1; a sum of zero is an error."""
    live = counts.where((F.col("n") > 0) & (F.col("prob") > 0))
    total = F.sum("prob").over(Window.partitionBy())
    return live.withColumn("prob", F.when(total > 0, F.col("prob") / total).otherwise(F.raise_error(F.lit("class probabilities must sum to a positive number"))))


def ramp_value(epoch: str | Column, start: float = 1.0, end: float = 0.4, first: int = 0, ramp: int = 40, mode: str = "cosine") -> Column:
    """The weight of an epoch on a linear or cosine ramp."""
    if mode not in ("linear", "cosine"):
        raise ValueError("mode: linear or cosine")
    e = col(epoch).cast("double")
    if ramp <= 1:
        value = F.lit(end)
    else:
        p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (e - first) / (ramp - 1)))
        p = (F.lit(1.0) - F.cos(p * math.pi)) * 0.5 if mode == "cosine" else p
        value = (F.lit(1.0) - p) * start + p * end
    return F.when(e < first, F.lit(start)).otherwise(value)


def alpha_ramp(spark: SparkSession, epochs: int, start: float = 1.0, end: float = 0.4, first: int = 0, ramp: int = 40, mode: str = "cosine") -> DataFrame:
    """epoch and alpha of a linear or cosine ramp."""
    return spark.range(epochs).select(F.col("id").cast("int").alias("epoch"), ramp_value("id", start, end, first, ramp, mode).alias("alpha"))


def per_class(index: DataFrame, k: int, seed: int, key: str = "rel_path", by: str = "ss_cat") -> DataFrame:
    """Up to k rows of each class after a seeded shuffle; Spark cuts ranks above k on the map side."""
    order = Window.partitionBy(by).orderBy(seeded(seed, key), key)
    return index.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k).drop("__r")


def in_split(index: DataFrame, split: DataFrame, name: str) -> DataFrame:
    return index.join(split.where(F.col("split") == name).select("rel_path"), "rel_path", "left_semi")


def cumulative(probabilities: DataFrame) -> DataFrame:
    """ss_cat, n and the half-open range [low, high) of uniform numbers that draw the class."""
    upto = Window.orderBy("ss_cat").rowsBetween(Window.unboundedPreceding, 0)
    last = F.lead("ss_cat").over(Window.orderBy("ss_cat")).isNull()
    high = F.sum("prob").over(upto)
    return probabilities.select("ss_cat", "n", (high - F.col("prob")).alias("low"), F.when(last, F.lit(2.0)).otherwise(high).alias("high"))


def drawn(draws: DataFrame, ranges: DataFrame, seed: int, key: str = "draw") -> DataFrame:
    """Draws with a class by probability and a place among the files of the class, both from one digest."""
    d = seeded(seed, key)
    u = draws.withColumn("__u", uniform(d)).withColumn("__v", uniform(d, 9))
    hit = u.join(F.broadcast(ranges), (F.col("__u") >= F.col("low")) & (F.col("__u") < F.col("high")))  # a row per class
    return hit.withColumn("place", F.least(F.floor(F.col("__v") * F.col("n")), F.col("n") - 1).cast("long")).drop("__u", "__v", "low", "high", "n")


def weighted_draws(index: DataFrame, n: int, alpha: float, seed: int) -> DataFrame:
    """draw, ss_cat and rel_path of n draws with replacement: a class by weight, then one of its files."""
    draws = index.sparkSession.range(n).withColumnRenamed("id", "draw")
    return drawn(draws, cumulative(class_probabilities(index, alpha)), seed).join(class_places(index), ["ss_cat", "place"]).select("draw", "ss_cat", "rel_path")


def class_places(index: DataFrame) -> DataFrame:
    """ss_cat, rel_path and the path's place from 0 in its class: a dense number over all rows less that of the
    class's first, so that no class is ordered in one task."""
    from gridloom.operators.catalog import dense_index

    rows = dense_index(index.select("ss_cat", "rel_path"), ["ss_cat", "rel_path"], "__at")
    first = rows.groupBy("ss_cat").agg(F.min("__at").alias("__first"))
    return rows.join(F.broadcast(first), "ss_cat").select("ss_cat", "rel_path", (F.col("__at") - F.col("__first")).alias("place"))  # a row per class


def gate(p: str | Column, seed: int, *keys: str) -> Column:
    """A Bernoulli draw of probability p from a digest."""
    return uniform(seeded(seed, *keys)) < col(p)


def dropped_condition(rows: DataFrame, p: float, seed: int, key: str, null_label: int = 6, null_wind: float = 0.0) -> DataFrame:
    """Label and wind replaced together, by one draw, with their null values."""
    drop = gate(F.lit(p), seed, key)
    return rows.withColumns({"label": F.when(drop, F.lit(null_label)).otherwise(F.col("label")), "wind_kt": F.when(drop, F.lit(null_wind)).otherwise(F.col("wind_kt"))})
