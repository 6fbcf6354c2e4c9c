"""Network layers as relational queries, for small arrays; inference with a caller's own network."""

from __future__ import annotations


from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def norm_groups(channels: int, most: int = 32) -> int:
    """The largest number of groups up to ``most`` that divides the channels."""
    return next(g for g in range(min(most, channels), 0, -1) if channels % g == 0)


def groupnorm(cells: DataFrame, channels: int, most: int = 32, eps: float = 1e-5) -> DataFrame:
    """id, c, i, v with v scaled to mean 0 and variance 1 within each item's group of channels."""
    width = channels // norm_groups(channels, most)
    own = Window.partitionBy("id", F.floor(F.col("c") / width))
    return cells.select("id", "c", "i", ((F.col("v") - F.avg("v").over(own)) / F.sqrt(F.var_pop("v").over(own) + eps)).alias("v"))


def film(x: str | Column, gamma: str | Column, beta: str | Column) -> Column:
    """x (1 + gamma) + beta, then x sigmoid(x)."""
    x, gamma, beta = (F.col(c) if isinstance(c, str) else c for c in (x, gamma, beta))
    h = x * (gamma + 1.0) + beta
    return h / (F.exp(-h) + 1.0)


def avg_pool(cells: DataFrame, n: int) -> DataFrame:
    """2 x 2 means of n x n images (id, i, v)."""
    y, x = F.floor(F.col("i") / n), F.col("i") % n
    return cells.groupBy("id", (F.floor(y / 2) * (n // 2) + F.floor(x / 2)).cast("int").alias("i")).agg(F.avg("v").alias("v"))


def upsample(images: DataFrame, n: int) -> DataFrame:
    """Bilinear doubling with half-pixel centres: id, x of n x n arrays to 2n x 2n."""

    def at(i: Column) -> Column:
        def ends(k: Column) -> tuple[Column, Column, Column]:
            s = F.least(F.greatest((k + 0.5) / 2 - 0.5, F.lit(0.0)), F.lit(float(n - 1)))
            low = F.floor(s).cast("int")
            return low, F.least(low + 1, F.lit(n - 1)), s - low

        y0, y1, fy = ends(F.floor(i / (2 * n)))
        x0, x1, fx = ends(i % (2 * n))
        v = lambda y, x: F.element_at("x", (y * n + x + 1).cast("int"))
        return (v(y0, x0) * (1 - fx) + v(y0, x1) * fx) * (1 - fy) + (v(y1, x0) * (1 - fx) + v(y1, x1) * fx) * fy

    return images.select("id", F.transform(F.sequence(F.lit(0), F.lit(4 * n * n - 1)), at).alias("x"))


def joined_channels(x: str | Column, skip: str | Column, channels: int, skip_channels: int) -> Column:
    """Two images of one size (channels last) as one: each pixel's channels of the first, then those of the second."""
    x, skip = (F.col(c) if isinstance(c, str) else c for c in (x, skip))
    pixel = lambda p, i: F.concat(F.slice(p["x"], i * channels + 1, F.lit(channels)), F.slice(p["s"], i * skip_channels + 1, F.lit(skip_channels)))
    both = F.array(F.struct(x.alias("x"), skip.alias("s")))  # named, so that neither image is made again for each pixel
    return F.flatten(F.flatten(F.transform(both, lambda p: F.transform(F.sequence(F.lit(0), (F.size(p["x"]) / channels - 1).cast("int")), lambda i: pixel(p, i)))))


def conv3x3(cells: DataFrame, kernel: list[float], n: int) -> DataFrame:
    """One-channel convolution with zero padding: every pixel adds to its up to nine neighbours."""
    offsets = F.array(*[F.struct(F.lit(1 - k // 3).alias("dy"), F.lit(1 - k % 3).alias("dx"), F.lit(float(w)).alias("w")) for k, w in enumerate(kernel)])
    spread = cells.select("id", F.floor(F.col("i") / n).cast("int").alias("y"), (F.col("i") % n).cast("int").alias("x"), "v", F.explode(offsets).alias("o"))
    y, x = F.col("y") + F.col("o.dy"), F.col("x") + F.col("o.dx")
    inside = spread.where(y.between(0, n - 1) & x.between(0, n - 1))
    return inside.groupBy("id", (y * n + x).alias("i")).agg(F.sum(F.col("v") * F.col("o.w")).alias("v"))


def attention(tokens: DataFrame) -> DataFrame:
    """id, t and the attended value ``z`` of rows (id, t, x): softmax over the item's tokens of x . x / sqrt(d)."""
    other = tokens.select("id", F.col("t").alias("s"), F.col("x").alias("y"))
    dot = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    pairs = tokens.join(other, "id").select("id", "t", "s", "y", (dot / F.sqrt(F.size("x"))).alias("score"))
    row = Window.partitionBy("id", "t")
    weights = pairs.withColumn("e", F.exp(F.col("score") - F.max("score").over(row)))
    weights = weights.withColumn("w", F.col("e") / F.sum("e").over(row))
    parts = weights.select("id", "t", F.posexplode(F.transform("y", lambda v: v * F.col("w"))).alias("d", "p"))
    sums = parts.groupBy("id", "t", "d").agg(F.sum("p").alias("p"))
    return sums.groupBy("id", "t").agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "p"))), lambda v: v["p"]).alias("z"))


def dense(x: str | Column, weights: list[list[float]], bias: list[float]) -> Column:
    """A small dense layer: one output per row of weights."""
    x = F.col(x) if isinstance(x, str) else x
    outs = [F.aggregate(F.zip_with(x, F.array(*[F.lit(float(w)) for w in row]), lambda a, b: a * b), F.lit(float(b)), lambda s, v: s + v) for row, b in zip(weights, bias)]
    return F.array(*outs)


def swish(x: str | Column) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.transform(x, lambda v: v / (F.exp(-v) + 1.0))


def branch_sum(*branches: str | Column) -> Column:
    """The sum of arrays of equal length, place by place."""
    first, *rest = (F.col(x) if isinstance(x, str) else x for x in branches)
    for x in rest:
        first = F.zip_with(first, x, lambda a, b: a + b)
    return first


def infer(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: str) -> DataFrame:
    """Rows through a caller's network, which each task loads once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        network = load()
        for batch in batches:
            yield network(batch)

    return rows.mapInPandas(run, schema)


