"""Comparing observed and generated images: pixel statistics, histograms, profiles, spectra, kernels.

Images are rows ``class, set, id, bt`` with ``bt`` an array of doubles in row-major order. Pixel aggregates
explode the array once; partial aggregation brings a task's pixels down to a row per group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridloom.functions.images import BT_MAX, BT_MIN, COLD, polar_bins
from gridloom.session import written

EPS = 1e-12


def moments(values: DataFrame, by: list[str], value: str = "v") -> DataFrame:
    """mean, std (population), skew and kurt (excess) of each group; a constant has skew 0 and kurt -3."""
    return values.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.coalesce(F.skewness(value), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis(value), F.lit(-3.0)).alias("kurt"))


FEW_VALUES = 100_000


def _places(inside: DataFrame, splits: DataFrame, key: list[str]) -> DataFrame:
    """key, cell, c, low and high of the cells that splitters cut a bracket into: cell 2 i lies below splitter i (and above
    the one before), cell 2 i + 1 is the splitter itself. Found by halving, not by going through the splitters."""
    splits = F.broadcast(splits) if splits.limit(100_001).count() <= 100_000 else splits  # a row a bracket
    cut = inside.join(splits, key)
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size("xs") + 1)).cast("int"))
    start = F.struct(F.lit(0).alias("a"), F.size("xs").alias("b"))  # splitters before a are below v, those from b on aren't
    half = lambda s: F.floor((s["a"] + s["b"]) / 2).cast("int")
    less = lambda s: F.element_at("xs", half(s) + 1) < F.col("v")
    search = F.aggregate(steps, start, lambda s, _: F.when(s["a"] >= s["b"], s).when(less(s), F.struct((half(s) + 1).alias("a"), s["b"].alias("b"))).otherwise(F.struct(s["a"].alias("a"), half(s).alias("b"))))
    placed = cut.withColumn("at", search["a"])
    hit = F.coalesce(F.try_element_at("xs", F.col("at") + 1) == F.col("v"), F.lit(False))
    counts = placed.groupBy(*key, (2 * F.col("at") + hit.cast("int")).alias("cell")).agg(F.count(F.lit(1)).alias("c"))
    at = F.floor(F.col("cell") / 2).cast("int")
    low, high = F.when(at > 0, F.try_element_at("xs", at)), F.try_element_at("xs", at + 1)
    return counts.join(splits, key).select(*key, "cell", "c", F.coalesce(low, "low").alias("low"), F.coalesce(high, "high").alias("high"))


def quantiles(values: DataFrame, by: list[str], value: str, probabilities: list[float], cells: int = 128, few: int = FEW_VALUES) -> DataFrame:
    """Exact quantiles with linear interpolation: by, q, value. Nulls and NaN take no part.

    A rank is sought in a bracket, at first all of its group. While a bracket holds more than ``few`` values, a sketch of
    them gives about ``cells`` splitters of nearly equal shares, whatever the distribution, and one more pass counts the
    values between and at the splitters: the rank's cell is the next bracket, or a splitter is the answer. Only the
    values of brackets that are small enough are then sorted. Each pass aggregates within tasks first, so no pass moves
    more than the brackets' counts.
    """
    v = F.col(value).cast("double")
    data = values.where(v.isNotNull() & ~F.isnan(v)).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), v.alias("v"))
    # one value for the group, null-safe, so that brackets can be joined by it
    data = data.select(F.struct(*(f"__k{i}" for i in range(len(by))), F.lit(0).alias("__any")).alias("__g"), "v")
    sizes = data.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    rank = F.col("q") * (F.col("n") - 1)
    wanted = sizes.select("__g", "n", F.explode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("q"))
    none = F.lit(None).cast("double")
    ranks = wanted.select("__g", "q", rank.alias("at"), F.explode(F.array_distinct(F.array(F.floor(rank), F.ceil(rank)))).alias("rank"), "n")
    open_ = written(ranks.select("__g", "q", "at", "rank", none.alias("low"), none.alias("high"), F.lit(0).cast("long").alias("before"), F.col("n").alias("c"), none.alias("answer")), "ranks")
    done = open_.where("false")
    key = ["__g", "bracket"]
    inside_of = (F.col("low").isNull() | (F.col("v") > F.col("low"))) & (F.col("high").isNull() | (F.col("v") < F.col("high")))

    def bracketed(ranks: DataFrame) -> DataFrame:
        return ranks.withColumn("bracket", F.struct(F.coalesce("low", F.lit(float("nan"))).alias("a"), F.coalesce("high", F.lit(float("nan"))).alias("b")))

    def inside(ranks: DataFrame) -> DataFrame:
        brackets = ranks.select(*key, "low", "high").distinct()
        return data.join(small(brackets), "__g").where(inside_of)

    def small(brackets: DataFrame) -> DataFrame:
        """Broadcast up to 100,000 brackets (a few a group); with more groups the join is by group."""
        return F.broadcast(brackets) if brackets.limit(100_001).count() <= 100_000 else brackets

    while True:
        large = bracketed(open_.where(F.col("c") > few))
        done = done.unionByName(open_.where(F.col("c") <= few))
        if large.isEmpty():
            break
        held = inside(large)
        shares = [i / cells for i in range(1, cells)] if cells > 1 else [0.5]
        splits = written(held.groupBy(*key, "low", "high").agg(F.array_sort(F.array_distinct(F.percentile_approx("v", shares, 100 * cells))).alias("xs")), "splitters")
        counted = written(_places(held.select(*key, "v"), splits, key), "cells")
        order = Window.partitionBy(*key).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)  # 2 cells + 1 rows
        counted = counted.withColumn("skip", F.coalesce(F.sum("c").over(order), F.lit(0)))
        new = large.select(*key, "q", "at", "rank", "before").join(counted, key).where((F.col("rank") >= F.col("before") + F.col("skip")) & (F.col("rank") < F.col("before") + F.col("skip") + F.col("c")))
        exact = F.col("cell") % 2 == 1
        open_ = written(new.select("__g", "q", "at", "rank", "low", "high", (F.col("before") + F.col("skip")).alias("before"), F.when(exact, 0).otherwise(F.col("c")).cast("long").alias("c"), F.when(exact, F.col("high")).alias("answer")), "ranks")
    seek = bracketed(done.where("answer IS NULL"))
    within = Window.partitionBy(*key).orderBy("v").rowsBetween(Window.unboundedPreceding, -1)  # at most ``few`` values
    ordered = inside(seek).groupBy(*key, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("skip", F.coalesce(F.sum("n").over(within), F.lit(0)))
    found = seek.drop("answer").join(ordered, key).where((F.col("rank") >= F.col("before") + F.col("skip")) & (F.col("rank") < F.col("before") + F.col("skip") + F.col("n")))
    hit = done.where("answer IS NOT NULL").select("__g", "q", "at", "rank", "answer").unionByName(found.select("__g", "q", "at", "rank", F.col("v").alias("answer")))
    part = F.col("at") - F.floor("at")
    weight = F.when(F.col("rank") == F.floor("at"), 1 - part).otherwise(part)
    # a weight of 0 leaves an infinite value out
    total = hit.groupBy("__g", "q").agg(F.sum(F.when(weight > 0, F.col("answer") * weight)).alias("value"))
    return total.select(*(F.col(f"__g.__k{i}").alias(c) for i, c in enumerate(by)), "q", "value")


def exceedance(generated: DataFrame, by: list[str], low: float = BT_MIN, high: float = BT_MAX, value: str = "v") -> DataFrame:
    """Shares of raw pixels below and above the range, and the raw extremes."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    out = generated.groupBy(*by).agg(share(F.col(value) < low).alias("below"), share(F.col(value) > high).alias("above"), F.min(value).alias("raw_min"), F.max(value).alias("raw_max"))
    return out.withColumn("total", F.col("below") + F.col("above"))


def histogram(values: DataFrame, by: list[str], value: str = "v", low: float = BT_MIN, high: float = BT_MAX, bins: int = 128) -> DataFrame:
    """by, bin (0 first) and p, the share of the values inside the range; every bin is there, the last is closed."""
    inside = values.where(F.col(value).between(low, high))
    at = F.least(F.width_bucket(F.col(value), F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)) - 1
    counts = inside.groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("c"))
    every = counts.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    full = every.join(counts, [*by, "bin"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    return full.select(*by, "bin", (F.col("c") / (F.sum("c").over(Window.partitionBy(*by)) + EPS)).alias("p"))


def histogram_centres(hist: DataFrame, low: float = BT_MIN, high: float = BT_MAX, bins: int = 128) -> DataFrame:
    return hist.withColumn("centre", F.lit(low) + (F.col("bin") + 0.5) * ((high - low) / bins))


def paired(hist: DataFrame, by: list[str], first: str = "real", second: str = "gen") -> DataFrame:
    """by, bin, a and b of the two sets' histograms."""
    a, b = (hist.where(F.col("set") == s).select(*by, "bin", F.col("p").alias(n)) for s, n in ((first, "a"), (second, "b")))
    return a.join(b, [*by, "bin"])


def js_divergence(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Jensen-Shannon divergence (natural logarithm); sums and logarithms are guarded by 1e-12."""
    total = lambda c: F.sum(c).over(Window.partitionBy(*by))
    norm = pairs.select(*by, (F.col("a") / (total("a") + EPS)).alias("a"), (F.col("b") / (total("b") + EPS)).alias("b"))
    m = (F.col("a") + F.col("b")) * 0.5
    part = lambda p: F.col(p) * (F.ln(F.col(p) + EPS) - F.ln(m + EPS))
    return norm.groupBy(*by).agg((F.sum(part("a")) * 0.5 + F.sum(part("b")) * 0.5).alias("js"))


def w1_distance(pairs: DataFrame, by: list[str], width: float = 1.0) -> DataFrame:
    """First Wasserstein distance of two histograms with bins of one width."""
    total = lambda c: F.sum(c).over(Window.partitionBy(*by))
    upto = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    norm = pairs.select(*by, "bin", (F.col("a") / (total("a") + EPS) - F.col("b") / (total("b") + EPS)).alias("d"))
    return norm.withColumn("g", F.abs(F.sum("d").over(upto))).groupBy(*by).agg((F.sum("g") * width).alias("w1"))


def cold_fraction(images: DataFrame, by: list[str], threshold: float = COLD) -> DataFrame:
    """Mean and spread over images of the share of pixels below the threshold."""
    share = F.size(F.filter("bt", lambda x: x < threshold)) / F.size("bt")
    return images.withColumn("__s", share).groupBy(*by).agg(F.avg("__s").alias("cold_mean"), F.stddev_pop("__s").alias("cold_std"))


FEATURES = ("radial_mean", "azimuthal_std", "log_power")


def image_curves(images: DataFrame, keys: list[str], n: int, r_bins: int = 96, theta_bins: int = 360, psd_bins: int = 96, curves: tuple[str, ...] = FEATURES) -> DataFrame:
    """keys and an array for each of ``curves`` of every n x n image: the radial mean and azimuthal spread by ring, and the
    logarithm of power by frequency. An image is one row, so each is a sum over fixed bins within the row (in Arrow
    batches): nothing is exploded and nothing shuffled. Empty bins are 0, or log10(1e-12); a null image has only such."""
    ring, sector = polar_bins(n, r_bins, theta_bins)
    cell = ring * theta_bins + sector
    in_ring, in_cell = np.bincount(ring, minlength=r_bins), np.bincount(cell, minlength=r_bins * theta_bins).reshape(r_bins, theta_bins)
    filled, sectors = in_cell > 0, (in_cell > 0).sum(1)
    of = np.array(_shifted_bins(n, psd_bins)) if "log_power" in curves else np.zeros(0, int)
    in_band = np.bincount(of, minlength=psd_bins)

    def radial_mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(ring, weights=x, minlength=r_bins) / (in_ring + EPS)

    def azimuthal_std(x: np.ndarray) -> np.ndarray:
        means = np.where(filled, np.bincount(cell, weights=x, minlength=r_bins * theta_bins).reshape(r_bins, theta_bins) / (in_cell + EPS), 0.0)
        centre = means.sum(1) / np.maximum(sectors, 1)
        return np.where(sectors < 2, 0.0, np.sqrt((np.where(filled, means - centre[:, None], 0.0) ** 2).sum(1) / np.maximum(sectors, 1)))

    def log_power(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.fft2(x.reshape(n, n) - x.mean())) ** 2
        return np.log10(np.bincount(of, weights=power.ravel(), minlength=psd_bins) / (in_band + EPS) + EPS)

    made = {"radial_mean": radial_mean, "azimuthal_std": azimuthal_std, "log_power": log_power}
    schema = T.StructType([images.schema[k] for k in keys] + [T.StructField(c, T.ArrayType(T.DoubleType())) for c in curves])
    nothing = np.zeros(n * n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [np.asarray(v.values, float) if v.is_valid and len(v.values) else nothing for v in batch.column("bt")]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), *(pa.array([made[c](x) for x in rows], pa.list_(pa.float64())) for c in curves)], [*keys, *curves])

    return images.select(*keys, "bt").mapInArrow(run, schema)


def profiles(images: DataFrame, keys: list[str], n: int, r_bins: int = 96, theta_bins: int = 360) -> DataFrame:
    """keys, rbin, radial_mean and azimuthal_std of each image; empty bins are 0."""
    curves = image_curves(images, keys, n, r_bins, theta_bins, curves=FEATURES[:2])
    rows = curves.select(*keys, F.posexplode(F.arrays_zip("radial_mean", "azimuthal_std")).alias("rbin", "v"))
    return rows.select(*keys, "rbin", "v.radial_mean", "v.azimuthal_std")


def curve_stats(curves: DataFrame, by: list[str], bin_: str, value: str) -> DataFrame:
    """Mean and spread over images of each bin."""
    return curves.groupBy(*by, bin_).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"))


def eye_bins(r_bins: int, inner: float = 0.12, ring: float = 0.25) -> tuple[int, int, int]:
    """Bins below the first number are the eye; the ring is [second, third)."""
    centre, half = int(math.floor(ring * r_bins)), max(2, int(math.floor(0.05 * r_bins)))
    return max(1, int(math.floor(inner * r_bins))), max(0, centre - half), min(r_bins, centre + half)


def eye_contrast(curves: DataFrame, keys: list[str], r_bins: int) -> DataFrame:
    """keys and eye_contrast: mean of the inner bins less the minimum over the ring."""
    inner, low, high = eye_bins(r_bins)
    inside, ring = F.col("rbin") < inner, (F.col("rbin") >= low) & (F.col("rbin") < high)
    return curves.groupBy(*keys).agg((F.avg(F.when(inside, F.col("radial_mean"))) - F.min(F.when(ring, F.col("radial_mean")))).alias("eye_contrast"))


def mean_and_spread(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    return rows.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))


def _shifted_bins(n: int, bins: int) -> list[int]:
    """Radial bin of each frequency (row-major, zero first) after the zero frequency is moved to n / 2."""
    half, c = n // 2, (n - 1) / 2
    r_max = math.hypot(c, c)
    out = []
    for ky in range(n):
        for kx in range(n):
            y, x = (ky + half) % n - c, (kx + half) % n - c
            out.append(min(int(math.hypot(y, x) / (r_max + EPS) * bins), bins - 1))
    return out


def psd_relational(images: DataFrame, keys: list[str], n: int, bins: int = 96) -> DataFrame:
    """keys, kbin and log_power by row and column transforms as array expressions (no Python), for small images."""
    spark_pi = 2 * math.pi / n
    cos_t = F.array(*[F.lit(math.cos(spark_pi * k)) for k in range(n)])
    sin_t = F.array(*[F.lit(math.sin(spark_pi * k)) for k in range(n)])
    span = F.sequence(F.lit(0), F.lit(n - 1))
    rows = images.select(*keys, F.transform("bt", lambda x: x).alias("bt")).withColumn("m", F.aggregate("bt", F.lit(0.0), lambda a, x: a + x) / F.size("bt"))
    # rows first: for each row y and frequency kx
    dot = lambda table, sign: lambda y, k: F.aggregate(span, F.lit(0.0), lambda a, x: a + (F.element_at("bt", y * n + x + 1) - F.col("m")) * F.element_at(table, (x * k) % n + 1) * F.lit(sign))
    grid = lambda f: F.flatten(F.transform(span, lambda y: F.transform(span, lambda k: f(y, k))))
    rows = rows.withColumns({"re": grid(dot(cos_t, 1.0)), "im": grid(dot(sin_t, -1.0))})

    def power(ky: Column, kx: Column) -> Column:
        cs, sn = (lambda y: F.element_at(cos_t, (y * ky) % n + 1)), (lambda y: F.element_at(sin_t, (y * ky) % n + 1))
        at = lambda c, y: F.element_at(c, y * n + kx + 1)
        re = F.aggregate(span, F.lit(0.0), lambda a, y: a + at("re", y) * cs(y) + at("im", y) * sn(y))
        im = F.aggregate(span, F.lit(0.0), lambda a, y: a + at("im", y) * cs(y) - at("re", y) * sn(y))
        return re * re + im * im

    rows = rows.select(*keys, F.posexplode(grid(power)).alias("k", "power"))
    of = F.array(*[F.lit(b) for b in _shifted_bins(n, bins)])
    return rows.groupBy(*keys, F.element_at(of, F.col("k") + 1).alias("kbin")).agg(F.log10(F.sum("power") / (F.count(F.lit(1)) + EPS) + EPS).alias("log_power"))


def psd(images: DataFrame, keys: list[str], n: int, bins: int = 96) -> DataFrame:
    """keys and log_power (array of ``bins``, empty bins at log10(1e-12)) by an Arrow-batched fast transform."""
    return image_curves(images, keys, n, psd_bins=bins, curves=("log_power",))


def diversity_features(curves: DataFrame, by: list[str], key: str, dim: str, value: str) -> DataFrame:
    """by, key, dim, z: each dimension scaled to mean 0 and spread 1 within its own set (spread + 1e-12)."""
    stats = curves.groupBy(*by, dim).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"))
    return curves.join(stats, [*by, dim]).select(*by, key, dim, ((F.col(value) - F.col("m")) / (F.col("s") + EPS)).alias("z"))


def standardized(vectors: DataFrame, by: list[str], key: str, x: str) -> DataFrame:
    """by, key and ``z``: arrays of one length with each dimension scaled to mean 0 and spread 1 within its own set. The
    means and spreads are partial aggregates of a row a set; the arrays stay where they are."""
    parts = vectors.select(*by, F.posexplode(x).alias("__d", "__v")).groupBy(*by, "__d").agg(F.avg("__v").alias("m"), F.stddev_pop("__v").alias("s"))
    sets = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__d", "m", "s"))).alias("__sets"))  # a set's dimensions: fixed
    scale = F.zip_with(x, "__sets", lambda v, d: (v - d["m"]) / (d["s"] + EPS))
    return vectors.join(sets, by).select(*by, key, scale.alias("z"))


def _squared(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pair_distances(left: DataFrame, right: DataFrame, by: list[str], key: str) -> DataFrame:
    """by, ka, kb, d2 of all pairs of a class's items: a comparison of two stated evaluation sets, joined by class."""
    a = left.select(*by, F.col(key).alias("ka"), F.col("z").alias("za"))
    b = right.select(*by, F.col(key).alias("kb"), F.col("z").alias("zb"))
    return a.join(b, by).select(*by, "ka", "kb", _squared("za", "zb").alias("d2"))


BLOCK_ROWS = 1000


def block_sums(left: DataFrame, right: DataFrame, by: list[str], key: str, what: str) -> DataFrame:
    """by, s, n: over all pairs of an item of ``left`` and one of ``right`` with another key, the sum of their
    distances (``what`` "distance") or of exp(-gamma d2) ("kernel"; then both have a column gamma), and their number.

    Items are dealt into blocks of about ``BLOCK_ROWS`` by a hash of their key, and every two blocks meet in one
    task as two matrices, so work is spread over (items / BLOCK_ROWS)^2 tasks a class and no pair becomes a row.
    ``right`` may be ``left``: then a pair of blocks meets once and counts for both directions.
    """
    same = left is right
    extra = ["gamma"] if what == "kernel" else []

    def dealt(rows: DataFrame, side: int) -> DataFrame:
        count = rows.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("__blocks"))
        kept = rows.select(*by, F.col(key).cast("string").alias("__k"), F.col("z").alias("__z"), *extra, F.lit(side).alias("__side"))
        return kept.join(count, by).withColumn("__b", F.pmod(F.xxhash64("__k"), F.col("__blocks")).cast("int"))

    l, r = dealt(left, 0), dealt(right, 1)
    other = lambda rows, blocks: rows.join(blocks.groupBy(*by).agg(F.max("__blocks").alias("__others")), by).withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__others") - 1)))
    a, b = other(l, r).select("*", F.col("__b").alias("__i"), F.col("__o").alias("__j")), other(r, l).select("*", F.col("__o").alias("__i"), F.col("__b").alias("__j"))
    if same:
        a, b = a.where("__i <= __j"), b.where("__i <= __j")
    kinds = {f.name: f.dataType.simpleString() for f in left.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in by), "s double", "n long"])

    def sums(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("__side"))
        names = np.array(table.column("__k").to_pylist(), object)
        z = np.array(table.column("__z").to_pylist(), float).reshape(len(side), -1)
        x, y, nx, ny = z[side == 0], z[side == 1], names[side == 0], names[side == 1]
        total, pairs = 0.0, 0
        gamma = table.column("gamma")[0].as_py() if extra else 0.0
        for at in range(0, len(x), 128):
            d2 = ((x[at : at + 128, None, :] - y[None, :, :]) ** 2).sum(2)
            other_key = nx[at : at + 128, None] != ny[None, :]
            value = np.exp(-gamma * d2) if extra else np.sqrt(d2)
            total, pairs = total + float(value[other_key].sum()), pairs + int(other_key.sum())
        times = 2 if same and table.column("__i")[0].as_py() != table.column("__j")[0].as_py() else 1
        return pa.table({**{c: table.column(c).slice(0, 1) for c in by}, "s": [times * total], "n": pa.array([times * pairs], pa.int64())})

    columns = [*by, "__i", "__j", "__side", "__k", "__z", *extra]
    met = a.select(*columns).unionAll(b.select(*columns)).groupBy(*by, "__i", "__j").applyInArrow(sums, schema)
    return met.groupBy(*by).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def mean_pair_distance(vectors: DataFrame, by: list[str], key: str) -> DataFrame:
    """Mean distance of different items; 0 below two items."""
    sums = block_sums(vectors, vectors, by, key, "distance").select(*by, F.when(F.col("n") > 0, F.col("s") / F.col("n")).alias("d"))
    return vectors.select(*by).distinct().join(sums, by, "left").select(*by, F.coalesce("d", F.lit(0.0)).alias("mean_distance"))


def mmd2(real: DataFrame, gen: DataFrame, by: list[str], key: str, most: int = 200) -> DataFrame:
    """Unbiased kernel discrepancy of two sets: within-sums off the diagonal over n (n - 1), less twice the mean
    across. The kernel's width comes from the median squared distance (of distances above 0) among at most ``most``
    pooled items in a seeded order, the method's own bound."""
    from gridloom.functions.scalar import seeded

    pool = real.select(*by, F.concat(F.lit("r"), F.col(key).cast("string")).alias("k"), "z").unionByName(gen.select(*by, F.concat(F.lit("g"), F.col(key).cast("string")).alias("k"), "z"))
    pool = pool.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(seeded(0, "k"), "k"))).where(F.col("__r") <= most).drop("__r")
    near = pair_distances(pool, pool, by, "k").where((F.col("ka") < F.col("kb")) & (F.col("d2") > 0))  # a pair once: the same median
    # at most most * most distances a class, so the built-in median's memory is bounded
    gamma = near.groupBy(*by).agg((F.lit(1.0) / (2.0 * (F.percentile("d2", 0.5) + EPS))).alias("gamma"))
    gamma = written(gamma, "gamma")  # a row a class, used by every block
    r, g = real.select(*by, key, "z").join(gamma, by), gen.select(*by, key, "z").join(gamma, by)
    # items of the two sets that share a key are a pair across, so keys are told apart there
    tagged = lambda rows, tag: rows.withColumn(key, F.concat(F.lit(tag), F.col(key).cast("string")))
    kernel = lambda a, b, name: block_sums(a, b, by, key, "kernel").select(*by, F.col("s").alias(name))
    counts = real.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).join(gen.groupBy(*by).agg(F.count(F.lit(1)).alias("m")), by)
    sums = counts.join(kernel(r, r, "rr"), by, "left").join(kernel(g, g, "gg"), by, "left").join(kernel(tagged(r, "r"), tagged(g, "g"), "rg"), by, "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    value = z("rr") / (F.col("n") * (F.col("n") - 1) + EPS) + z("gg") / (F.col("m") * (F.col("m") - 1) + EPS) - 2 * z("rg") / (F.col("n") * F.col("m"))
    return sums.select(*by, value.alias("mmd2"))


def pearson(x: str | Column, y: str | Column) -> Column:
    """Correlation; null below two rows or without variance."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    return F.when(F.count(F.lit(1)) >= 2, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def macro(per_class: DataFrame, name: str, real: str, gen: str) -> DataFrame:
    """One row: correlations of the class number with either set and of the sets, and their mean absolute difference."""
    c = F.col("class").cast("double")
    return per_class.agg(pearson(c, real).alias("corr_class_real"), pearson(c, gen).alias("corr_class_gen"), pearson(real, gen).alias("corr_real_gen"), F.avg(F.abs(F.col(real) - F.col(gen))).alias("mae")).withColumn("metric", F.lit(name))


def shared_limits(values: DataFrame, value: str = "v") -> DataFrame:
    """One row low, high: the finite extremes; (0, 1) if there is none, padded if they are equal."""
    finite = values.where(~F.isnan(value) & (F.abs(F.col(value)) != float("inf"))).agg(F.min(value).alias("a"), F.max(value).alias("b"))
    pad = F.when(F.col("a") == 0, 0.5).otherwise(F.greatest(F.lit(0.5), F.abs("a") * 0.01))
    low = F.when(F.col("a").isNull(), 0.0).when(F.col("a") == F.col("b"), F.col("a") - pad).otherwise(F.col("a"))
    high = F.when(F.col("a").isNull(), 1.0).when(F.col("a") == F.col("b"), F.col("b") + pad).otherwise(F.col("b"))
    return finite.select(low.alias("low"), high.alias("high"))


def compare_grid(images: DataFrame, n: int) -> DataFrame:
    """The first images of each class and set by id, with their place in the grid: as many of either set as both
    have, ``n`` at most."""
    if n <= 0:
        raise ValueError("n must be positive")
    counts = images.groupBy("class").agg(F.count_if(F.col("set") == "real").alias("__r"), F.count_if(F.col("set") == "gen").alias("__g"))
    order = Window.partitionBy("class", "set").orderBy("id")
    placed = images.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < n)
    return placed.join(F.broadcast(counts), "class").where(F.col("place") < F.least("__r", "__g")).drop("__r", "__g")  # a row per class


def report(per_class: DataFrame, metrics: list[str]) -> DataFrame:
    """One row ``value``: the report as JSON, a class per entry (a handful of rows)."""
    body = F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("class").cast("string").alias("k"), F.struct(*metrics).alias("v")))))
    return per_class.agg(F.to_json(F.struct(body.alias("per_class"))).alias("value"))
