"""The evaluation suite: every number and curve of a comparison of observed and generated images, from one written scan.

Images (class, set "real" or "gen", id, bt in kelvin; generated ones raw) are picked and written once. Pixels feed the
statistics and histograms as partial aggregates, images feed the curves within their rows, and curves, of a fixed
size an image, feed everything else. Results are rows: (class, key, value) and (class, curve, bin, value); ``document``
puts the few rows of all classes together as one JSON text.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.images import BT_MAX, BT_MIN, COLD
from gridloom.functions.scalar import seeded
from gridloom.operators import metrics
from gridloom.session import written

SETS = ("real", "gen")
# The quantiles that are reported, and the bins of the histogram.
QUANTILES = {"q01": 0.01, "q05": 0.05, "q50": 0.5, "q95": 0.95, "q99": 0.99}
HIST_BINS, SECTORS = 128, 360


def picked(images: DataFrame, n_per_class: int | None, seed: int) -> DataFrame:
    """Up to so many observed images of each class in a seeded order and the first generated ones by id (None: all), of
    classes that have both."""
    rows = images.select("class", "set", "id", F.col("bt").cast("array<double>").alias("bt")).where(F.col("set").isin(*SETS))
    if n_per_class is not None:
        if n_per_class <= 0:
            raise ValueError("n_per_class must be positive")
        # ranks of narrow rows: arrays don't take part in the sort
        order = rows.select("class", "set", "id").withColumn("__at", F.when(F.col("set") == "real", seeded(seed, "id")).otherwise(F.format_string("%020d", F.col("id").cast("long"))))
        rank = F.row_number().over(Window.partitionBy("class", "set").orderBy("__at", "id"))
        kept = order.withColumn("__r", rank).where(F.col("__r") <= n_per_class)  # higher ranks are cut before the shuffle
        rows = rows.join(kept.select("class", "set", "id"), ["class", "set", "id"])
    both = rows.groupBy("class").agg(F.countDistinct("set").alias("__n")).where("__n = 2").select("class")
    return rows.join(F.broadcast(both), "class")  # a row a class


def _rows(df: DataFrame, values: dict[str, str | Column]) -> DataFrame:
    """class, key and value, a row for each of the named columns."""
    items = [F.struct(F.lit(k).alias("key"), (F.col(c) if isinstance(c, str) else c).cast("double").alias("value")) for k, c in values.items()]
    return df.select("class", F.explode(F.array(*items)).alias("x")).select("class", "x.key", "x.value")


def _both(df: DataFrame, prefix: str, *columns: str) -> DataFrame:
    """A row a class and set as keys ``prefix`` real_ or gen_ and the column."""
    return df.select("class", F.explode(F.array(*[F.struct(F.concat(F.lit(prefix), "set", F.lit(f"_{c}")).alias("key"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("class", "x.key", "x.value")


def suite(images: DataFrame, side: int, n_per_class: int | None = None, profile_bins: int = 96, psd_bins: int = 96, sectors: int = SECTORS, seed: int = 123) -> tuple[DataFrame, DataFrame]:
    """The numbers (class, key, value; those over all classes have a null class) and the curves (class, curve, bin, value)."""
    keys = ["class", "set", "id"]
    images = written(picked(images, n_per_class, seed), "evaluated")
    clip = lambda v: F.least(F.greatest(v, F.lit(BT_MIN)), F.lit(BT_MAX))
    clipped = images.withColumn("bt", F.when(F.col("set") == "gen", F.transform("bt", clip)).otherwise(F.col("bt")))

    pixel = images.select("class", "set", F.explode("bt").alias("v"))
    kind = lambda name, v: F.struct(F.lit(name).alias("kind"), v.alias("v"))
    kinds = pixel.select("class", F.explode(F.when(F.col("set") == "real", F.array(kind("real", F.col("v")))).otherwise(F.array(kind("gen_raw", F.col("v")), kind("gen_clipped", clip(F.col("v")))))).alias("x")).select("class", "x.kind", "x.v")
    by = ["class", "kind"]
    stats = metrics.moments(kinds, by).join(kinds.groupBy(*by).agg(F.min("v").alias("low"), F.max("v").alias("high")), by)
    level = F.element_at(F.map_from_arrays(F.array(*[F.lit(q) for q in QUANTILES.values()]), F.array(*[F.lit(n) for n in QUANTILES])), F.col("q"))
    shares = metrics.quantiles(kinds, by, "v", list(QUANTILES.values())).select(*by, level.alias("name"), "value")
    named = {"mean": "mean", "std": "std", "skew": "skew", "kurtosis": "kurt", "min": "low", "max": "high"}
    stats = stats.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).alias("value")) for n, c in named.items()])).alias("x")).select(*by, "x.name", "x.value")
    stats = stats.unionByName(shares).select("class", F.concat(F.lit("pixel_stats."), "kind", F.lit("."), "name").alias("key"), "value")
    over = metrics.exceedance(pixel.where("set = 'gen'"), ["class"])
    over = _rows(over, {f"gen_exceedance_rate.{k}": c for k, c in (("below_bt_min", "below"), ("above_bt_max", "above"), ("total", "total"), ("raw_min", "raw_min"), ("raw_max", "raw_max"))})

    inside = kinds.where("kind <> 'gen_raw'").select("class", F.when(F.col("kind") == "real", "real").otherwise("gen").alias("set"), "v")
    hist = written(metrics.histogram(inside, ["class", "set"], bins=HIST_BINS), "histograms")
    pairs = metrics.paired(hist, ["class"])
    gaps = _rows(metrics.js_divergence(pairs, ["class"]), {"pixel_hist_js": "js"}).unionByName(_rows(metrics.w1_distance(pairs, ["class"], (BT_MAX - BT_MIN) / HIST_BINS), {"pixel_hist_w1": "w1"}))

    curves = written(metrics.image_curves(clipped, keys, side, profile_bins, sectors, psd_bins), "curves")
    cold = metrics.cold_fraction(clipped, ["class", "set"], COLD).withColumnsRenamed({"cold_mean": "mean", "cold_std": "std"})
    inner, low, high = metrics.eye_bins(profile_bins)
    eye = F.aggregate(F.slice("radial_mean", 1, inner), F.lit(0.0), lambda a, x: a + x) / inner - F.array_min(F.slice("radial_mean", low + 1, high - low))
    eye = metrics.mean_and_spread(curves.withColumn("eye", eye), ["class", "set"], "eye")
    vectors = written(metrics.standardized(curves.select(*keys, F.concat("radial_mean", "log_power").alias("x")), ["class", "set"], "id", "x"), "vectors")
    spread = metrics.mean_pair_distance(vectors, ["class", "set"], "id").select("class", F.concat(F.lit("diversity_feature_space."), "set").alias("key"), F.col("mean_distance").alias("value"))
    mmd = metrics.mmd2(vectors.where("set = 'real'").drop("set"), vectors.where("set = 'gen'").drop("set"), ["class"], "id")

    long = curves.select("class", "set", F.explode(F.array(*[F.struct(F.lit(n).alias("curve"), F.col(c).alias("xs")) for n, c in (("radial_mean", "radial_mean"), ("radial_azstd", "azimuthal_std"), ("psd", "log_power"))])).alias("c"))
    long = long.select("class", "set", "c.curve", F.posexplode("c.xs").alias("bin", "value"))
    bands = written(metrics.curve_stats(long, ["class", "set", "curve"], "bin", "value"), "bands")
    mean = bands.where("curve = 'psd'").select("class", "set", "bin", F.col("mu").alias("p"))
    psd = metrics.paired(mean, ["class"]).groupBy("class").agg(F.avg((F.col("a") - F.col("b")) * (F.col("a") - F.col("b"))).alias("v"))

    numbers = over.unionByName(stats).unionByName(gaps).unionByName(_both(cold, "cold_cloud_fraction_200K.", "mean", "std")).unionByName(_both(eye, "eye_contrast_proxy.", "mean", "std"))
    numbers = written(numbers.unionByName(_rows(psd, {"psd_l2": "v"})).unionByName(_rows(mmd, {"feature_mmd2": "mmd2"})).unionByName(spread), "numbers")

    def macro(name: str, real: str, gen: str) -> DataFrame:
        one = numbers.where(F.col("key").isin(real, gen)).groupBy("class").agg(F.max(F.when(F.col("key") == real, F.col("value"))).alias("r"), F.max(F.when(F.col("key") == gen, F.col("value"))).alias("g"))
        row = metrics.macro(one, name, "r", "g").withColumnRenamed("mae", "mae_gen_vs_real").withColumn("class", F.lit(None).cast(images.schema["class"].dataType))
        return _rows(row, {f"macro.{name}.{c}": c for c in ("corr_class_real", "corr_class_gen", "corr_real_gen", "mae_gen_vs_real")})

    all_ = numbers.unionByName(macro("pixel_mean_bt", "pixel_stats.real.mean", "pixel_stats.gen_raw.mean")).unionByName(macro("eye_contrast_proxy", "eye_contrast_proxy.real_mean", "eye_contrast_proxy.gen_mean"))
    edges = images.select("class").distinct().select("class", F.lit("bt_bins").alias("curve"), F.posexplode(F.array(*[F.lit(BT_MIN + i * (BT_MAX - BT_MIN) / HIST_BINS) for i in range(HIST_BINS + 1)])).alias("bin", "value"))
    drawn = bands.select("class", "bin", F.explode(F.array(*[F.struct(F.concat("curve", F.lit("_"), "set", F.lit(f"_{s}")).alias("curve"), F.col(s).alias("value")) for s in ("mu", "sd")])).alias("x")).select("class", "x.curve", "bin", "x.value")
    return all_, edges.unionByName(hist.select("class", F.concat(F.lit("hist_"), "set").alias("curve"), "bin", F.col("p").alias("value"))).unionByName(drawn)


def document(numbers: DataFrame, about: dict) -> str:
    """The report as JSON: about sixty numbers a class, and those over all classes."""
    tree: dict = {**about, "macro": {}, "per_class": {}}
    for r in sorted(numbers.collect(), key=lambda r: (r["class"] is not None, str(r["class"]), r.key)):
        at = tree if r["class"] is None else tree["per_class"].setdefault(str(r["class"]), {})
        *path, last = r.key.split(".")
        for p in path:
            at = at.setdefault(p, {})
        at[last] = None if r.value is not None and math.isnan(r.value) else r.value
    return json.dumps(tree)
