"""Queries by name over the test tables: name to (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import images as im
from gridloom.functions import scalar as sc
from gridloom.operators import blocks, catalog, diffusion, evaluation, feed, history, layers, metrics, sampling, storms
from gridloom.plans import bindings as b
from gridloom.session import table_path, written
from gridloom.sources import files, netcdf, packed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SEED = 42


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: sc.round6(c, digits) for c in columns})


def exploded(df: DataFrame, keys: list[str], array: str, name: str = "v") -> DataFrame:
    """A row for each element. The outer form: before the plain one the optimizer puts a filter on the array's size and
    another on null, each of which computes the array again."""
    return rounded(df.select(*keys, F.posexplode_outer(array).alias("i", name)).where("i IS NOT NULL"), name)


# Catalogue


@query
def class_index_counts(spark, sf):
    return catalog.class_counts(b.index(spark, sf))


@query
def index_meta(spark, sf):
    return catalog.index_meta(b.snapshots(spark, sf))


@query
def index_idx_prefix(spark, sf):
    rows = b.snapshots(spark, sf).select("rel_path", sc.index_prefix("rel_path").alias("idx"), sc.index_prefix(F.concat(F.lit("x"), F.col("rel_path"))).alias("bad"))
    return rows.select("rel_path", "idx", F.col("bad").isNull().alias("unparsable"))


@query
def wind_fallback(spark, sf):
    index = b.index(spark, sf)
    meta = index.where(F.substring(F.md5(F.col("rel_path").cast("binary")), 1, 1) < "8").select("rel_path", "wmo_wind_kt")
    return rounded(catalog.wind_fallback(index, meta), "wind_kt")


@query
def packed_layout(spark, sf):
    return catalog.manifest(catalog.pack(b.index(spark, sf), 512))


@query
def shard_lookup(spark, sf):
    packed = written(catalog.pack(b.index(spark, sf), 512), "packed")
    wanted = packed.select("global_index", "rel_path")
    return catalog.find_shards(wanted, catalog.manifest(packed)).select("global_index", "rel_path", "shard_id", "start", "stop")


@query
def pack_validation(spark, sf):
    packed = written(catalog.pack(b.index(spark, sf), 512), "packed")
    return catalog.validate_pack(packed, catalog.manifest(packed), packed.count())


@query
def point_lookup(spark, sf):
    wanted = b.index(spark, sf).select("rel_path")
    return rounded(catalog.look_up(b.index(spark, sf), wanted, strict=True).select("rel_path", "ss_cat", "wmo_wind_kt"), "wmo_wind_kt")


@query
def packed_missing(spark, sf):
    return catalog.packed_missing(b.table(spark, sf, "documents"), b.table(spark, sf, "labels"), "doc_id")


@query
def label_mismatches(spark, sf):
    docs = b.table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 1000, 1).otherwise(0).alias("packed_label"))
    return catalog.label_mismatches(docs, b.table(spark, sf, "labels").withColumnRenamed("quality", "index_label"), "doc_id", "packed_label", "index_label")


@query
def array_max_abs_diff(spark, sf):
    x = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("a"), F.transform("embedding", lambda v: F.round(v.cast("double"), 2)).alias("b"))
    picked = catalog.sample_for_check(x, 256, SEED, "vec_id")
    return rounded(picked.select("vec_id", catalog.array_max_abs_diff(picked, "a", "b").alias("max_diff")), "max_diff")


# Storms


@query
def storm_table(spark, sf):
    return rounded(storms.storm_table(b.tracks(spark, sf)), "MAX_WMO_WIND")


@query
def strata_counts(spark, sf):
    return storms.strata_counts(storms.storm_table(b.tracks(spark, sf)))


@query
def stratified_group_split(spark, sf):
    return storms.split_storms(storms.storm_table(b.tracks(spark, sf)))


def _mapped(spark, sf):
    return storms.files_by_index(b.tracks(spark, sf), b.track_files(spark, sf))


def _files(spark, sf):
    mapped = _mapped(spark, sf)
    return mapped.where("rel_path is not null"), storms.split_files(mapped, storms.split_storms(storms.storm_table(b.tracks(spark, sf))))


@query
def idx_mapping(spark, sf):
    return storms.mapping_counts(_mapped(spark, sf))


@query
def split_files(spark, sf):
    return _files(spark, sf)[1].select("rel_path", "split")


@query
def split_summary(spark, sf):
    return storms.split_summary(*_files(spark, sf))


@query
def split_basin_counts(spark, sf):
    return storms.split_counts(*_files(spark, sf), "BASIN")


@query
def split_class_counts(spark, sf):
    return storms.split_counts(*_files(spark, sf), "SS_CAT")


@query
def split_semi(spark, sf):
    _, files = _files(spark, sf)
    index = b.track_files(spark, sf)
    return sampling.in_split(index, files, "val").agg(F.count(F.lit(1)).alias("n"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))


# Sampling


@query
def class_sampling_probs(spark, sf):
    return rounded(sampling.class_probabilities(b.index(spark, sf), 0.4), "prob")


@query
def set_probs(spark, sf):
    p = sampling.class_probabilities(b.index(spark, sf), 1.0)
    return rounded(sampling.set_probabilities(p.withColumn("prob", F.when(F.col("ss_cat") != 2, F.col("prob")).otherwise(0.0))), "prob")


@query
def alpha_ramp(spark, sf):
    """Days of the events as epochs, with the weight of either ramp and the events that it would draw."""
    e = b.table(spark, sf, "events")
    days = e.groupBy(F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    epochs = days.crossJoin(F.broadcast(days.agg(F.min("day").alias("first")))).select((F.col("day") - F.col("first")).alias("epoch"), "n")  # one row
    cosine = epochs.select("epoch", "n", sampling.ramp_value("epoch").alias("alpha"), F.lit("cosine").alias("mode"))
    return rounded(cosine.unionAll(epochs.select("epoch", "n", sampling.ramp_value("epoch", first=5, ramp=20, mode="linear"), F.lit("linear"))), "alpha")


@query
def balanced_fixed_subset(spark, sf):
    return sampling.per_class(b.index(spark, sf), 5, SEED).select("rel_path", "ss_cat")


@query
def real_sample(spark, sf):
    images = b.raw_images(spark, sf).where("set = 'real'").select("class", "id")
    return sampling.per_class(images, 25, 123, "id", "class")


@query
def weighted_draws(spark, sf):
    return sampling.weighted_draws(b.index(spark, sf), 2000, 0.4, SEED)


@query
def augment_gate(spark, sf):
    index = b.index(spark, sf).join(F.broadcast(im.augment_policy(spark)), "ss_cat")  # six rows
    return index.withColumn("hit", sampling.gate("p_aug", SEED, "rel_path")).groupBy("ss_cat").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("n_augmented"), F.max("max_shift").alias("max_shift"), F.max("max_bars").alias("max_bars"))


@query
def augment_policy(spark, sf):
    """The policy of four classes, with the images of each."""
    images = b.table(spark, sf, "embeddings").groupBy((F.col("label") % 4).cast("int").alias("ss_cat")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(images.join(F.broadcast(im.augment_policy(spark, 4)), "ss_cat"), "p_aug")  # four rows


@query
def cond_dropout(spark, sf):
    rows = b.index(spark, sf).select("rel_path", F.col("ss_cat").alias("label"), F.col("wmo_wind_kt").alias("wind_kt"))
    return rounded(sampling.dropped_condition(rows, 0.1, SEED, "rel_path"), "wind_kt")


# Images


@query
def bt_normalize(spark, sf):
    return exploded(b.raw_images(spark, sf).select("id", im.normalize("bt").alias("x")), ["id"], "x")


@query
def bt_denormalize(spark, sf):
    return exploded(b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), im.denormalize("embedding").alias("x")), ["id"], "x")


@query
def bt_eval_clean(spark, sf):
    dirty = b.raw_images(spark, sf).select("id", F.transform("bt", lambda x, i: F.when(i == 0, float("nan")).when(i == 1, float("inf")).when(i == 2, float("-inf")).otherwise(x)).alias("bt"))
    return exploded(dirty.select("id", im.eval_clean("bt").alias("x")), ["id"], "x")


@query
def pixel_moments(spark, sf):
    return rounded(metrics.moments(im.pixels(b.raw_images(spark, sf)), ["class", "set"]), "mean", "std", "skew", "kurt")


@query
def pixel_quantiles(spark, sf):
    return rounded(metrics.quantiles(im.pixels(b.raw_images(spark, sf)), ["class", "set"], "v", [0.01, 0.05, 0.5, 0.95, 0.99]), "value")


@query
def price_quantiles(spark, sf):
    return rounded(metrics.quantiles(b.table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice", [0.0, 0.01, 0.5, 0.99, 1.0]), "value", digits=4)


@query
def gen_exceedance(spark, sf):
    gen = im.pixels(b.raw_images(spark, sf).where("set = 'gen'"))
    return rounded(metrics.exceedance(gen, ["class"]), "below", "above", "raw_min", "raw_max", "total")


@query
def cold_fraction(spark, sf):
    return rounded(metrics.cold_fraction(b.clipped_images(spark, sf), ["class", "set"]), "cold_mean", "cold_std")


def _hist(spark, sf):
    return metrics.histogram(im.pixels(b.clipped_images(spark, sf)), ["class", "set"])


@query
def bt_histogram(spark, sf):
    return rounded(metrics.histogram_centres(_hist(spark, sf)), "p", "centre")


@query
def hist_js(spark, sf):
    return rounded(metrics.js_divergence(metrics.paired(_hist(spark, sf), ["class"]), ["class"]), "js")


@query
def hist_w1(spark, sf):
    return rounded(metrics.w1_distance(metrics.paired(_hist(spark, sf), ["class"]), ["class"], 130 / 128), "w1")


def _curves(spark, sf):
    return metrics.profiles(b.clipped_images(spark, sf), ["class", "set", "id"], b.SIDE, b.R_BINS, b.THETA_BINS)


@query
def radial_profile(spark, sf):
    return rounded(_curves(spark, sf).select("class", "set", "id", "rbin", "radial_mean"), "radial_mean")


@query
def azimuthal_std(spark, sf):
    return rounded(_curves(spark, sf).select("class", "set", "id", "rbin", "azimuthal_std"), "azimuthal_std")


@query
def profile_stats(spark, sf):
    return rounded(metrics.curve_stats(_curves(spark, sf), ["class", "set"], "rbin", "radial_mean"), "mu", "sd")


@query
def eye_contrast(spark, sf):
    one = metrics.eye_contrast(_curves(spark, sf), ["class", "set", "id"], b.R_BINS)
    return rounded(metrics.mean_and_spread(one, ["class", "set"], "eye_contrast"), "mean", "std")


def _spectra(spark, sf):
    return metrics.psd_relational(b.clipped_images(spark, sf), ["class", "set", "id"], b.SIDE, b.PSD_BINS)


@query
def psd_radial(spark, sf):
    return rounded(_spectra(spark, sf), "log_power", digits=5)


@query
def psd_arrow(spark, sf):
    spectra = metrics.psd(b.clipped_images(spark, sf), ["class", "set", "id"], b.SIDE, b.PSD_BINS)
    return rounded(spectra.select("class", "set", "id", F.posexplode("log_power").alias("kbin", "log_power")), "log_power", digits=5)


@query
def psd_stats(spark, sf):
    """Mean and spread of spectra by frequency: the bands of the spectrum's figure."""
    spectra = metrics.psd(b.clipped_images(spark, sf), ["class", "set", "id"], b.SIDE, b.PSD_BINS).select("class", "set", F.posexplode("log_power").alias("kbin", "log_power"))
    return rounded(metrics.curve_stats(spectra, ["class", "set"], "kbin", "log_power"), "mu", "sd", digits=5)


@query
def psd_l2(spark, sf):
    mean = metrics.curve_stats(_spectra(spark, sf), ["class", "set"], "kbin", "log_power")
    pairs = metrics.paired(mean.withColumnsRenamed({"kbin": "bin", "mu": "p"}), ["class"])
    return rounded(pairs.groupBy("class").agg(F.avg(F.pow(F.col("a") - F.col("b"), F.lit(2.0))).alias("psd_l2")), "psd_l2")


def _vectors(spark, sf):
    """One standardized array an image: its radial means, then its spectrum."""
    keys = ["class", "set", "id"]
    curves = metrics.image_curves(b.clipped_images(spark, sf), keys, b.SIDE, b.R_BINS, b.THETA_BINS, b.PSD_BINS, ("radial_mean", "log_power"))
    return metrics.standardized(written(curves.select(*keys, F.concat("radial_mean", "log_power").alias("x")), "curves"), ["class", "set"], "id", "x")


@query
def diversity_features(spark, sf):
    return rounded(_vectors(spark, sf).select("class", "set", "id", F.posexplode("z").alias("dim", "z")), "z", digits=5)


@query
def pair_distance(spark, sf):
    vectors = written(_vectors(spark, sf), "vectors")
    return rounded(metrics.mean_pair_distance(vectors, ["class", "set"], "id"), "mean_distance", digits=5)


def _mmd(spark, sf):
    v = written(_vectors(spark, sf), "vectors")
    return metrics.mmd2(v.where("set = 'real'").drop("set"), v.where("set = 'gen'").drop("set"), ["class"], "id")


@query
def mmd2(spark, sf):
    return rounded(_mmd(spark, sf), "mmd2", digits=5)


def _per_class(spark, sf):
    raw = metrics.moments(im.pixels(b.raw_images(spark, sf)), ["class", "set"])
    eye = metrics.mean_and_spread(metrics.eye_contrast(_curves(spark, sf), ["class", "set", "id"], b.R_BINS), ["class", "set"], "eye_contrast")
    wide = lambda df, v, name: df.where("set = 'real'").select("class", F.col(v).alias(f"{name}_real")).join(df.where("set = 'gen'").select("class", F.col(v).alias(f"{name}_gen")), "class")
    return wide(raw, "mean", "pixel_mean").join(wide(eye, "mean", "eye"), "class")


@query
def macro_metrics(spark, sf):
    p = written(_per_class(spark, sf), "per-class")
    both = metrics.macro(p, "pixel_mean", "pixel_mean_real", "pixel_mean_gen").unionAll(metrics.macro(p, "eye_contrast", "eye_real", "eye_gen"))
    return rounded(both, "corr_class_real", "corr_class_gen", "corr_real_gen", "mae")


@query
def metrics_report(spark, sf):
    p = rounded(_per_class(spark, sf), "pixel_mean_real", "pixel_mean_gen", "eye_real", "eye_gen", digits=4)
    parsed = metrics.report(p, ["pixel_mean_real", "pixel_mean_gen", "eye_real", "eye_gen"]).select(F.from_json("value", "per_class map<string,struct<pixel_mean_real:double,pixel_mean_gen:double,eye_real:double,eye_gen:double>>").alias("r"))
    return parsed.select(F.explode("r.per_class").alias("class", "v")).select("class", "v.pixel_mean_real", "v.pixel_mean_gen", "v.eye_real", "v.eye_gen")


def _suite(spark, sf):
    return evaluation.suite(b.raw_images(spark, sf), b.SIDE, None, b.R_BINS, b.PSD_BINS, b.THETA_BINS)


@query
def evaluation_report(spark, sf):
    """Every number of the report, of each class and over classes."""
    return rounded(_suite(spark, sf)[0], "value", digits=5)


@query
def evaluation_curves(spark, sf):
    return rounded(_suite(spark, sf)[1], "value", digits=5)


@query
def viz_shared_limits(spark, sf):
    return rounded(metrics.shared_limits(im.pixels(b.raw_images(spark, sf))), "low", "high")


@query
def viz_compare_grid(spark, sf):
    return metrics.compare_grid(b.raw_images(spark, sf).select("class", "set", "id"), 5)


@query
def rot90(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    k = F.conv(F.substring(sc.seeded(SEED, "id"), 1, 2), 16, 10).cast("int") % 4
    return exploded(e.select("id", im.rot90("x", b.SIDE, k).alias("y")), ["id"], "y")


@query
def shift_reflect(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    part = lambda at: F.conv(F.substring(sc.seeded(SEED, "id"), at, 2), 16, 10).cast("int") % 5 - 2
    return exploded(e.withColumns({"dy": part(1), "dx": part(3)}).select("id", im.shift_reflect("x", b.SIDE, "dy", "dx").alias("y")), ["id"], "y")


@query
def erase_bar(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.withColumns({"vertical": F.col("id") % 2 == 0, "start": (F.col("id") % 5).cast("int"), "width": (F.col("id") % 3 + 1).cast("int"), "fill": F.lit(0.5)})
    return exploded(e.select("id", im.erase_bar("x", b.SIDE, "vertical", "start", "width", "fill").alias("y")), ["id"], "y")


# Feed


@query
def training_elements(spark, sf):
    images = b.raw_images(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit(".nc")).alias("rel_path"), "bt")
    classes = b.raw_images(spark, sf).select(F.concat(F.col("id").cast("string"), F.lit(".nc")).alias("rel_path"), F.col("class").alias("ss_cat"))
    meta = classes.where("ss_cat > 2").select("rel_path", (F.col("ss_cat") + 0.5).alias("wmo_wind_kt"))
    rows = feed.elements(images, feed.require_some_wind(catalog.wind_fallback(classes, meta)))
    return exploded(rows.select("rel_path", "cond.ss_cat", F.col("cond.wind_kt").cast("double").alias("wind_kt"), "bt"), ["rel_path", "ss_cat", "wind_kt"], "bt")


@query
def augmented_elements(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 6).cast("int").alias("ss_cat"), F.col("embedding").cast("array<double>").alias("x"))
    e = e.join(F.broadcast(im.augment_policy(spark)), "ss_cat")  # six rows
    return exploded(feed.augment(e, "x", b.SIDE, "p_aug", SEED, "id").select("id", "x"), ["id"], "x")


@query
def train_batches(spark, sf):
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), "label")
    return feed.batches(rows, "row", 64, True).groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("labels"))


@query
def shuffle_buffer(spark, sf):
    """Every row once, none more than a buffer ahead of its place in its partition's stream."""
    rows = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").withColumn("place", F.monotonically_increasing_id() % (1 << 33))
    out = feed.buffered(rows, 64, SEED).withColumn("out", F.monotonically_increasing_id() % (1 << 33))
    return out.select("l_orderkey", "l_linenumber", (F.col("place") - F.col("out") < 256).alias("in_reach"))


@query
def viz_sample_grid(spark, sf):
    first = metrics.compare_grid(b.raw_images(spark, sf).where("class = 0"), 7).where("set = 'real'")
    return rounded(feed.sample_grid(first, "place", 3, b.SIDE), "v")


# Diffusion


def _steps(spark, sf, name):
    """Every vector with the schedule of its step."""
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("vec_id") * 37 % 1000).cast("int").alias("t"))
    return diffusion.at_step(rows, diffusion.schedule(diffusion.betas(spark, name)))


@query
def beta_linear(spark, sf):
    return rounded(_steps(spark, sf, "linear").select("id", "t", "beta"), "beta", digits=9)


@query
def beta_cosine(spark, sf):
    return rounded(_steps(spark, sf, "cosine").select("id", "t", "beta"), "beta", digits=9)


@query
def posterior_variance(spark, sf):
    return rounded(_steps(spark, sf, "linear").select("id", "t", "abar", "abar_prev", "post_var"), "abar", "abar_prev", "post_var", digits=9)


def _noised(spark, sf):
    return diffusion.at_step(b.noised(spark, sf), diffusion.schedule(diffusion.betas(spark)))


@query
def q_sample(spark, sf):
    return exploded(_noised(spark, sf).select("id", diffusion.q_sample().alias("x")), ["id"], "x")


@query
def v_target(spark, sf):
    return exploded(_noised(spark, sf).select("id", diffusion.v_target().alias("x")), ["id"], "x")


@query
def x0_roundtrip(spark, sf):
    rows = _noised(spark, sf).withColumns({"xt": diffusion.q_sample(), "v": diffusion.v_target()})
    rows = rows.withColumns({"from_v": diffusion.x0_from_v("xt", "v"), "eps_v": diffusion.eps_from_v("xt", "v"), "from_eps": diffusion.x0_from_eps("xt", "eps")})
    worst = lambda a, c: F.array_max(F.zip_with(a, c, lambda x, y: F.abs(x - y)))
    return rows.select("id", (worst("from_v", "x0") < 1e-9).alias("v_ok"), (worst("eps_v", "eps") < 1e-9).alias("eps_ok"), F.round(worst("from_eps", "x0"), 6).alias("eps_gap"))


@query
def min_snr_weights(spark, sf):
    s = _steps(spark, sf, "linear").select("id", "t", diffusion.min_snr_weight("v_mse", 2.5).alias("w_v"), diffusion.min_snr_weight("eps", 2.5).alias("w_eps"))
    return rounded(s, "w_v", "w_eps")


def _losses(spark, sf):
    rows = _noised(spark, sf).withColumn("target", diffusion.v_target())
    return rows.select("id", "label", "t", (diffusion.mse("target", "x0") * diffusion.min_snr_weight("v_mse", 2.5)).alias("loss"))


@query
def diffusion_loss(spark, sf):
    return rounded(_losses(spark, sf), "loss")


@query
def batch_mean_loss(spark, sf):
    every = _losses(spark, sf).withColumn("part", F.lit("all"))
    kept, dropped = (history.batch_mean_loss(every, "part", "id", "loss", 64, d).withColumn("drop_last", F.lit(d)) for d in (False, True))
    return rounded(kept.unionAll(dropped), "loss")


@query
def dynamic_threshold(spark, sf):
    rows = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 5).alias("x"))
    return exploded(rows.select("id", diffusion.dynamic_threshold("x", 0.9).alias("y")), ["id"], "y")


@query
def cfg_combine(spark, sf):
    rows = b.noised(spark, sf)
    on = exploded(rows.select("id", diffusion.guided("x0", "eps", 2.5).alias("y")), ["id"], "y").withColumn("scale", F.lit(2.5))
    return on.unionAll(exploded(rows.select("id", diffusion.guided("x0", "eps", 0.0).alias("y")), ["id"], "y").withColumn("scale", F.lit(0.0)))


@query
def reverse_step(spark, sf):
    rows = _noised(spark, sf).withColumn("t", F.col("t")).withColumns({"xt": diffusion.q_sample(), "pred": diffusion.v_target(), "noise": F.transform("eps", lambda e: e * 0.5)})
    return exploded(diffusion.reverse_step(rows, "v", 0.995).select("id", "t", "x_prev"), ["id", "t"], "x_prev")


# History


@query
def ema_series(spark, sf):
    return rounded(history.ema(b.daily(spark, sf), "run", "step", "value", 0.9), "ema")


@query
def early_stop(spark, sf):
    return rounded(history.early_stop(b.daily(spark, sf), "run", "step", "value", 3, 0.5), "best_metric")


@query
def early_stop_resumed(spark, sf):
    """Both trackers over a run in two parts: the state of the first is stored, read again and carried on."""
    e = b.table(spark, sf, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date")).cast("bigint")
    epochs = e.groupBy((F.col("user_id") % 5).alias("run"), day.alias("step")).agg(F.avg("value").alias("full"), F.avg(F.when(F.col("event_id") % 3 == 0, F.col("value"))).alias("balanced"))
    epochs = epochs.withColumn("full", F.when(F.col("step") % 7 != 0, F.col("full")))  # days without validation
    epochs, path = written(epochs, "epochs"), table_path(spark, "state")
    half = "(SELECT (min(step) + max(step)) / 2 FROM {e})"
    args = ("run", "step", "full", "balanced", 6, 0.5)
    files.append_state(history.track(spark.sql(f"SELECT * FROM {{e}} WHERE step <= {half}", e=epochs), *args), path)
    files.append_state(history.track(spark.sql(f"SELECT * FROM {{e}} WHERE step > {half}", e=epochs), *args, files.read_state(spark, path, "run")), path)
    return rounded(files.read_state(spark, path, "run"), "best_full", "best_balanced")


# Conditioning features and layers


@query
def wind_features(spark, sf):
    rows = b.index(spark, sf).select("rel_path", sc.wind_scaled(sc.wind_clip("wmo_wind_kt")).alias("w"))
    return rounded(rows.select("rel_path", F.posexplode(sc.wind_fourier("w")).alias("i", "v")), "v")


@query
def time_embedding(spark, sf):
    """Every event at one of the 1,000 steps."""
    steps = b.table(spark, sf, "events").select("event_id", (F.col("event_id") % 1000).cast("int").alias("t"))
    return exploded(steps.select("event_id", "t", sc.time_embedding("t", 9).alias("e")), ["event_id", "t"], "e")


@query
def midpoint_general(spark, sf):
    labels = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), (F.col("label") % 10 - 1).cast("int").alias("label"))
    return labels.select("id", "label", sc.midpoint_general("label").alias("six"), sc.midpoint_general("label", 8).alias("eight"), sc.midpoint("label").alias("scalar"), sc.label_clip("label").alias("clipped"))


@query
def wind_targets(spark, sf):
    targets = F.create_map(*[F.lit(x) for x in ("0", "49.5", "1", "bad", "3", "101")])
    return b.index(spark, sf).select("rel_path", "ss_cat", sc.wind_target(targets, "ss_cat").alias("target"))


def _cells(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "v"))
    return e


@query
def groupnorm(spark, sf):
    cells = _cells(spark, sf).select("id", F.floor(F.col("i") / 8).cast("int").alias("c"), (F.col("i") % 8).cast("int").alias("i"), "v")
    return rounded(layers.groupnorm(cells, 8, 4, 1e-3), "v", digits=5)


@query
def film_swish(spark, sf):
    return rounded(_cells(spark, sf).select("id", "i", layers.film("v", F.lit(0.25), F.lit(-0.1)).alias("v")), "v")


@query
def avg_pool(spark, sf):
    return rounded(layers.avg_pool(_cells(spark, sf), b.SIDE), "v")


@query
def upsample(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    return exploded(layers.upsample(e, b.SIDE), ["id"], "x")


@query
def conv3x3(spark, sf):
    return rounded(layers.conv3x3(_cells(spark, sf), [1, 2, 1, 0, 0, 0, -1, -2, -1], b.SIDE), "v")


@query
def attention_tiny(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("e"))
    tokens = e.select("id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda r: F.slice("e", r * 8 + 1, F.lit(8)))).alias("t", "x"))
    return exploded(layers.attention(tokens), ["id", "t"], "z")


@query
def embed_mlp(spark, sf):
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.slice(F.col("embedding").cast("array<double>"), 1, 3).alias("x"))
    hidden = layers.swish(layers.dense("x", [[1.0, -1.0, 0.5], [0.25, 0.5, 2.0]], [0.1, -0.2]))
    return exploded(e.select("id", hidden.alias("y")), ["id"], "y")


def fixed_weights(rows: int, columns: int, seed: int) -> list[list[float]]:
    return [[((3 * i + 5 * j + seed) % 7 - 3) / 4 for j in range(columns)] for i in range(rows)]


@query
def condition_embedding(spark, sf):
    """Label rows, time and wind features, each through two dense layers, summed; one row in ten has the null condition."""
    null = F.col("vec_id") % 10 == 0
    e = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"),
        (F.col("vec_id") * 37 % 1000).cast("int").alias("t"),
        sc.label_clip(F.when(null, 6).otherwise(F.col("label") % 8 - 1)).cast("int").alias("label"),
        sc.wind_clip(F.when(null, 0.0).otherwise((F.col("vec_id") % 200).cast("double") + 1)).alias("wind"),
    )
    rows = F.array(*[F.array(*[F.lit(v) for v in row]) for row in fixed_weights(7, 4, 1)])
    deep = lambda x, n, seed: layers.swish(layers.dense(layers.swish(layers.dense(x, fixed_weights(4, n, seed), [0.1] * 4)), fixed_weights(4, 4, seed + 1), [-0.2] * 4))
    e = e.select("id", deep(sc.time_embedding("t", 4), 4, 2).alias("a"), deep(F.element_at(rows, F.col("label") + 1), 4, 4).alias("c"), deep(sc.wind_fourier(sc.wind_scaled("wind")), 5, 6).alias("w"))
    return exploded(e.select("id", layers.branch_sum("a", "c", "w").alias("y")), ["id"], "y")


def fixed_array(*shape, seed):
    """Small weights of a rule that SQL can repeat: ((3 first + 5 second + 2 third + fourth + seed) mod 7 - 3) / 8."""
    import numpy as np

    places = np.indices(shape)
    return ((sum(m * p for m, p in zip((3, 5, 2, 1), places)) + seed) % 7 - 3) / 8


def fixed_norm(channels, seed):
    return blocks.Norm(1 + fixed_array(channels, seed=seed), fixed_array(channels, seed=seed + 1))


def _tiles(spark, sf):
    """Vectors as 4 x 4 images of four channels, with an embedding of two numbers."""
    i = F.col("vec_id")
    return b.table(spark, sf, "embeddings").select(i.alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.array((i % 5).cast("double") / 5, (F.col("label") % 3).cast("double")).alias("emb"))


@query
def groupnorm_affine(spark, sf):
    out = blocks.norm_block(_tiles(spark, sf), "x", (4, 4, 4), fixed_norm(4, 3), most=2)
    return exploded(out, ["id"], "y")


@query
def res_block(spark, sf):
    """Four channels to four, and to two through a skip convolution."""
    out = None
    for c in (4, 2):
        skip = {} if c == 4 else {"skip": fixed_array(4, c, seed=6), "skip_bias": fixed_array(c, seed=7)}
        w = blocks.ResWeights(fixed_array(3, 3, 4, c, seed=1), fixed_array(c, seed=2), fixed_norm(c, 3), fixed_array(3, 3, c, c, seed=4), fixed_array(c, seed=5), fixed_norm(c, 4), fixed_array(2, 4 * c, seed=8), fixed_array(4 * c, seed=9), **skip)
        one = exploded(blocks.res_block(_tiles(spark, sf), "x", "emb", (4, 4, 4), w, most=2), ["id"], "y").withColumn("channels", F.lit(c))
        out = one if out is None else out.unionAll(one)
    return out


@query
def attention_block(spark, sf):
    """Two heads over 16 tokens, in blocks of five keys."""
    m = lambda seed: {n: v for k, name in enumerate(("query", "key", "value")) for n, v in ((name, 4 * fixed_array(4, 2, 2, seed=seed + k)), (f"{name}_bias", fixed_array(2, 2, seed=seed + k + 3)))}
    w = blocks.AttentionWeights(fixed_norm(4, 2), **m(1), out=fixed_array(2, 2, 4, seed=4), out_bias=fixed_array(4, seed=6))
    return exploded(blocks.attention_block(_tiles(spark, sf), "x", (4, 4, 4), w, most=2, block=5), ["id"], "y")


@query
def upsample_skip(spark, sf):
    """An image doubled, with a skip of two channels put beside it: three channels a pixel, summed by line and channel
    with weights of 1, 2, ... along the line."""
    e = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"))
    skip = F.transform(F.sequence(F.lit(0), F.lit(511)), lambda j: j.cast("double") + F.col("id"))
    joined = layers.upsample(e, b.SIDE).select("id", layers.joined_channels(F.transform("x", lambda v: F.round(v, 6)), skip, 1, 2).alias("y"))
    line = lambda y, j: F.aggregate(F.sequence(F.lit(0), F.lit(15)), F.lit(0.0), lambda a, x: a + (x + 1) * F.element_at(y, ((F.floor(j / 3) * 16 + x) * 3 + j % 3 + 1).cast("int")))
    lines = F.flatten(F.transform(F.array("y"), lambda y: F.transform(F.sequence(F.lit(0), F.lit(47)), lambda j: line(y, j))))  # y is made once
    return rounded(joined.select("id", F.posexplode(lines).alias("i", "v")), "v")


# Streams and loops


@query
def stream_weighted_sampler(spark, sf):
    from gridloom.streaming.sampler import sample_stream, take_batches

    index = written(b.index(spark, sf), "index")
    path = table_path(spark, "stream")
    drawn = sample_stream(spark, index, 0.4, SEED).join(written(sampling.class_places(index), "places"), ["ss_cat", "place"])
    take_batches(drawn.select("draw", "ss_cat", "rel_path"), f"{path}/rows", f"{path}/checkpoint", 2)
    return spark.read.parquet(f"{path}/rows").select("draw", "ss_cat", "rel_path")


@query
def stream_alpha_change(spark, sf):
    """Two micro-batches with weight 1, one with 0.7 and two with 0.4: the last after the query was stopped and started."""
    from gridloom.streaming.sampler import sample_with_control, set_alpha

    index, path = written(b.index(spark, sf), "index"), table_path(spark, "stream")
    for first, alpha in ((0, 1.0), (2, 0.7), (3, 0.4)):
        set_alpha(spark, f"{path}/control", first, alpha)
    for batches in (3, 5):
        sample_with_control(spark, index, f"{path}/control", SEED, f"{path}/rows", f"{path}/checkpoint", batches, 100)
    return spark.read.parquet(f"{path}/rows").select("draw", "ss_cat", "rel_path", "alpha")


def digest_noise(seed, ids, size):
    """Noise in [-1, 1) of each id, call and place, from md5."""
    import hashlib

    import numpy as np

    calls = iter(range(1 << 30))

    def draw():
        k = next(calls)
        return np.array([[int(hashlib.md5(f"{i}|{k}|{j}".encode()).hexdigest()[:8], 16) / 2**31 - 1 for j in range(size)] for i in ids])

    return draw


@query
def ddpm_sample_loop(spark, sf):
    """Guided, three steps, a linear predictor that depends on the condition, without thresholds."""
    asked = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 6, F.col("label")).cast("int").alias("label"))
    loop = diffusion.sample_loop(asked, lambda x, t, labels, winds: x * 0.5 + labels[:, None] * 0.01 + winds[:, None] * 0.001, 4, steps=3, p=None, guidance=1.5, noise=digest_noise)
    return exploded(loop, ["id", "label"], "x")


@query
def ddpm_by_steps(spark, sf):
    """Twelve guided steps of the cosine schedule as DataFrame steps, written every five, with the same predictor."""
    asked = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 6, F.col("label")).cast("int").alias("label"))
    predict = lambda x, t, labels, winds: x * 0.5 + labels[:, None] * 0.01 + winds[:, None] * 0.001
    noise = lambda call: F.transform(F.sequence(F.lit(0), F.lit(1)), lambda j: sc.uniform(F.md5(F.concat_ws("|", "id", F.lit(str(call)), j.cast("string")).cast("binary"))) * 2 - 1)
    out = diffusion.sample_by_steps(asked, predict, 2, steps=12, p=None, guidance=1.5, schedule_name="cosine", noise=noise, every=5)
    return exploded(out.select("id", "label", "x"), ["id", "label"], "x")


@query
def pack_verification(spark, sf):
    """Images of all vectors packed by path and compared, all of them, with their source."""
    images = b.table(spark, sf, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit("-e.nc")).alias("rel_path"), (F.col("label") % 6).cast("int").alias("ss_cat"), F.col("embedding").cast("array<float>").alias("bt"))
    packed = written(catalog.pack(images, 512), "packed")
    source = images.select("rel_path", F.transform("bt", lambda v: F.round(v.cast("double"), 2).cast("float")).alias("bt"))
    out = catalog.verify_pack(packed, images.select("rel_path", "ss_cat"), source, images.count(), SEED, 0.01)
    return rounded(out, "max_abs_diff")


@query
def pack_manifest(spark, sf):
    packed = written(catalog.pack(b.index(spark, sf), 512), "packed")
    return catalog.manifest_json(packed, 512, b.SIDE * b.SIDE).select(F.get_json_object("value", "$.num_samples").cast("long").alias("num_samples"), F.get_json_object("value", "$.samples_per_shard").cast("int").alias("samples_per_shard"), F.explode(F.from_json(F.get_json_object("value", "$.shards"), "array<struct<path string, start long, stop long>>")).alias("s")).select("num_samples", "samples_per_shard", "s.*")


# Files


def _image_files(spark, sf):
    """Every vector as an image file of the classic array format; those of ids divisible by 17 have no wind."""
    root = table_path(spark, "files")
    netcdf.register(spark)
    i = F.col("vec_id")
    rows = b.table(spark, sf, "embeddings").select(
        F.concat((i % 10).cast("string"), F.lit("/"), i.cast("string"), F.lit("-e.nc")).alias("rel_path"),
        F.when(i % 17 != 0, (i * 7 % 150).cast("double")).alias("wmo_wind"),
        F.col("embedding").alias("bt"),
        F.array(F.lit(b.SIDE), F.lit(b.SIDE)).alias("bt_shape"),
    )
    rows.write.format("gridnc").mode("append").save(root)
    return root


@query
def netcdf_index(spark, sf):
    """The class index of image files, from their headers alone."""
    found = netcdf.read_files(spark, _image_files(spark, sf), "rel_path string, wmo_wind double")
    return rounded(catalog.dataset_index(found), "wmo_wind_kt")


@query
def netcdf_images(spark, sf):
    found = netcdf.read_files(spark, _image_files(spark, sf), "rel_path string, bt array<float>, bt_shape array<int>")
    return exploded(found.select("rel_path", F.element_at("bt_shape", 1).alias("height"), F.col("bt").cast("array<double>").alias("bt")), ["rel_path", "height"], "bt")


@query
def packed_lookup(spark, sf):
    """A packed set, opened with its checks, and each of its paths looked up."""
    i = F.col("vec_id")
    images = b.table(spark, sf, "embeddings").select(F.concat(i.cast("string"), F.lit("-e.nc")).alias("rel_path"), (F.col("label") % 6).cast("int").alias("ss_cat"), F.col("embedding").alias("bt"))
    path = table_path(spark, "pack")
    catalog.write_pack(written(catalog.pack(images, 128), "packed"), path, 128)
    found = packed.open_packed(spark, path).by_path(images.select("rel_path"))
    total = F.aggregate("bt", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return rounded(found.select("rel_path", "global_index", "shard_id", "ss_cat", total.alias("total")), "total")


@query
def scan_tree(spark, sf):
    return files.scan_tree(spark, _image_files(spark, sf))


@query
def tracks_csv(spark, sf):
    """The storm table of tracks that were written as text: read, checked and typed again."""
    path = table_path(spark, "tracks")
    b.tracks(spark, sf).drop("row_no").withColumn("LON", F.lit(0.0)).write.option("header", True).csv(path)
    return rounded(storms.storm_table(storms.coerce_tracks(files.read_tracks(spark, path))), "MAX_WMO_WIND")


@query
def index_lines(spark, sf):
    path = table_path(spark, "index")
    files.write_json(catalog.index_lines(b.snapshots(spark, sf)), path)
    return rounded(files.read_index_lines(spark, path, strict=True), "wmo_wind_kt")


@query
def path_classes(spark, sf):
    """The class of each path of an index in which a tenth of the paths stand under two."""
    index = b.index(spark, sf).select("ss_cat", "rel_path")
    second = index.where(F.substring(sc.seeded(SEED, "rel_path"), 1, 1) < "2").select(((F.col("ss_cat") + 1) % 6).alias("ss_cat"), "rel_path")
    return catalog.path_classes(index.unionAll(second))


@query
def split_lists(spark, sf):
    """Files of each split by the lists that were written for them."""
    path = table_path(spark, "splits")
    files.write_split_lists(spark, storms.split_storms(storms.storm_table(b.tracks(spark, sf))), _files(spark, sf)[1], path)
    parts = [files.read_lines(spark, f"{path}/files_{name}").withColumn("split", F.lit(name)) for name in ("train", "val", "test")]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query
def loss_history(spark, sf):
    """The curves of the loss figure, from a history that was added to twice."""
    path = table_path(spark, "history")
    days = written(b.daily(spark, sf), "days")
    rows = days.groupBy(F.col("step").cast("int").alias("epoch")).agg(F.avg("value").alias("train_loss"), F.max("value").alias("val_full"), F.min(F.when(F.col("step") % 2 == 0, F.col("value"))).alias("val_balanced"))
    for even in (True, False):
        files.append_history(rows.where((F.col("epoch") % 2 == 0) == F.lit(even)), path)
    return rounded(files.read_history(spark, path), "train_loss", "val_full", "val_balanced")


@query
def condition_prepared(spark, sf):
    i = F.col("vec_id")
    rows = b.table(spark, sf, "embeddings").select(i.alias("id"), (F.col("label") % 7).cast("int").alias("label"), F.when(i % 3 != 0, i.cast("double")).alias("wind_kt"))
    return rounded(diffusion.prepare_condition(rows), "wind_kt")


@query
def epoch_rows(spark, sf):
    """The rows of an epoch of 20 steps of eight."""
    return feed.epoch(b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row"), "label"), 20, 8, "row")
