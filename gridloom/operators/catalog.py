"""The snapshot catalogue: class index, packing into shards, validation, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.functions.scalar import is_finite, midpoint, seeded, ss_category
from gridloom.session import written


def classify(snapshots: DataFrame) -> DataFrame:
    """``ss_cat`` of every snapshot from ``wmo_wind``."""
    return snapshots.withColumn("ss_cat", ss_category("wmo_wind"))


def dataset_index(snapshots: DataFrame) -> DataFrame:
    """rel_path, ss_cat, wmo_wind_kt of snapshots with wind of tropical-storm strength or more."""
    kept = classify(snapshots).where(F.col("wmo_wind").isNotNull() & F.col("ss_cat").isNotNull())
    return kept.select("rel_path", "ss_cat", F.col("wmo_wind").alias("wmo_wind_kt"))


def class_counts(index: DataFrame) -> DataFrame:
    return index.groupBy("ss_cat").agg(F.count(F.lit(1)).alias("n"))


def index_meta(snapshots: DataFrame) -> DataFrame:
    """How many files there are, were indexed, and were left out for either reason."""
    rows = classify(snapshots)
    has, strong = F.col("wmo_wind").isNotNull(), F.col("ss_cat").isNotNull()
    return rows.agg(F.count(F.lit(1)).alias("num_files_total"), F.count_if(has & strong).alias("num_files_indexed"), F.count_if(~has).alias("num_files_skipped_no_wind"), F.count_if(has & ~strong).alias("num_files_skipped_below_ts"))


def index_lines(snapshots: DataFrame, root: str = "") -> DataFrame:
    """Rows ``value``: the index as JSON lines, one of the counts and one for every file, so that no row grows with them."""
    meta = index_meta(snapshots).select(F.to_json(F.struct(F.struct(F.lit(root).alias("dataset_root"), "*").alias("meta"))).alias("value"))
    return meta.unionAll(dataset_index(snapshots).select(F.to_json(F.struct("rel_path", "ss_cat", "wmo_wind_kt")).alias("value")))


def index_json(snapshots: DataFrame, root: str = "") -> DataFrame:
    """One row ``value``: the index document. Class lists and samples grow with the files; for large sets write
    ``dataset_index`` as a table instead."""
    index = dataset_index(snapshots)
    classes = index.groupBy(F.col("ss_cat").cast("string").alias("k")).agg(F.sort_array(F.collect_list("rel_path")).alias("v")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("classes"))
    samples = index.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("rel_path", F.struct("ss_cat", "wmo_wind_kt").alias("s"))))).alias("samples"))
    meta = index_meta(snapshots).select(F.struct(F.lit(root).alias("dataset_root"), "*").alias("meta"))
    return meta.crossJoin(classes).crossJoin(samples).select(F.to_json(F.struct("meta", "classes", "samples")).alias("value"))  # one row each


def path_classes(classes: DataFrame) -> DataFrame:
    """Inverts (ss_cat, rel_path) rows: one class per path, the last (largest) if there are more."""
    return classes.groupBy("rel_path").agg(F.max("ss_cat").alias("ss_cat"))


def wind_fallback(index: DataFrame, meta: DataFrame) -> DataFrame:
    """rel_path, ss_cat, wind_kt and is_fallback: the known finite wind or the class midpoint."""
    known = meta.select("rel_path", F.col("wmo_wind_kt").cast("double").alias("__w"))
    joined = index.select("rel_path", "ss_cat").join(known, "rel_path", "left")
    good = is_finite("__w")
    return joined.select("rel_path", "ss_cat", F.when(good, F.col("__w")).otherwise(midpoint("ss_cat")).alias("wind_kt"), (~good).alias("is_fallback"))


def dense_index(df: DataFrame, order: list[str], out: str, partitions: int | None = None) -> DataFrame:
    """A gapless number from 0 in the order of ``order``, without gathering all rows in one task: rows are
    range-partitioned and written, numbered in their partition, and shifted by the partitions before (one
    small row for each, which bounds the broadcast)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(df.repartitionByRange(n, *order).withColumn("__part", F.spark_partition_id()), "ordered")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__part").orderBy(*order)
    numbered = placed.withColumn("__row", F.row_number().over(own) - 1).join(F.broadcast(starts), "__part")
    return numbered.withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__part", "__row", "__start")


def pack(index: DataFrame, samples_per_shard: int = 4096) -> DataFrame:
    """global_index in path order, its shard, and the columns of the index."""
    if samples_per_shard <= 0:
        raise ValueError("samples_per_shard must be positive")
    rows = dense_index(index, ["rel_path"], "global_index")
    return rows.withColumn("shard_id", F.floor(F.col("global_index") / samples_per_shard).cast("int"))


def write_packed(packed: DataFrame, path: str, overwrite: bool = False) -> None:
    """Parquet by shard; an existing dataset stops it unless it may be overwritten."""
    packed.repartition("shard_id").sortWithinPartitions("global_index").write.mode("overwrite" if overwrite else "errorifexists").partitionBy("shard_id").parquet(path)


def write_pack(packed: DataFrame, path: str, samples_per_shard: int, about: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """A packed set: ``samples`` (Parquet by shard), ``rel_paths`` (the ordered list with labels of 16 bits) and
    ``manifest``, one JSON document. Rows have global_index, shard_id, rel_path, ss_cat and bt; images of another
    length than the first are an error."""
    mode = "overwrite" if overwrite else "errorifexists"
    sizes = packed.agg(F.min(F.size("bt")).alias("a"), F.max(F.size("bt")).alias("b"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("bt").isNull()).alias("none")).first()
    if not sizes.n:
        raise ValueError("nothing to pack")
    if sizes.a != sizes.b or sizes.none:
        raise ValueError(f"images of {sizes.a} to {sizes.b} pixels")
    write_packed(packed.withColumn("bt", F.col("bt").cast("array<float>")), f"{path}/samples", overwrite)
    listed = packed.select("global_index", "rel_path", F.col("ss_cat").cast("smallint").alias("label"))
    listed.repartitionByRange("global_index").sortWithinPartitions("global_index").write.mode(mode).parquet(f"{path}/rel_paths")
    manifest_json(packed, samples_per_shard, sizes.a, about).write.mode(mode).text(f"{path}/manifest")


def manifest_json(packed: DataFrame, samples_per_shard: int, pixels: int, about: dict[str, str] | None = None) -> DataFrame:
    """One row ``value``: the manifest as JSON. It has an entry per shard, as the format has."""
    shard = F.struct(F.col("start").alias("k"), F.format_string("samples/shard_id=%d", "shard_id").alias("path"), "start", "stop")
    all_ = manifest(packed).agg(F.sort_array(F.collect_list(shard)).alias("s"), F.coalesce(F.sum(F.col("stop") - F.col("start")), F.lit(0)).alias("n"))
    shards = F.transform("s", lambda x: F.struct(x["path"].alias("path"), x["start"].alias("start"), x["stop"].alias("stop")))
    given = F.struct(*[F.lit(v).alias(k) for k, v in (about or {"data_root": ""}).items()])
    fields = [F.lit(1).alias("version"), F.lit("parquet").alias("backend"), F.col("n").alias("num_samples"), F.array(F.lit(pixels)).alias("sample_shape"), F.lit("float32").alias("dtype"), F.lit(samples_per_shard).alias("samples_per_shard")]
    return all_.select(F.to_json(F.struct(*fields, F.lit("rel_paths").alias("rel_paths_file"), shards.alias("shards"), given.alias("source"))).alias("value"))


def look_up(index: DataFrame, wanted: DataFrame, key: str = "rel_path", strict: bool = False) -> DataFrame:
    """The index's rows of the keys asked for; with ``strict`` a key that isn't there is an error."""
    if strict:
        absent = wanted.select(key).join(index.select(key), key, "left_anti").limit(1).collect()
        if absent:
            raise KeyError(absent[0][0])
    return index.join(wanted.select(key), key)


def verify_pack(packed: DataFrame, index: DataFrame, source: DataFrame, k: int = 256, seed: int = 42, atol: float = 0.0) -> DataFrame:
    """One row: n_missing and n_mislabelled (all packed rows against the index), and of ``k`` sampled rows against
    ``source`` (rel_path, bt): n_compared, n_reshaped, n_wrong_type, max_abs_diff, and ok. NaN counts as infinite."""
    if k <= 0:
        raise ValueError("k must be positive")
    wrong_type = int(dict(packed.dtypes)["bt"] != "array<float>")
    missing = packed_missing(packed, index).select("n_missing")
    labels = label_mismatches(packed.withColumnRenamed("ss_cat", "__packed"), index.withColumnRenamed("ss_cat", "__label"), "rel_path", "__packed", "__label").agg(F.count(F.lit(1)).alias("n_mislabelled"))
    picked = sample_for_check(packed.select("rel_path", "bt"), k, seed, "rel_path").join(source.select("rel_path", F.col("bt").cast("array<float>").alias("__raw")), "rel_path", "left")
    same = F.coalesce(F.size("bt") == F.size("__raw"), F.lit(False))
    diff = array_max_abs_diff(picked, "bt", "__raw")
    seen = picked.select(same.alias("__same"), F.when(same, diff).alias("d")).agg(F.count(F.lit(1)).alias("n_compared"), F.count_if(~F.col("__same")).alias("n_reshaped"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_abs_diff"))
    row = missing.crossJoin(labels).crossJoin(seen).withColumn("n_wrong_type", F.lit(wrong_type))  # one row each
    good = (F.col("n_missing") == 0) & (F.col("n_mislabelled") == 0) & (F.col("n_reshaped") == 0) & (F.col("n_wrong_type") == 0) & (F.col("max_abs_diff") <= atol)
    return row.withColumn("ok", good)


def manifest(packed: DataFrame) -> DataFrame:
    """shard_id with its half-open range [start, stop) and first and last path."""
    return packed.groupBy("shard_id").agg(F.min("global_index").alias("start"), (F.max("global_index") + 1).alias("stop"), F.min("rel_path").alias("first_path"), F.max("rel_path").alias("last_path"))


def find_shards(lookups: DataFrame, shards: DataFrame, samples_per_shard: int | None = None) -> DataFrame:
    """The shard of each ``global_index``: by arithmetic if shards are full, else by their ranges. A manifest
    has one row per shard; it is broadcast below 100,000 rows and range-joined on buckets above."""
    if samples_per_shard:
        return lookups.withColumn("shard_id", F.floor(F.col("global_index") / samples_per_shard).cast("int")).join(shards.select("shard_id", "start", "stop"), "shard_id")
    inside = (F.col("global_index") >= F.col("start")) & (F.col("global_index") < F.col("stop"))
    if shards.limit(100_001).count() <= 100_000:
        return lookups.join(F.broadcast(shards.select("shard_id", "start", "stop")), inside)
    width = shards.agg(F.max(F.col("stop") - F.col("start"))).first()[0]
    cells = shards.select("shard_id", "start", "stop", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))).alias("__cell"))
    return lookups.withColumn("__cell", F.floor(F.col("global_index") / width)).join(cells, "__cell").where(inside).drop("__cell")


def validate_pack(packed: DataFrame, shards: DataFrame, expected: int | Column | None = None, size: int | None = None) -> DataFrame:
    """check and failures: contiguous ranges, no empty shard, full coverage, unique paths, matching counts
    and (given ``size`` and a ``bt`` column) image sizes."""
    order = Window.orderBy("start")  # one row per shard
    ranged = shards.withColumn("__before", F.lag("stop", 1, 0).over(order))
    counts = packed.agg(F.count(F.lit(1)).alias("n"))
    checks = [
        ranged.agg(F.count_if(F.col("start") != F.col("__before")).alias("failures")).withColumn("check", F.lit("contiguous")),
        shards.agg(F.count_if(F.col("stop") <= F.col("start")).alias("failures")).withColumn("check", F.lit("nonempty_shards")),
        shards.agg(F.max("stop").alias("stop")).crossJoin(counts).select(F.when(F.col("stop").eqNullSafe(F.col("n")), 0).otherwise(1).cast("long").alias("failures"), F.lit("covers_all").alias("check")),
        packed.groupBy("rel_path").agg(F.count(F.lit(1)).alias("n")).agg(F.count_if(F.col("n") > 1).alias("failures")).withColumn("check", F.lit("unique_paths")),
        packed.agg(F.count_if(F.col("ss_cat").isNull()).alias("failures")).withColumn("check", F.lit("labels_present")),
    ]
    if expected is not None:
        checks.append(counts.select(F.when(F.col("n") == expected, 0).otherwise(1).cast("long").alias("failures"), F.lit("expected_count").alias("check")))
    if size is not None:
        checks.append(packed.agg(F.count_if(F.size("bt") != size).alias("failures")).withColumn("check", F.lit("image_size")))
    out = checks[0].select("check", "failures")
    for c in checks[1:]:
        out = out.unionAll(c.select("check", "failures"))
    return out


def packed_missing(packed: DataFrame, index: DataFrame, key: str = "rel_path") -> DataFrame:
    """How many packed keys the index lacks, and the first of them."""
    return packed.join(index.select(key), key, "left_anti").agg(F.count(F.lit(1)).alias("n_missing"), F.min(key).alias("first_missing"))


def label_mismatches(packed: DataFrame, index: DataFrame, key: str, left: str, right: str) -> DataFrame:
    """Keys whose labels differ, with both."""
    return packed.select(key, left).join(index.select(key, right), key).where(F.col(left) != F.col(right))


def sample_for_check(packed: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows without replacement, in a seeded order that repeats."""
    return packed.orderBy(seeded(seed, key), key).limit(k)


def array_max_abs_diff(pairs: DataFrame, a: str, b: str, nan_passes: bool = False) -> Column:
    """The largest absolute difference of two arrays; by default a NaN on either side is an infinite difference,
    with ``nan_passes`` it counts as none."""
    nan = F.lit(0.0) if nan_passes else F.lit(float("inf"))
    return F.array_max(F.zip_with(F.col(a), F.col(b), lambda x, y: F.when(F.isnan(x) | F.isnan(y), nan).otherwise(F.abs(x.cast("double") - y.cast("double")))))
