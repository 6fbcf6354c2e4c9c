"""Storm table and the stratified split that keeps each storm's snapshots together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.functions.scalar import dur_bin, index_prefix, lat_bin, season, seeded, stratum
from gridloom.operators.catalog import dense_index

# The track table's columns.
REQUIRED = ("SID", "IDX_TRUE", "BASIN", "ISO_TIME", "LAT", "LON", "WMO_WIND", "SS_CAT")


def require_columns(tracks: DataFrame, required: tuple[str, ...] = REQUIRED) -> DataFrame:
    if missing := [c for c in required if c not in tracks.columns]:
        raise ValueError(f"tracks lack columns: {', '.join(missing)}")
    return tracks


def coerce_tracks(tracks: DataFrame) -> DataFrame:
    """Typed columns from text; what can't be read is null."""
    text = lambda c: F.col(c).cast("string")
    return require_columns(tracks).select(
        "SID", text("IDX_TRUE").try_cast("double").try_cast("bigint").alias("IDX_TRUE"), "BASIN", F.to_utc_timestamp(F.try_to_timestamp(text("ISO_TIME")), "UTC").alias("ISO_TIME"),
        text("LAT").try_cast("double").alias("LAT"), text("LON").try_cast("double").alias("LON"), text("WMO_WIND").try_cast("double").alias("WMO_WIND"), text("SS_CAT").try_cast("double").try_cast("int").alias("SS_CAT"),
        *(c for c in tracks.columns if c not in REQUIRED),
    )


def storm_table(tracks: DataFrame) -> DataFrame:
    """One row per storm, in one aggregation. ``row_no`` is the order of the rows; the peak is the first row of
    the largest wind (of all rows, where no wind is known). Storms without an id are left out."""
    wind = F.when(F.isnan("WMO_WIND"), None).otherwise(F.col("WMO_WIND"))
    peak = F.min_by(F.struct(wind.alias("wind"), F.col("ISO_TIME").alias("time"), F.col("LAT").alias("lat")), F.struct(F.coalesce(-wind, F.lit(float("inf"))), F.col("row_no")))
    basin = F.coalesce(F.mode("BASIN", True), F.min_by("BASIN", "row_no"))
    one = tracks.where(F.col("SID").isNotNull()).groupBy("SID").agg(F.count(F.lit(1)).alias("N_SNAPSHOTS"), basin.alias("BASIN_MODE"), peak.alias("p"), F.max(F.coalesce("SS_CAT", F.lit(-1))).alias("MAX_SS_CAT"))
    one = one.select("SID", "BASIN_MODE", F.col("p.wind").alias("MAX_WMO_WIND"), "MAX_SS_CAT", F.coalesce(F.month("p.time"), F.lit(1)).alias("MONTH_AT_PEAK"), F.col("p.lat").alias("LAT_AT_PEAK"), "N_SNAPSHOTS")
    one = one.withColumns({"SEASON_BIN": season("MONTH_AT_PEAK"), "LAT_BIN": lat_bin("LAT_AT_PEAK"), "DUR_BIN": dur_bin("N_SNAPSHOTS")})
    one = one.withColumn("STRATUM", stratum("BASIN_MODE", "MAX_SS_CAT", "SEASON_BIN", "LAT_BIN", "DUR_BIN"))
    return one.select("SID", "BASIN_MODE", "MAX_WMO_WIND", "MAX_SS_CAT", "MONTH_AT_PEAK", "SEASON_BIN", "LAT_AT_PEAK", "LAT_BIN", "N_SNAPSHOTS", "DUR_BIN", "STRATUM")


def strata_counts(storms: DataFrame) -> DataFrame:
    return storms.groupBy(F.col("STRATUM").alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


def split_storms(storms: DataFrame, train: float = 0.8, val: float = 0.1, test: float = 0.1, seed: int = 42) -> DataFrame:
    """SID, STRATUM and split. In each stratum storms are shuffled by a seeded digest and cut by counts that are
    rounded half to even; one storm goes to train, two to train and val."""
    if abs(train + val + test - 1.0) > 1e-6:
        raise ValueError("fractions must sum to 1")
    # a dense number over all storms less that of the stratum's first: no stratum is ordered in one task
    ordered = dense_index(storms.select("SID", "STRATUM").withColumn("__d", seeded(seed, "SID")), ["STRATUM", "__d", "SID"], "__at")
    strata = ordered.groupBy(F.col("STRATUM").alias("__s")).agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    few = strata.limit(100_001).count() <= 100_000
    ranked = ordered.join(F.broadcast(strata) if few else strata, F.col("STRATUM").eqNullSafe(F.col("__s"))).withColumn("__r", F.col("__at") - F.col("__first") + 1)
    n_train = F.least(F.col("__n"), F.greatest(F.lit(0), F.bround(F.col("__n") * F.lit(train)).cast("int")))
    n_val = F.least(F.col("__n") - n_train, F.greatest(F.lit(0), F.bround(F.col("__n") * F.lit(val)).cast("int")))
    where = F.when(F.col("__n") == 1, "train").when(F.col("__n") == 2, F.when(F.col("__r") == 1, "train").otherwise("val"))
    where = where.when(F.col("__r") <= n_train, "train").when(F.col("__r") <= n_train + n_val, "val").otherwise("test")
    return ranked.select("SID", "STRATUM", where.alias("split"))


def files_by_index(tracks: DataFrame, files: DataFrame) -> DataFrame:
    """Tracks with the path of the file of their IDX_TRUE (the number its name starts with; of several files the
    largest path), null where there is none."""
    by = files.withColumn("__idx", index_prefix("rel_path")).where(F.col("__idx").isNotNull()).groupBy("__idx").agg(F.max("rel_path").alias("rel_path"))
    return tracks.join(by, F.col("IDX_TRUE") == F.col("__idx"), "left").drop("__idx")


def mapping_counts(mapped: DataFrame) -> DataFrame:
    """How many track rows have a file and how many were dropped."""
    return mapped.agg(F.count_if(F.col("rel_path").isNotNull()).alias("n_mapped"), F.count_if(F.col("rel_path").isNull()).alias("n_dropped"))


def split_files(mapped: DataFrame, split: DataFrame) -> DataFrame:
    """rel_path and split of the track rows that have a file."""
    return mapped.where(F.col("rel_path").isNotNull()).join(split.select("SID", "split"), "SID").select("rel_path", "split", "SID")


def split_summary(mapped: DataFrame, files: DataFrame) -> DataFrame:
    """Rows and storms of each split."""
    rows = mapped.join(files.select("rel_path", "split").distinct(), "rel_path")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("SID").alias("n_storms"))


def split_counts(mapped: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows of each split and value of ``column``; nulls are left out."""
    rows = mapped.join(files.select("rel_path", "split").distinct(), "rel_path").where(F.col(column).isNotNull())
    return rows.groupBy("split", column).agg(F.count(F.lit(1)).alias("n"))


def split_report(storms: DataFrame, mapped: DataFrame, files: DataFrame, about: dict[str, str]) -> DataFrame:
    """One row ``value``: the split report as JSON. ``storms`` is the storm table, ``mapped`` the tracks with paths,
    ``files`` the paths with splits; ``about`` is written as it is. All parts are counts by small keys."""
    counts = lambda rows, key: F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).cast("string").alias("k"), F.col("n")))))
    strata = strata_counts(storms).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("num_storms_total"), counts(None, "stratum").alias("strata_counts")).select(F.struct("*").alias("storm_level"))
    names = mapped.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    one = lambda rows, key, name: rows.groupBy("split").agg(counts(rows, key).alias(name))
    total = split_summary(mapped, files)
    parts = names.join(total, "split", "left").join(one(split_counts(mapped, files, "BASIN"), "BASIN", "basins"), "split", "left").join(one(split_counts(mapped, files, "SS_CAT"), "SS_CAT", "cats"), "split", "left")
    body = F.struct(F.col("split").alias("name"), F.coalesce("n_rows", F.lit(0)).alias("num_snapshots"), F.coalesce("n_storms", F.lit(0)).alias("num_storms"), F.col("basins").alias("basin_counts"), F.col("cats").alias("ss_cat_counts"))
    splits = parts.agg(*[F.max_by(body, F.col("split") == s).alias(s) for s in ("train", "val", "test")])
    level = mapping_counts(mapped).crossJoin(splits).select(F.struct(F.col("n_mapped").alias("total_rows_after_mapping"), F.col("n_dropped").alias("missing_rows_dropped"), "train", "val", "test").alias("snapshot_level"))
    given = [F.lit(v).alias(k) for k, v in about.items()]
    return strata.crossJoin(level).select(F.to_json(F.struct(*given, "storm_level", "snapshot_level")).alias("value"))  # one row each
