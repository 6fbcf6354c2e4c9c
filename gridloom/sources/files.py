"""Readers and writers of the catalogue's files, all through Spark's own sources."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import is_finite, relative_path
from gridloom.operators.storms import REQUIRED, require_columns

INDEX_SCHEMA = "meta map<string,string>, classes map<string,array<string>>, samples map<string,struct<ss_cat:string,wmo_wind_kt:string>>"


def scan_tree(spark: SparkSession, root: str, pattern: str = "*.nc") -> DataFrame:
    """rel_path of the files below ``root``, without reading them; no file is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root).select("path")
    out = files.select(relative_path("path", root).alias("rel_path"))
    if out.isEmpty():
        raise FileNotFoundError(f"no {pattern} below {root}")
    return out


def decode_files(spark: SparkSession, root: str, decode: Callable[[bytes], dict], schema: str, pattern: str = "*.nc") -> DataFrame:
    """Binary files through a caller's decoder (bytes to a dict of columns), in Arrow batches: ``rel_path`` and
    the columns of ``schema``. The array format's own library is not a dependency."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    rows = raw.select(relative_path("path", root).alias("rel_path"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([{"rel_path": r, **decode(bytes(c))} for r, c in zip(batch["rel_path"], batch["content"])])

    return rows.mapInPandas(run, f"rel_path string, {schema}")


def read_images(spark: SparkSession, location: str, backend: str = "packed", decode: Callable[[bytes], dict] | None = None) -> DataFrame:
    """Images of either backend: packed Parquet, or single files through a decoder."""
    if backend == "packed":
        return spark.read.parquet(location)
    if backend == "files" and decode is not None:
        return decode_files(spark, location, decode, "bt array<float>, wmo_wind double")
    raise ValueError(f"unknown backend: {backend}")


def read_tracks(spark: SparkSession, path: str, null_value: str | None = None) -> DataFrame:
    """The track table as text columns, with ``row_no``, the row's place: file, block of the file, and number in it,
    in this order. The basin code NA stays a code; pass ``null_value="NA"`` to read it as missing."""
    reader = spark.read.option("header", True)
    rows = (reader.option("nullValue", null_value) if null_value else reader).csv(path)
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return require_columns(rows, REQUIRED).withColumn("row_no", place)


def read_index(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """With ``strict`` a path in two places is an error. rel_path, ss_cat and wmo_wind_kt (null where the metadata is missing or unreadable) of an index document."""
    document = spark.read.schema(INDEX_SCHEMA).option("multiLine", True).json(path)
    listed = document.select(F.explode("classes").alias("k", "paths")).select(F.col("k").try_cast("int").alias("ss_cat"), F.explode("paths").alias("rel_path"))
    wind = F.col("s.wmo_wind_kt").try_cast("double")
    meta = document.select(F.explode("samples").alias("rel_path", "s")).where(F.col("s.ss_cat").try_cast("int").isNotNull() & is_finite(wind)).select("rel_path", wind.alias("wmo_wind_kt"))
    files = listed.where(F.col("ss_cat").isNotNull())
    if strict:
        twice = files.groupBy("rel_path").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"a path is in the index twice: {twice[0].rel_path}")
    return files.join(meta, "rel_path", "left").select("rel_path", "ss_cat", "wmo_wind_kt")


def read_index_lines(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """rel_path, ss_cat and wmo_wind_kt of an index in JSON lines, read in parallel. With ``strict`` a path in two lines is
    an error; winds that can't be read are null, and lines without a class are left out."""
    rows = spark.read.schema("rel_path string, ss_cat string, wmo_wind_kt string").json(path)
    wind = F.col("wmo_wind_kt").try_cast("double")
    out = rows.select("rel_path", F.col("ss_cat").try_cast("int").alias("ss_cat"), F.when(is_finite(wind), wind).alias("wmo_wind_kt")).where("rel_path IS NOT NULL AND ss_cat IS NOT NULL")
    if strict:
        twice = out.groupBy("rel_path").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"a path is in the index twice: {twice[0].rel_path}")
    return out


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The distinct trimmed lines of a text list, blank ones left out."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        raise FileNotFoundError(f"no list at {path}") from e
    return lines.select(F.trim("value").alias("rel_path")).where("rel_path <> ''").distinct()


def read_rel_paths(spark: SparkSession, location: str, expected: int | None = None) -> DataFrame:
    """global_index and rel_path of a packed set's ordered list; another number of rows than expected is an error."""
    rows = spark.read.parquet(f"{location}/rel_paths").select("global_index", "rel_path")
    if expected is not None and (n := rows.count()) != expected:
        raise ValueError(f"{n} paths, {expected} expected")
    return rows


def write_lines(rows: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    rows.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def write_splits(files: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of paths for each split."""
    files.select("split", F.col("rel_path").alias("value")).repartition("split").write.mode(mode).partitionBy("split").text(path)


def write_split_lists(spark: SparkSession, storms: DataFrame, files: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Six lists below ``folder``: storm_ids_<split> and files_<split>."""
    for name in ("train", "val", "test"):
        write_lines(storms.where(F.col("split") == name), "SID", f"{folder}/storm_ids_{name}", mode)
        write_lines(files.where(F.col("split") == name), "rel_path", f"{folder}/files_{name}", mode)


def write_json(row: DataFrame, path: str, mode: str = "errorifexists") -> None:
    row.select("value").write.mode(mode).text(path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("epoch int, train_loss double, val_full double, val_balanced double").parquet(path)


def append_history(rows: DataFrame, path: str) -> None:
    """Adds epochs; the commit protocol makes it whole or absent."""
    rows.write.mode("append").parquet(path)


def append_state(state: DataFrame, path: str) -> None:
    """Adds the run states of ``history.track``; older ones stay, so a write that fails leaves them as they were."""
    state.write.mode("append").parquet(path)


def read_state(spark: SparkSession, path: str, group: str) -> DataFrame:
    """The latest state of each group."""
    rows = spark.read.parquet(path)
    return rows.groupBy(group).agg(F.max_by(F.struct(*[c for c in rows.columns if c != group]), F.coalesce("last_epoch", F.lit(-(1 << 62)))).alias("s")).select(group, "s.*")
