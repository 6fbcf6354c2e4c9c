"""How the test tables stand for the domain's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import ss_category
from gridloom.operators import catalog

SIDE = 8  # embeddings are 8 x 8 images
R_BINS, THETA_BINS, PSD_BINS = 4, 16, 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rel_path and wmo_wind from events; users divisible by 17 have no wind."""
    e = table(spark, sf_dir, "events")
    path = F.concat(F.col("event_id").cast("string"), F.lit("-"), F.col("user_id").cast("string"), F.lit(".nc"))
    return e.select(path.alias("rel_path"), F.when(F.col("user_id") % 17 != 0, F.col("value")).alias("wmo_wind"))


def index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.dataset_index(snapshots(spark, sf_dir))


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed track rows from orders."""
    o = table(spark, sf_dir, "orders")
    wind = F.col("o_totalprice") / 2500
    return o.select(
        F.col("o_custkey").alias("SID"), F.col("o_orderkey").alias("IDX_TRUE"), F.col("o_orderpriority").alias("BASIN"), F.col("o_orderdate").alias("ISO_TIME"),
        ((F.col("o_orderkey") * 37) % 121 - 60).cast("double").alias("LAT"), wind.alias("WMO_WIND"), ss_category(wind).alias("SS_CAT"), F.col("o_orderkey").alias("row_no"),
    )


def track_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for every order but those of a key divisible by 7; two for those divisible by 5."""
    o = table(spark, sf_dir, "orders").where("o_orderkey % 7 != 0")
    name = lambda s: F.concat(F.col("o_orderkey").cast("string"), F.lit(s))
    return o.select(name("-a.nc").alias("rel_path")).unionAll(o.where("o_orderkey % 5 = 0").select(name("-b.nc").alias("rel_path")))


def raw_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """class, set (even ids are real, odd ones generated), id, bt: real ones in the range, generated ones raw."""
    e = table(spark, sf_dir, "embeddings")
    real = F.col("vec_id") % 2 == 0
    kelvin = F.transform("embedding", lambda x: F.when(real, F.least(F.greatest((x.cast("double") * 2 + 1) * 65 + 180, F.lit(180.0)), F.lit(310.0))).otherwise((x.cast("double") * 3 + 1) * 65 + 180))
    return e.select((F.col("label") % 6).cast("int").alias("class"), F.when(real, "real").otherwise("gen").alias("set"), F.col("vec_id").alias("id"), kelvin.alias("bt"))


def clipped_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_images(spark, sf_dir).withColumn("bt", F.transform("bt", lambda x: F.least(F.greatest(x, F.lit(180.0)), F.lit(310.0))))


def noised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, label, t, x0 and eps: noise is the vector of the next id (the first for the last), doubled."""
    e = table(spark, sf_dir, "embeddings")
    x = e.select(F.col("vec_id").alias("id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("x0"))
    n = e.agg(F.count(F.lit(1)).alias("n"))
    other = x.select(F.col("id").alias("other"), F.transform("x0", lambda v: v * 2).alias("eps"))
    keyed = x.crossJoin(F.broadcast(n)).withColumn("other", (F.col("id") + 1) % F.col("n")).drop("n")  # n is one row
    return keyed.join(other, "other").select("id", "label", ((F.col("id") * 37) % 1000).cast("int").alias("t"), "x0", "eps")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run (user modulo 5), step (day number) and value: the mean event value of the day."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.to_date("ts"), F.lit("1970-01-01").cast("date"))
    return e.groupBy((F.col("user_id") % 5).alias("run"), day.cast("bigint").alias("step")).agg(F.avg("value").alias("value"))
