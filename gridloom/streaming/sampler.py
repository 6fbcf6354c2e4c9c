"""The endless weighted sampler as a structured stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.images import normalize
from gridloom.operators.sampling import class_places, class_probabilities, cumulative, drawn
from gridloom.session import written


def sample_stream(spark: SparkSession, index: DataFrame, alpha: float, seed: int, rows_per_batch: int = 200) -> DataFrame:
    """draw, ss_cat and place of an endless stream of draws; the class table has a row per class. The weight
    ``alpha`` holds for one query: start another for another epoch's weight."""
    ranges = cumulative(class_probabilities(index, alpha))
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 2).load()
    return drawn(source.select(F.col("value").alias("draw")), ranges, seed).select("draw", "ss_cat", "place")


def elements_stream(spark: SparkSession, index: DataFrame, images: DataFrame, alpha: float, seed: int, rows_per_batch: int = 200) -> DataFrame:
    """draw, rel_path, bt in [-1, 1] and cond (class and wind) of an endless stream of draws. ``index`` has rel_path,
    ss_cat and wind_kt; each draw is looked up by class and place, then its image by path: joins with static tables."""
    places = written(class_places(index).join(index.select("rel_path", "wind_kt"), "rel_path"), "places")
    drawn_rows = sample_stream(spark, index, alpha, seed, rows_per_batch).join(places, ["ss_cat", "place"])
    rows = drawn_rows.join(images.select("rel_path", "bt"), "rel_path")
    return rows.select("draw", "rel_path", normalize("bt").alias("bt"), F.struct(F.col("ss_cat").cast("int").alias("ss_cat"), F.col("wind_kt").cast("float").alias("wind_kt")).alias("cond"))


def take_batches(stream: DataFrame, path: str, checkpoint: str, batches: int, change: Callable[[DataFrame, int], DataFrame] | None = None) -> int:
    """Write the micro-batches up to number ``batches`` as Parquet, each through ``change`` if given; how many were
    written by this call. A batch that runs again replaces its own folder."""
    done, last, beyond = 0, -1, False

    def put(rows: DataFrame, number: int) -> None:
        nonlocal done, last, beyond
        if number >= batches:
            beyond = True
            raise StopIteration("the batches asked for are written")  # so this one isn't committed, and comes again
        (change(rows, number) if change else rows).write.mode("overwrite").parquet(f"{path}/batch={number}")
        done, last = done + 1, number

    query = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).start()
    try:
        while query.isActive and last < batches - 1:
            query.awaitTermination(1)
    except StreamingQueryException:
        if not beyond:
            raise
    finally:
        query.stop()
    if query.exception() and not beyond:
        raise query.exception()
    return done


CONTROL = "first_batch long, alpha double"


def set_alpha(spark: SparkSession, control: str, first_batch: int, alpha: float) -> None:
    """From micro-batch ``first_batch`` on, classes are drawn with weight ``alpha``. A running sampler reads it before its
    next micro-batch; set it ahead of the batch that it names, and batches that run again draw what they drew."""
    spark.createDataFrame([(first_batch, float(alpha))], CONTROL).coalesce(1).write.mode("append").parquet(control)


def alpha_of(spark: SparkSession, control: str, batch: int) -> float:
    """The weight of a micro-batch: the latest entry at or before it (of equal ones the smaller)."""
    row = spark.read.schema(CONTROL).parquet(control).where(F.col("first_batch") <= batch).orderBy(F.col("first_batch").desc(), "alpha").limit(1).collect()
    if not row:
        raise ValueError(f"no weight for micro-batch {batch}")
    return row[0].alpha


def sample_with_control(spark: SparkSession, index: DataFrame, control: str, seed: int, path: str, checkpoint: str, batches: int, rows_per_batch: int = 200) -> int:
    """The endless sampler with a weight that changes under the running query: draw, ss_cat, rel_path and alpha of the
    micro-batches before number ``batches``, written below ``path``. Each micro-batch reads the control table anew; the
    number of a draw is that of the source, which the checkpoint keeps, so a query that is started again goes on with the
    next draws. How many micro-batches this call wrote."""
    source = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", rows_per_batch).option("numPartitions", 2).load()
    places = written(class_places(index), "places")

    def draw(rows: DataFrame, number: int) -> DataFrame:
        alpha = alpha_of(spark, control, number)
        ranges = cumulative(class_probabilities(places, alpha))
        return drawn(rows, ranges, seed).join(places, ["ss_cat", "place"]).select("draw", "ss_cat", "rel_path", F.lit(alpha).alias("alpha"))

    return take_batches(source.select(F.col("value").alias("draw")), path, checkpoint, batches, draw)
