"""A packed set, opened with its checks, and look-ups that read only the shards and row groups that hold the answer.

``open_packed`` reads the manifest and narrow columns (numbers, paths, labels) and no image. It raises ``ValueError`` for
another backend, a wrong number of paths or labels, paths that are there twice, no shards, ranges that aren't contiguous,
are empty or don't cover the set, shards whose rows aren't those of their range, and another type of image. Lengths of
images are checked row by row as they are read.

The manifest has a range a shard, which is a zone map of the set's numbers; paths are in the same order, so the list of
paths is pruned by its own row groups. A request of up to ``FEW`` rows is resolved on the driver to the shards it
touches, and only their folders are opened; a larger one is joined by shard and number.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW = 10_000
BACKEND = "parquet"


@dataclass(frozen=True)
class Shard:
    path: str
    start: int
    stop: int


@dataclass(frozen=True)
class PackedSet:
    spark: SparkSession
    location: str
    num_samples: int
    pixels: int
    shards: tuple[Shard, ...]

    def paths(self) -> DataFrame:
        """global_index, rel_path and label of all samples."""
        return self.spark.read.parquet(f"{self.location}/rel_paths")

    def shard_of(self, index: int) -> int:
        """The place of the shard that holds a number; ``IndexError`` out of range."""
        if not 0 <= index < self.num_samples:
            raise IndexError(f"packed sample index out of range: {index}")
        return bisect_right([s.start for s in self.shards], index) - 1

    def images(self, places: list[int] | None = None) -> DataFrame:
        """global_index, shard_id, rel_path, ss_cat and bt of all shards, or of some. An image of another length than the
        manifest's is an error when its row is read."""
        folders = [self.shards[p].path for p in (range(len(self.shards)) if places is None else places)]
        wanted = [f"{self.location}/samples"] if places is None else [f"{self.location}/{f}" for f in folders]
        rows = self.spark.read.option("basePath", f"{self.location}/samples").parquet(*wanted)
        size = F.coalesce(F.size("bt"), F.lit(-1))
        wrong = F.raise_error(F.format_string("image of %d pixels at %d, %d expected", size, F.col("global_index"), F.lit(self.pixels)))
        return rows.select("global_index", "shard_id", "rel_path", "ss_cat", F.when(size == self.pixels, F.col("bt")).otherwise(wrong).alias("bt"))

    def by_index(self, wanted: DataFrame) -> DataFrame:
        """The images of the ``global_index`` column, a row for each row asked for."""
        head = [r.global_index for r in wanted.select("global_index").limit(FEW + 1).collect()]
        if len(head) <= FEW:
            numbers = sorted(set(head))
            places = sorted({self.shard_of(n) for n in numbers})
            if not places:
                return self.images([0]).where("false")
            # numbers ascend within a shard, so the filter skips row groups as well
            rows = self.images(places).where(F.col("global_index").isin(numbers))
            return rows if len(numbers) == len(head) else rows.join(F.broadcast(wanted.select("global_index")), "global_index").select(*rows.columns)
        outside = wanted.where((F.col("global_index") < 0) | (F.col("global_index") >= self.num_samples) | F.col("global_index").isNull()).limit(1).collect()
        if outside:
            raise IndexError(f"packed sample index out of range: {outside[0].global_index}")
        rows = self.images()
        return rows.join(wanted.select("global_index"), "global_index").select(*rows.columns)

    def by_path(self, wanted: DataFrame) -> DataFrame:
        """The images of the ``rel_path`` column, a row for each row asked for; a path that isn't there is a ``KeyError``."""
        head = [r.rel_path for r in wanted.select("rel_path").limit(FEW + 1).collect()]
        if len(head) <= FEW:
            found = {r.rel_path: r.global_index for r in self.paths().where(F.col("rel_path").isin(sorted({p for p in head if p is not None}))).collect()}
            for p in head:
                if p not in found:
                    raise KeyError(p)
            return self.by_index(self.spark.createDataFrame([(found[p],) for p in head], "global_index long"))
        absent = wanted.select("rel_path").join(self.paths(), "rel_path", "left_anti").limit(1).collect()
        if absent:
            raise KeyError(absent[0].rel_path)
        rows = self.images()
        numbers = wanted.select("rel_path").join(self.paths().select("rel_path", "global_index"), "rel_path").select("global_index")
        return rows.join(numbers, "global_index").select(*rows.columns)


def _ranges(shards: tuple[Shard, ...], n: int) -> None:
    if not shards:
        raise ValueError("the manifest has no shards")
    before = 0
    for s in shards:
        if s.start != before:
            raise ValueError(f"shards must be contiguous: {s.path} starts at {s.start}, {before} expected")
        if s.stop <= s.start:
            raise ValueError(f"invalid bounds [{s.start}, {s.stop}) of {s.path}")
        before = s.stop
    if before != n:
        raise ValueError(f"shards cover {before} samples, {n} expected")


def open_packed(spark: SparkSession, location: str) -> PackedSet:
    """The packed set below ``location`` once all its checks have passed."""
    location = location.rstrip("/")
    document = json.loads("\n".join(r.value for r in spark.read.text(f"{location}/manifest").collect()))  # one document
    if document.get("backend") != BACKEND:
        raise ValueError(f"backend {document.get('backend')!r}, {BACKEND!r} expected")
    shards = tuple(Shard(s["path"], int(s["start"]), int(s["stop"])) for s in document["shards"])
    out = PackedSet(spark, location, int(document["num_samples"]), int(document["sample_shape"][0]), shards)
    listed = out.paths().agg(F.count("rel_path").alias("n"), F.count("label").alias("labels"), F.min("global_index").alias("low"), F.max("global_index").alias("high")).first()
    if listed.n != out.num_samples:
        raise ValueError(f"{listed.n} paths, {out.num_samples} expected")
    twice = out.paths().groupBy("rel_path").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"a path is there twice: {twice[0].rel_path}")
    if listed.labels != out.num_samples:
        raise ValueError(f"{listed.labels} labels, {out.num_samples} expected")
    _ranges(shards, out.num_samples)
    samples = spark.read.parquet(f"{location}/samples")
    kind = dict(samples.dtypes)["bt"]
    if kind != "array<float>" or document["dtype"] != "float32":
        raise ValueError(f"images of type {kind}, manifest says {document['dtype']}")
    # one row a shard, as the manifest has
    found = {f"samples/shard_id={r.shard_id}": (r.low, r.high + 1, r.n) for r in samples.groupBy("shard_id").agg(F.min("global_index").alias("low"), F.max("global_index").alias("high"), F.countDistinct("global_index").alias("n")).collect()}
    for s in shards:
        if found.pop(s.path, None) != (s.start, s.stop, s.stop - s.start):
            raise ValueError(f"{s.path} doesn't hold [{s.start}, {s.stop})")
    if found:
        raise ValueError(f"shards that the manifest lacks: {sorted(found)[0]}")
    return out
