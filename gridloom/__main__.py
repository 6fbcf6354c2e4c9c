"""Commands: index, splits, pack, verify, train, eval, sample.

    python -m gridloom index --data-root ROOT --output DIR

Image files are of the classic array format; for others, a ``--decoder`` turns a file's bytes into ``{"bt": [...],
"wmo_wind": number or None}``. Networks (``--predictor``) and training steps (``--trainer``) are the caller's functions too.
Locations may be of any file system that Spark reads.
"""

from __future__ import annotations

import argparse
import importlib
import json
import math
from collections.abc import Callable, Sequence
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import config as cf
from gridloom.operators import catalog, diffusion, evaluation, feed, storms, training
from gridloom.session import written
from gridloom.sources import files, netcdf, packed


def load(name: str) -> Callable[..., Any]:
    """The function that ``module:function`` names."""
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _now() -> str:
    return datetime.now(UTC).isoformat()


def _images(spark: SparkSession, a: argparse.Namespace, *columns: str) -> DataFrame:
    """Columns ``columns`` of the image files: only those are read from files of the classic format."""
    kinds = {"bt": "array<float>", "wmo_wind": "double"}
    if a.decoder is None:
        return netcdf.read_files(spark, a.data_root, ", ".join(["rel_path string", *(f"{c} {kinds[c]}" for c in columns)]), a.pattern)
    return files.decode_files(spark, a.data_root, load(a.decoder), "bt array<float>, wmo_wind double", a.pattern)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Classifies the files below a root and writes the index: JSON lines, a table and, if asked, one document."""
    found = written(_images(spark, a, "wmo_wind").select("rel_path", "wmo_wind"), "snapshots")
    feed.require_rows(found, f"no {a.pattern} below {a.data_root}")
    files.write_json(catalog.index_lines(found, a.data_root), f"{a.output}/lines")
    if a.document:  # one row with every path: for small sets
        files.write_json(catalog.index_json(found, a.data_root), f"{a.output}/document")
    catalog.dataset_index(found).write.parquet(f"{a.output}/table")


def splits(spark: SparkSession, a: argparse.Namespace) -> None:
    """Storms to train, val and test: six lists and a report."""
    tracks = storms.coerce_tracks(files.read_tracks(spark, a.csv_path))
    mapped = written(storms.files_by_index(tracks, files.scan_tree(spark, a.data_root, a.pattern)), "mapped")
    table = written(storms.storm_table(mapped.where(F.col("rel_path").isNotNull())), "storms")
    split = written(storms.split_storms(table, a.frac_train, a.frac_val, a.frac_test, a.seed), "split")
    listed = storms.split_files(mapped, split)
    files.write_split_lists(spark, split, listed, a.out_dir)
    about = {"created_at": _now(), "csv_path": a.csv_path, "data_root": a.data_root, "fractions": json.dumps([a.frac_train, a.frac_val, a.frac_test]), "seed": str(a.seed)}
    files.write_json(storms.split_report(table, mapped, listed, about), f"{a.out_dir}/split_report")


def pack(spark: SparkSession, a: argparse.Namespace) -> None:
    """Indexed images in path order, in shards, with a manifest."""
    indexed = files.read_index_lines(spark, f"{a.dataset_index}/lines", strict=True)
    images = _images(spark, a, "bt").select("rel_path", "bt")
    packed = written(catalog.pack(indexed.join(images, "rel_path", "left"), a.samples_per_shard), "packed")
    catalog.write_pack(packed, a.output_dir, a.samples_per_shard, {"created_at": _now(), "data_root": a.data_root, "dataset_index": a.dataset_index}, a.overwrite)


def verify(spark: SparkSession, a: argparse.Namespace) -> None:
    """Compares a packed set with its index and its sources; a difference is an error."""
    packed = files.read_images(spark, f"{a.packed}/samples")
    document = json.loads(spark.read.text(f"{a.packed}/manifest").first()[0])
    files.read_rel_paths(spark, a.packed, document["num_samples"])
    checks = catalog.validate_pack(packed, catalog.manifest(packed), document["num_samples"], document["sample_shape"][0])
    failed = [r.check for r in checks.where("failures > 0").collect()]  # a row per kind of check
    indexed = files.read_index_lines(spark, f"{a.dataset_index}/lines")
    row = catalog.verify_pack(packed, indexed, _images(spark, a, "bt"), a.num_samples, a.seed, a.atol).first().asDict()
    print(json.dumps(row | {"failed_checks": failed}))
    if failed or not row["ok"]:
        raise SystemExit(1)


def train(spark: SparkSession, a: argparse.Namespace) -> None:
    """Runs the caller's training step over epochs of weighted, shuffled and augmented batches, with history, early
    stopping and --resume. The step is called with (spark, batches, settings): settings have the configuration, epoch,
    alpha and the validation sets; it may return train_loss, val_full and val_balanced."""
    config = cf.load(a.config, a.override) if a.config else {}
    indexed = files.read_index_lines(spark, f"{a.dataset_index}/lines")
    conditions = written(catalog.wind_fallback(indexed, indexed), "conditions")
    learned, held_out = conditions, None
    if a.split_dir:
        listed = lambda name: conditions.join(files.read_lines(spark, f"{a.split_dir}/files_{name}"), "rel_path", "left_semi")
        learned, held_out = feed.require_rows(listed("train"), "no indexed file is in the train split"), listed("val")
    own = training.Settings.of(config, epochs=a.epochs, steps=a.steps, batch=a.batch_size, alpha=a.alpha, seed=a.seed, augment=a.augment or None, patience=a.patience)
    step = load(a.trainer)
    images = packed.open_packed(spark, a.packed).images()
    last = training.run(spark, learned, images, lambda batches, about: step(spark, written(batches, "batches"), about), own, a.out_dir, a.resume, held_out, config)
    print(json.dumps({"last_epoch": last}))


def evaluate(spark: SparkSession, a: argparse.Namespace) -> None:
    """The whole suite of observed and generated images (columns class, set, id, bt): a report and its curves."""
    settings = cf.evaluation(cf.load(a.config, a.override) if a.config else {})
    images = spark.read.parquet(a.images)
    pixels = feed.require_rows(images, f"no images in {a.images}").select(F.size("bt").alias("n")).first().n
    if math.isqrt(pixels) ** 2 != pixels:
        raise ValueError(f"images of {pixels} pixels aren't square")
    n = int(settings["n_per_class_heavy" if a.heavy else "n_per_class_light"])
    numbers, curves = evaluation.suite(images, math.isqrt(pixels), n, int(settings["profile_bins"]), int(settings["psd_bins"]), seed=int(settings["real_seed"]))
    about = {"tag": a.tag, "heavy": a.heavy, "n_per_class": n, "n_plot_per_group": int(settings["n_plot_per_group"])}
    files.write_json(spark.createDataFrame([(evaluation.document(numbers, about),)], "value string"), f"{a.output}/eval/{a.tag}/metrics")
    curves.write.parquet(f"{a.output}/eval/{a.tag}/curves")


def sample(spark: SparkSession, a: argparse.Namespace) -> None:
    """Images of a class (5 by default; unconditional ones with --uncond) from the caller's network, as Parquet. A
    configuration gives image size, steps, schedule and loss type where the options don't."""
    config = cf.load(a.config, a.override) if a.config else {}
    data, own = config.get("data") or {}, config.get("diffusion") or {}
    pick = lambda given, tree, key, default: given if given is not None else tree.get(key, default)
    size, steps = int(pick(a.image_size, data, "image_size", 64)), int(pick(a.steps, own, "num_steps", 1000))
    p = float(own.get("dynamic_threshold_p", 0.995)) if own.get("dynamic_threshold", True) else None
    label = F.lit(None) if a.uncond else F.lit(a.ss_cat)
    asked = spark.range(a.n).select("id", label.cast("int").alias("label"), F.lit(None if a.uncond else a.wind_kt).cast("double").alias("wind_kt"))
    out = diffusion.sample_loop(asked, load(a.predictor), size**2, steps, pick(a.kind, own, "loss_type", "v"), p, seed=a.seed, schedule_name=pick(a.schedule, own, "beta_schedule", "linear"), guidance=a.guidance_scale)
    out.write.parquet(a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="gridloom", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    commands = top.add_subparsers(required=True)

    def command(run: Callable, name: str, *required: str, **defaults: Any) -> argparse.ArgumentParser:
        own = commands.add_parser(name, help=run.__doc__)
        own.set_defaults(run=run)
        for option in required:
            own.add_argument(f"--{option}", required=True)
        for option, value in defaults.items():
            flag = f"--{option.replace('_', '-')}"
            if isinstance(value, bool):
                own.add_argument(flag, action="store_true")
            else:
                own.add_argument(flag, default=value, type=type(value) if value is not None else str)
        return own

    command(index, "index", "data-root", "output", decoder=None, pattern="*.nc", document=False)
    command(splits, "splits", "csv-path", "data-root", "out-dir", pattern="*.nc", frac_train=0.8, frac_val=0.1, frac_test=0.1, seed=42)
    command(pack, "pack", "data-root", "dataset-index", "output-dir", decoder=None, pattern="*.nc", samples_per_shard=4096, overwrite=False)
    command(verify, "verify", "data-root", "dataset-index", "packed", decoder=None, pattern="*.nc", num_samples=256, seed=42, atol=0.0)
    own = command(train, "train", "packed", "dataset-index", "trainer", config=None, split_dir=None, out_dir=None, seed=42, augment=False, resume=False)
    own.add_argument("--override", action="append", default=[])
    for option, kind in (("epochs", int), ("steps", int), ("batch-size", int), ("alpha", float), ("patience", int)):
        own.add_argument(f"--{option}", type=kind)  # where absent, the configuration's
    own = command(evaluate, "eval", "images", "output", config=None, tag="manual", heavy=False)
    own.add_argument("--override", action="append", default=[])
    own = command(sample, "sample", "predictor", "output", n=16, config=None, kind=None, schedule=None, guidance_scale=0.0, seed=0, ss_cat=5, uncond=False)
    own.add_argument("--override", action="append", default=[])
    own.add_argument("--image-size", type=int)
    own.add_argument("--steps", type=int)
    own.add_argument("--wind-kt", type=float)
    return top


def main(arguments: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or SparkSession.builder.getOrCreate(), a)


if __name__ == "__main__":
    main()
