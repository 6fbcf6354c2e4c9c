import json
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gridloom.operators import catalog as ca
from gridloom.sources import files as fi


@pytest.fixture(scope="module")
def snapshots(spark):
    rows = [(f"{i}-a.nc", w) for i, w in enumerate([None, math.nan, 34.9, 35.0, 63.5, 64.0, 136.5, 120.0, 100.0, 90.0, 40.0])]
    return spark.createDataFrame(rows, "rel_path string, wmo_wind double")


def test_index_and_meta(snapshots):
    assert tuple(ca.index_meta(snapshots).first()) == (11, 7, 1, 3)
    assert {r.ss_cat: r.n for r in ca.class_counts(ca.dataset_index(snapshots)).collect()} == {0: 2, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1}


def test_index_document_round_trip(spark, snapshots, tmp_path):
    document = ca.index_json(snapshots, "/data")
    tree = json.loads(document.first().value)
    assert tree["classes"]["0"] == ["10-a.nc", "3-a.nc"] and tree["samples"]["3-a.nc"] == {"ss_cat": 0, "wmo_wind_kt": 35.0} and tree["meta"]["num_files_total"] == 11
    fi.write_json(document, f"{tmp_path}/index")
    back = {r.rel_path: (r.ss_cat, r.wmo_wind_kt) for r in fi.read_index(spark, f"{tmp_path}/index").collect()}
    assert back == {r.rel_path: (r.ss_cat, r.wmo_wind_kt) for r in ca.dataset_index(snapshots).collect()}


def test_index_with_bad_metadata(spark, tmp_path):
    tree = {"meta": {}, "classes": {"0": ["a", "b"], "x": ["c"], "1": ["d"]}, "samples": {"a": {"ss_cat": 0, "wmo_wind_kt": "nan"}, "b": {"ss_cat": "no", "wmo_wind_kt": 40}, "d": {"ss_cat": 1, "wmo_wind_kt": 70.5}}}
    (tmp_path / "i.json").write_text(json.dumps(tree))
    assert sorted(map(tuple, fi.read_index(spark, f"{tmp_path}/i.json").collect()), key=str) == [("a", 0, None), ("b", 0, None), ("d", 1, 70.5)]


def test_dense_index_is_gapless_and_ordered(spark):
    df = spark.range(5000).select(F.md5(F.col("id").cast("string").cast("binary")).alias("rel_path"), F.lit(1).alias("ss_cat"))
    rows = ca.dense_index(df, ["rel_path"], "n", 13).orderBy("n").collect()
    assert [r.n for r in rows] == list(range(5000)) and [r.rel_path for r in rows] == sorted(r.rel_path for r in rows)


def test_packing_and_lookup(spark, tmp_path):
    index = spark.createDataFrame([(f"p{i:03}", i % 6) for i in range(100)], "rel_path string, ss_cat int")
    packed = ca.pack(index, 30).cache()
    shards = ca.manifest(packed)
    assert sorted((r.shard_id, r.start, r.stop) for r in shards.collect()) == [(0, 0, 30), (1, 30, 60), (2, 60, 90), (3, 90, 100)]
    assert all(r.failures == 0 for r in ca.validate_pack(packed, shards, 100).collect())
    ca.write_packed(packed, f"{tmp_path}/p")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 100
    with pytest.raises(Exception, match="(?i)exists"):
        ca.write_packed(packed, f"{tmp_path}/p")
    ca.write_packed(packed, f"{tmp_path}/p", overwrite=True)
    ask = packed.where("global_index % 9 = 0").select("global_index")
    for per in (30, None):
        got = ca.find_shards(ask, shards, per).collect()
        assert len(got) == 12 and all(r.start <= r.global_index < r.stop and r.shard_id == r.global_index // 30 for r in got)
    with pytest.raises(ValueError):
        ca.pack(index, 0)


def test_validation_finds_faults(spark):
    packed = spark.createDataFrame([(0, "a", 1), (1, "a", None), (2, "c", 2)], "global_index long, rel_path string, ss_cat int")
    shards = spark.createDataFrame([(0, 0, 1), (1, 2, 2)], "shard_id int, start long, stop long")
    got = {r["check"]: r.failures for r in ca.validate_pack(packed, shards, 4).collect()}
    assert got == {"contiguous": 1, "nonempty_shards": 1, "covers_all": 1, "unique_paths": 1, "labels_present": 1, "expected_count": 1}


def test_fallback_missing_and_mismatches(spark):
    index = spark.createDataFrame([("a", 0), ("b", 1), ("c", 5), ("d", 2)], "rel_path string, ss_cat int")
    meta = spark.createDataFrame([("a", 40.0), ("b", math.nan), ("c", None)], "rel_path string, wmo_wind_kt double")
    assert sorted(tuple(r) for r in ca.wind_fallback(index, meta).collect()) == [("a", 0, 40.0, False), ("b", 1, 73.0, True), ("c", 5, 145.0, True), ("d", 2, 89.0, True)]
    assert tuple(ca.packed_missing(index, meta).first()) == (1, "d")
    other = spark.createDataFrame([("a", 0), ("b", 2)], "rel_path string, other int")
    assert [tuple(r) for r in ca.label_mismatches(index, other, "rel_path", "ss_cat", "other").collect()] == [("b", 1, 2)]
    twice = spark.createDataFrame([(0, "x"), (3, "x"), (1, "y")], "ss_cat int, rel_path string")
    assert {r.rel_path: r.ss_cat for r in ca.path_classes(twice).collect()} == {"x": 3, "y": 1}


def test_array_differences_and_nan(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.5]), ([math.nan, 1.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(ca.array_max_abs_diff(df, "a", "b")).collect()] == [0.5, math.inf]
    assert [r[0] for r in df.select(ca.array_max_abs_diff(df, "a", "b", nan_passes=True)).collect()] == [0.5, 0.0]


def test_files(spark, tmp_path):
    (tmp_path / "root/x").mkdir(parents=True)
    for name in ("1-a.nc", "x/2-b.nc", "x/skip.txt"):
        (tmp_path / "root" / name).write_bytes(b"12.5")
    root = f"file://{tmp_path}/root"
    assert sorted(r.rel_path for r in fi.scan_tree(spark, root).collect()) == ["1-a.nc", "x/2-b.nc"]
    with pytest.raises(FileNotFoundError):
        fi.scan_tree(spark, root, "*.zip")
    got = fi.read_images(spark, root, "files", lambda b: {"bt": [float(b)], "wmo_wind": 50.0}).collect()
    assert {(r.rel_path, tuple(r.bt), r.wmo_wind) for r in got} == {("1-a.nc", (12.5,), 50.0), ("x/2-b.nc", (12.5,), 50.0)}
    with pytest.raises(ValueError):
        fi.read_images(spark, root, "other")
    (tmp_path / "list.txt").write_text("a\n\n b \na\n")
    assert sorted(r.rel_path for r in fi.read_lines(spark, f"{tmp_path}/list.txt").collect()) == ["a", "b"]
    split = spark.createDataFrame([("a", "train"), ("b", "val")], "rel_path string, split string")
    fi.write_splits(split, f"{tmp_path}/splits")
    assert [r.rel_path for r in fi.read_lines(spark, f"{tmp_path}/splits/split=val").collect()] == ["b"]
    fi.write_lines(split, "rel_path", f"{tmp_path}/lines")
    assert spark.read.text(f"{tmp_path}/lines").count() == 2


def test_history_table(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1.0, 2.0, None)], "epoch int, train_loss double, val_full double, val_balanced double")
    for _ in range(2):
        fi.append_history(rows, f"{tmp_path}/h")
    assert Counter(r.epoch for r in fi.read_history(spark, f"{tmp_path}/h").collect()) == {0: 2}
