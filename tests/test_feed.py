import hashlib
import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from gridloom.operators import feed


def test_elements(spark):
    images = spark.createDataFrame([("a", [180.0, 310.0]), ("b", [245.0, 0.0])], "rel_path string, bt array<double>")
    known = spark.createDataFrame([("a", 1, 70.5, False), ("z", 2, 89.0, True)], "rel_path string, ss_cat int, wind_kt double, is_fallback boolean")
    r = feed.elements(images, feed.require_some_wind(known)).collect()
    assert [(x.rel_path, x.bt, x.cond.asDict()) for x in r] == [("a", [-1, 1], {"ss_cat": 1, "wind_kt": 70.5})]
    assert feed.elements(images, known, use_wind=False).first().cond.asDict() == {"ss_cat": 1}
    with pytest.raises(ValueError):
        feed.require_some_wind(known.where("is_fallback"))
    with pytest.raises(ValueError, match="empty"):
        feed.require_rows(known.limit(0), "empty split")


def test_augmentation_is_off_on_and_repeats(spark):
    x = np.arange(16.0)
    df = spark.createDataFrame([(i, x.tolist()) for i in range(200)], "id int, x array<double>")
    assert all(r.x == x.tolist() for r in feed.augment(df, "x", 4, F.lit(0.0), 1, "id").collect())
    on = {r.id: r.x for r in feed.augment(df, "x", 4, F.lit(1.0), 1, "id").collect()}
    again = {r.id: r.x for r in feed.augment(df.repartition(5), "x", 4, F.lit(1.0), 1, "id").collect()}
    assert on == again and len({tuple(v) for v in on.values()}) > 50 and all(set(v) <= set(x) for v in on.values())
    barred = feed.augment(df, "x", 4, F.lit(1.0), 1, "id", max_bars=3)
    assert barred.columns == ["id", "x"] and {sum(x not in set(on[r.id]) for x in r.x) // 4 for r in barred.collect()} >= {0, 1, 2, 3}


def test_augmentation_turns_then_moves(spark):
    x = np.random.default_rng(0).random((40, 36))
    df = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (40, None)], "id int, x array<double>")
    got = {r.id: r.x for r in feed.augment(df, "x", 6, F.lit(1.0), 1, "id").collect()}
    assert got.pop(40) is None and len(got) == 40
    for i, v in got.items():
        k, dy, dx = hashlib.md5(f"1|{i}".encode()).digest()[4:7]
        padded = np.pad(np.rot90(x[i].reshape(6, 6), k % 4), 2, mode="reflect")
        assert np.array(v).reshape(6, 6).tolist() == padded[dy % 5 : dy % 5 + 6, dx % 5 : dx % 5 + 6].tolist()


def test_augmentation_computes_an_image_once(spark):
    """Not again for each pixel; nor the noise of a bar."""
    df = spark.createDataFrame([(i, [float(v) for v in range(16)]) for i in range(4)], "id int, x array<double>")
    plan = lambda bars: feed.augment(df, "x", 4, F.lit(1.0), 1, "id", max_bars=bars)._jdf.queryExecution().optimizedPlan().toString()
    for p in (plan(0), plan(3)):
        assert 0 < p.count("element_at(") == p.count("element_at(lambda")
    assert plan(0).count("element_at(") == 1


def test_batches_and_order(spark):
    df = spark.range(10).withColumnRenamed("id", "row")
    assert sorted({r.batch for r in feed.batches(df, "row", 4, True).collect()}) == [0, 1]
    assert sorted({r.batch for r in feed.batches(df, "row", 4, False).collect()}) == [0, 1, 2]
    assert feed.epoch(df, 2, 4, "row").count() == 8
    a, b = ([r.row for r in feed.shuffled(d, 3, "row").collect()] for d in (df, df.repartition(4)))
    assert a == b and a != sorted(a) and sorted(a) == list(range(10))
    with pytest.raises(ValueError):
        feed.batches(df, "row", 0, True)


def test_grid(spark):
    df = spark.createDataFrame([(i, [float(i + 1)] * 4) for i in range(4)], "place int, bt array<double>")
    got = {(r.y, r.x): r.v for r in feed.sample_grid(df, "place", 3, 2).collect()}
    assert len(got) == 24 and got[0, 0] == 1 and got[1, 5] == 3 and got[2, 1] == 4 and got[3, 4] == 0


def test_run_files(tmp_path):
    feed.write_run(tmp_path / "r", {"a": {"b": 1}}, {"name": "x"})
    assert yaml.safe_load((tmp_path / "r/config.yaml").read_text()) == {"a": {"b": 1}} and json.loads((tmp_path / "r/run.json").read_text()) == {"name": "x"}
