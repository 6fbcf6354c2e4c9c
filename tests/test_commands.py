import json

import numpy as np
import pytest

from gridloom.__main__ import main
from gridloom.sources import files as fi

HEADER = "SID,IDX_TRUE,BASIN,ISO_TIME,LAT,LON,WMO_WIND,SS_CAT"


def decode(content: bytes) -> dict:
    wind, *pixels = map(float, content.split())
    return {"bt": pixels, "wmo_wind": wind if wind >= 0 else None}


def predict(x, t, labels, winds):
    return x * 0.5 + labels[:, None] * 0.01


def trained(spark, batches, settings):
    trained.rows = batches.select("batch", "rel_path", "cond").collect()


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    root = tmp_path_factory.mktemp("data")
    (root / "nc/deep").mkdir(parents=True)
    lines = [HEADER]
    for i in range(40):
        wind = -1 if i == 7 else 20 + 4 * i
        at = root / "nc" / ("deep" if i % 2 else "")
        (at / f"{i}-s.nc").write_text(f"{wind} " + " ".join(str(200 + (i * 7 + k) % 90) for k in range(16)))
        lines.append(f"S{i // 4},{i},{'NA' if i % 3 else 'EP'},2001-0{i % 9 + 1}-01 00:00:00,{i - 20},1,{wind},{min(max((wind - 34) // 20, 0), 5)}")
    lines.append("S9,999,NA,2001-01-01 00:00:00,1,1,50,1")
    (root / "tracks.csv").write_text("\n".join(lines) + "\n")
    return root


def test_from_files_to_a_verified_pack(spark, place, capsys):
    at = f"file://{place}"
    decoder = ["--data-root", f"{at}/nc", "--decoder", "tests.test_commands:decode"]
    main(["index", *decoder, "--output", f"{at}/index", "--document"], spark)
    assert spark.read.parquet(f"{at}/index/table").count() == fi.read_index(spark, f"{at}/index/document", strict=True).count() == 35
    lines, table = fi.read_index_lines(spark, f"{at}/index/lines", strict=True), spark.read.parquet(f"{at}/index/table")
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, table.select(*lines.columns).collect()))
    main(["pack", *decoder, "--dataset-index", f"{at}/index", "--output-dir", f"{at}/packed", "--samples-per-shard", "8"], spark)
    document = json.loads(spark.read.text(f"{at}/packed/manifest").first()[0])
    assert document["num_samples"] == 35 and document["sample_shape"] == [16] and [(s["start"], s["stop"]) for s in document["shards"]] == [(0, 8), (8, 16), (16, 24), (24, 32), (32, 35)]
    paths = [r.rel_path for r in fi.read_rel_paths(spark, f"{at}/packed", 35).orderBy("global_index").collect()]
    assert paths == sorted(paths) and dict(spark.read.parquet(f"{at}/packed/rel_paths").dtypes)["label"] == "smallint"
    with pytest.raises(ValueError):
        fi.read_rel_paths(spark, f"{at}/packed", 36)
    main(["verify", *decoder, "--dataset-index", f"{at}/index", "--packed", f"{at}/packed"], spark)
    assert json.loads(capsys.readouterr().out.splitlines()[-1]) == {"n_missing": 0, "n_mislabelled": 0, "n_compared": 35, "n_reshaped": 0, "max_abs_diff": 0.0, "n_wrong_type": 0, "ok": True, "failed_checks": []}
    changed = place / "nc" / "20-s.nc"
    before = changed.read_text()
    changed.write_text(before.replace(" 2", " 9", 1))
    with pytest.raises(SystemExit):
        main(["verify", *decoder, "--dataset-index", f"{at}/index", "--packed", f"{at}/packed"], spark)
    changed.write_text(before)
    main(["train", "--packed", f"{at}/packed", "--dataset-index", f"{at}/index", "--trainer", "tests.test_commands:trained", "--steps", "3", "--batch-size", "4"], spark)
    assert len(trained.rows) == 12 and {r.batch for r in trained.rows} == {0, 1, 2} and all(r.cond.wind_kt >= 34 for r in trained.rows)


def test_splits(spark, place):
    at = f"file://{place}"
    main(["splits", "--csv-path", f"{at}/tracks.csv", "--data-root", f"{at}/nc", "--out-dir", f"{at}/splits"], spark)
    files = {s: {r.rel_path for r in fi.read_lines(spark, f"{at}/splits/files_{s}").collect()} for s in ("train", "val", "test")}
    storms = {s: {r.rel_path for r in fi.read_lines(spark, f"{at}/splits/storm_ids_{s}").collect()} for s in files}
    assert sum(map(len, files.values())) == 40 and sum(map(len, storms.values())) == 10
    for s, names in files.items():
        assert {f"S{int(n.split('/')[-1].split('-')[0]) // 4}" for n in names} == storms[s]
    report = json.loads(spark.read.text(f"{at}/splits/split_report").first()[0])
    assert report["storm_level"]["num_storms_total"] == 10 and sum(report["storm_level"]["strata_counts"].values()) == 10
    level = report["snapshot_level"]
    assert level["total_rows_after_mapping"] == 40 and level["missing_rows_dropped"] == 1
    assert {s: level[s]["num_snapshots"] for s in files} == {s: len(n) for s, n in files.items()}
    with pytest.raises(FileNotFoundError):
        fi.read_lines(spark, f"{at}/splits/none")


def test_sample_and_eval(spark, place):
    at = f"file://{place}"
    for name, more in (("class", ["--ss-cat", "3", "--guidance-scale", "2.0"]), ("free", ["--schedule", "cosine", "--uncond"]), ("default", [])):
        main(["sample", "--predictor", "tests.test_commands:predict", "--output", f"{at}/{name}", "--n", "4", "--image-size", "3", "--steps", "5", *more], spark)
    got = spark.read.parquet(f"{at}/class").collect()
    assert {(r.label, r.wind_kt) for r in got} == {(3, 104.0)} and all(len(r.x) == 9 and np.abs(r.x).max() <= 1 for r in got)
    assert {(r.label, r.wind_kt) for r in spark.read.parquet(f"{at}/free").collect()} == {(6, 0.0)}
    assert {(r.label, r.wind_kt) for r in spark.read.parquet(f"{at}/default").collect()} == {(5, 145.0)}
    (place / "c.yaml").write_text("data: {image_size: 2}\ndiffusion: {num_steps: 3, beta_schedule: cosine, loss_type: eps_mse}\n")
    main(["sample", "--predictor", "tests.test_commands:predict", "--output", f"{at}/configured", "--n", "1", "--config", f"{place}/c.yaml"], spark)
    assert len(spark.read.parquet(f"{at}/configured").first().x) == 4
    rows = [(c, kind, 10 * i + (kind == "gen"), [200.0 + c, 210.0 + i, 190.0, 400.0 if kind == "gen" else 300.0]) for c in (0, 1) for kind in ("real", "gen") for i in range(40)]
    spark.createDataFrame([*rows, (2, "real", 1, [200.0] * 4)], "class int, set string, id long, bt array<double>").write.parquet(f"{at}/images")
    for tag, heavy, n in (("light", [], 25), ("heavy", ["--heavy"], 50)):
        main(["eval", "--images", f"{at}/images", "--output", f"{at}/report", "--tag", tag, *heavy], spark)
        report = json.loads(spark.read.text(f"{at}/report/eval/{tag}/metrics").first()[0])
        assert (report["tag"], report["heavy"], report["n_per_class"]) == (tag, bool(heavy), n) and set(report["per_class"]) == {"0", "1"}
        own = report["per_class"]["1"]
        assert set(own) == {"gen_exceedance_rate", "pixel_stats", "pixel_hist_js", "pixel_hist_w1", "cold_cloud_fraction_200K", "eye_contrast_proxy", "psd_l2", "feature_mmd2", "diversity_feature_space"}
        assert own["pixel_stats"]["gen_raw"]["max"] == 400 and own["pixel_stats"]["gen_clipped"]["max"] == 310 and own["gen_exceedance_rate"]["above_bt_max"] == 0.25
        assert set(own["pixel_stats"]["real"]) == {"mean", "std", "skew", "kurtosis", "q01", "q05", "q50", "q95", "q99", "min", "max"}
        assert set(report["macro"]) == {"pixel_mean_bt", "eye_contrast_proxy"} and report["macro"]["pixel_mean_bt"]["mae_gen_vs_real"] > 20
        curves = spark.read.parquet(f"{at}/report/eval/{tag}/curves").groupBy("curve").count().collect()
        assert {r.curve: r["count"] for r in curves} == {"bt_bins": 258, "hist_real": 256, "hist_gen": 256} | {f"{c}_{s}_{k}": 192 for c in ("radial_mean", "radial_azstd", "psd") for s in ("real", "gen") for k in ("mu", "sd")}
    # the generated images of a light run are the first by id: 25 of 40
    assert json.loads(spark.read.text(f"{at}/report/eval/light/metrics").first()[0])["per_class"]["0"]["pixel_stats"]["gen_raw"]["mean"] == pytest.approx((200 + 210 + 12 + 190 + 400) / 4)
