from collections import Counter

import pytest

from gridloom.operators import training as tr
from gridloom.sources import files as fi


@pytest.fixture(scope="module")
def data(spark):
    rows = [(f"{c}-{i:02}.nc", c, 40.0 + 20 * c, [180.0 + i, 200.0 + c, 250.0, 310.0, 190.0, 205.0, 222.0, 240.0, 260.0]) for c, n in ((0, 40), (2, 8), (5, 2)) for i in range(n)]
    frame = spark.createDataFrame(rows, "rel_path string, ss_cat int, wind_kt double, bt array<double>")
    return frame.select("rel_path", "ss_cat", "wind_kt"), frame.select("rel_path", "bt")


def test_an_epoch_is_whole_batches_of_weighted_draws(spark, data):
    s = tr.Settings(steps=60, batch=5, seed=3)
    index, images = data
    got = {e: tr.epoch_batches(index, images, s, e, a).collect() for e, a in ((0, 1.0), (1, 0.0))}
    for rows in got.values():
        assert Counter(Counter(r.batch for r in rows).values()) == {5: 60} and sorted(r.place for r in rows) == sorted(r.draw for r in rows) == list(range(300))
        assert [r.draw for r in sorted(rows, key=lambda r: r.place)] != list(range(300))
        assert all(r.cond.wind_kt == 40 + 20 * r.cond.ss_cat and max(r.bt) == 1 for r in rows)
    rare = {e: sum(r.cond.ss_cat == 5 for r in rows) for e, rows in got.items()}
    assert rare[0] < 40 < 70 < rare[1]
    again = tr.epoch_batches(index, images, s, 1, 0.0).collect()
    assert sorted((r.place, r.rel_path) for r in again) == sorted((r.place, r.rel_path) for r in got[1])
    turned = tr.epoch_batches(index, images, tr.Settings(steps=60, batch=5, seed=3, augment=True), 1, 0.0).collect()
    pairs = {r.draw: (r.rel_path, r.bt) for r in turned}
    assert all(pairs[r.draw][0] == r.rel_path for r in got[1]) and 30 < sum(pairs[r.draw][1] != r.bt for r in got[1]) < 290


def test_validation_sets(data):
    sets = tr.validation(*data, tr.Settings(batch=8, per_class=3))
    assert Counter(r.batch for r in sets["full"].collect()) == {**dict.fromkeys(range(6), 8), 6: 2}
    assert Counter(r.cond.ss_cat for r in sets["balanced"].collect()) == {0: 3, 2: 3, 5: 2}


def test_runs_stop_and_go_on(spark, data, tmp_path):
    index, images = data
    losses = [5.0, 4.0, 4.5, 3.0, 3.5, 3.2, 3.1, 9.0]
    s = tr.Settings(epochs=8, steps=2, batch=4, patience=3, ramp={"start_alpha": 1.0, "end_alpha": 0.4, "ramp_epochs": 4, "mode": "linear"})

    def run(folder, epochs, resume=False):
        seen = []

        def step(batches, about):
            seen.append((about["epoch"], round(about["alpha"], 3), batches.count(), about["name"], sorted(about["validation"])))
            return {"train_loss": 1.0, "val_full": losses[about["epoch"] - 1], "val_balanced": None if about["epoch"] == 2 else losses[about["epoch"] - 1] / 2}

        last = tr.run(spark, index, images, step, tr.Settings(**{**s.__dict__, "epochs": epochs}), folder, resume, index.where("ss_cat = 0"), {"name": "x"})
        return last, seen

    whole, parts = f"{tmp_path}/whole", f"{tmp_path}/parts"
    last, seen = run(whole, 8)
    assert last == 7 and [e[:2] for e in seen] == [(1, 1.0), (2, 0.8), (3, 0.6), (4, 0.4), (5, 0.4), (6, 0.4), (7, 0.4)] and {e[2:4] for e in seen} == {(8, "x")} and seen[0][4] == ["balanced", "full"]
    assert run(parts, 3)[0] == 3 and [e[0] for e in run(parts, 8, True)[1]] == [4, 5, 6, 7] and run(parts, 8, True) == (7, [])
    for folder in (whole, parts):
        state = fi.read_state(spark, f"{folder}/state", "run").first()
        assert (state.best_epoch, state.best_full, state.bad, state.best_balanced, state.stopped_epoch) == (4, 3.0, 3, 1.5, 7)
        assert [r.epoch for r in fi.read_history(spark, f"{folder}/history").orderBy("epoch").collect()] == list(range(1, 8))
    with pytest.raises(ValueError):
        tr.run(spark, index, images, lambda b, a: None, s, resume=True)


def test_settings_from_a_configuration():
    config = {"data": {"batch_size": 4, "class_balance_alpha": 0.4, "class_balance_curriculum": {"enabled": False, "mode": "linear"}}, "training": {"num_epochs": 9, "early_stopping": {"enabled": True, "patience_epochs": 15, "min_delta": 0.1}}}
    s = tr.Settings.of(config, steps=7, batch=None, seed=1)
    assert (s.epochs, s.steps, s.batch, s.alpha, s.ramp, s.patience, s.min_delta, s.seed) == (9, 7, 4, 0.4, None, 15, 0.1, 1)
    assert tr.Settings.of({}).epochs == 1 and tr.Settings.of({}).patience is None
