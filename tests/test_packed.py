import json

import pytest

from gridloom.operators import catalog
from gridloom.sources import packed as pk

ROWS = [(f"p{i:03}", i % 6, [float(i), 1.0, 2.0, 3.0]) for i in range(100)]


@pytest.fixture
def place(spark, tmp_path):
    images = spark.createDataFrame(ROWS, "rel_path string, ss_cat int, bt array<float>")
    catalog.write_pack(catalog.pack(images, 15), f"{tmp_path}/p", 15)
    return tmp_path / "p"


def change(place, **fields):
    for f in place.glob("manifest/part*"):
        document = json.loads(f.read_text()) | fields
        f.write_text(json.dumps(document))
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def test_opens_and_looks_up(spark, place, monkeypatch):
    got = pk.open_packed(spark, str(place))
    assert got.num_samples == 100 and got.pixels == 4 and len(got.shards) == 7 and got.images().count() == 100
    ask = spark.createDataFrame([("p003",), ("p099",), ("p003",)], "rel_path string")
    for few in (pk.FEW, 1):  # on the driver, then by joins
        monkeypatch.setattr(pk, "FEW", few)
        assert sorted((r.rel_path, r.global_index, r.bt[0]) for r in got.by_path(ask).collect()) == [("p003", 3, 3.0), ("p003", 3, 3.0), ("p099", 99, 99.0)]
        numbers = spark.createDataFrame([(14,), (15,), (50,)], "global_index long")
        assert sorted((r.global_index, r.shard_id, r.ss_cat) for r in got.by_index(numbers).collect()) == [(14, 0, 2), (15, 1, 3), (50, 3, 2)]
        with pytest.raises(KeyError, match="absent"):
            got.by_path(spark.createDataFrame([("p001",), ("absent",)], "rel_path string"))
        with pytest.raises(IndexError):
            got.by_index(spark.createDataFrame([(1,), (100,)], "global_index long"))
    monkeypatch.undo()
    assert got.by_index(spark.createDataFrame([], "global_index long")).count() == 0


def test_only_the_shards_asked_for_are_read(spark, place):
    got = pk.open_packed(spark, str(place))
    one = got.by_path(spark.createDataFrame([("p020",), ("p025",), ("p095",)], "rel_path string"))
    assert {f.split("shard_id=")[1].split("/")[0] for f in one.inputFiles()} == {"1", "6"} and one.count() == 3
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(global_index, [20,25,95])]" in plan


@pytest.mark.parametrize(
    "fields,message",
    [
        ({"backend": "other"}, "backend 'other'"),
        ({"num_samples": 99}, "100 paths, 99 expected"),
        ({"shards": []}, "no shards"),
        ({"shards": [{"path": "samples/shard_id=0", "start": 1, "stop": 100}]}, "contiguous"),
        ({"shards": [{"path": "samples/shard_id=0", "start": 0, "stop": 0}]}, "invalid bounds"),
        ({"shards": [{"path": "samples/shard_id=0", "start": 0, "stop": 90}]}, "cover 90"),
        ({"shards": [{"path": "samples/shard_id=0", "start": 0, "stop": 100}]}, "doesn't hold"),
        ({"dtype": "float64"}, "float64"),
    ],
)
def test_wrong_manifests_raise(spark, place, fields, message):
    change(place, **fields)
    with pytest.raises(ValueError, match=message):
        pk.open_packed(spark, str(place))


def test_wrong_contents_raise(spark, place):
    change(place, sample_shape=[5])
    with pytest.raises(Exception, match="image of 4 pixels at"):
        pk.open_packed(spark, str(place)).images().collect()
    change(place, sample_shape=[4])
    paths = spark.read.parquet(f"{place}/rel_paths").collect()
    for bad, message in (([(r.global_index, "same", r.label) for r in paths], "twice"), ([(r.global_index, r.rel_path, None) for r in paths], "0 labels")):
        spark.createDataFrame(bad, "global_index long, rel_path string, label smallint").write.mode("overwrite").parquet(f"{place}/rel_paths")
        with pytest.raises(ValueError, match=message):
            pk.open_packed(spark, str(place))
