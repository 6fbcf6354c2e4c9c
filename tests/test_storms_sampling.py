from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from gridloom.operators import sampling as sa
from gridloom.operators import storms as st
from gridloom.sources.files import read_tracks

HEADER = "SID,IDX_TRUE,BASIN,ISO_TIME,LAT,LON,WMO_WIND,SS_CAT"


@pytest.fixture(scope="module")
def tracks(spark, tmp_path_factory):
    lines = [
        HEADER, "A,1,NA,2001-07-01 00:00:00,12.0,1,50,0", "A,2,NA,2001-08-01 00:00:00,22.0,1,70,1", "A,3,EP,2001-09-01 00:00:00,32.0,1,70,2",
        "B,4,EP,2001-01-01 00:00:00,5.0,1,,", "B,x,WP,bad,,1,,", "C,2.0,WP,nonsense,,1,45,3", ",9,EP,2001-01-01 00:00:00,5,1,40,0",
    ]
    path = tmp_path_factory.mktemp("tracks") / "t.csv"
    path.write_text("\n".join(lines) + "\n")
    rows = read_tracks(spark, str(path))
    return st.coerce_tracks(rows.withColumn("row_no", F.monotonically_increasing_id()))


def test_storm_table(tracks):
    got = {r.SID: r for r in st.storm_table(tracks).collect()}
    assert set(got) == {"A", "B", "C"}
    a, b, c = got["A"], got["B"], got["C"]
    assert (a.BASIN_MODE, a.MAX_WMO_WIND, a.MAX_SS_CAT, a.MONTH_AT_PEAK, a.LAT_AT_PEAK, a.N_SNAPSHOTS) == ("NA", 70, 2, 8, 22, 3)
    assert a.STRATUM == "NA|ss2|JJA|lat20_30|n1_4"
    assert (b.BASIN_MODE, b.MAX_WMO_WIND, b.MAX_SS_CAT, b.MONTH_AT_PEAK, b.LAT_AT_PEAK) == ("EP", None, -1, 1, 5)
    assert (c.MONTH_AT_PEAK, c.LAT_BIN, c.SEASON_BIN) == (1, "lat30p", "DJF")


def test_coercion(tracks):
    assert [r.IDX_TRUE for r in tracks.orderBy("row_no").collect()] == [1, 2, 3, 4, None, 2, 9]
    with pytest.raises(ValueError, match="LAT"):
        st.require_columns(tracks.drop("LAT"))


SIZES = {1: (1, 0, 0), 2: (1, 1, 0), 3: (2, 0, 1), 4: (3, 0, 1), 5: (4, 0, 1), 6: (5, 1, 0), 8: (6, 1, 1), 10: (8, 1, 1), 13: (10, 1, 2), 15: (12, 2, 1), 25: (20, 2, 3), 30: (24, 3, 3)}


def test_split_sizes_and_no_leaks(spark):
    storms = spark.createDataFrame([(f"{n}-{i}", f"s{n}") for n in SIZES for i in range(n)], "SID string, STRATUM string")
    got = st.split_storms(storms).collect()
    count = defaultdict(Counter)
    for r in got:
        count[r.STRATUM][r.split] += 1
    assert {n: tuple(count[f"s{n}"][k] for k in ("train", "val", "test")) for n in SIZES} == SIZES
    assert len({r.SID for r in got}) == len(got) == sum(SIZES)
    assert sorted(map(tuple, got)) == sorted(map(tuple, st.split_storms(storms.repartition(7)).collect()))
    with pytest.raises(ValueError):
        st.split_storms(storms, 0.5, 0.1, 0.1)


def test_files_and_summaries(spark, tracks):
    files = spark.createDataFrame([("1-a.nc",), ("1-b.nc",), ("d/2-x.nc",), ("z.nc",)], "rel_path string")
    mapped = st.files_by_index(tracks, files)
    assert tuple(st.mapping_counts(mapped).first()) == (3, 4)
    split = spark.createDataFrame([("A", "s", "train"), ("C", "s", "val")], "SID string, STRATUM string, split string")
    placed = st.split_files(mapped, split)
    assert sorted((r.rel_path, r.split) for r in placed.collect()) == [("1-b.nc", "train"), ("d/2-x.nc", "train"), ("d/2-x.nc", "val")]
    only = mapped.where("SID = 'A' and rel_path is not null")
    assert {tuple(r) for r in st.split_summary(only, placed.where("split = 'train'")).collect()} == {("train", 2, 1)}
    assert {tuple(r) for r in st.split_counts(only, placed.where("split = 'train'"), "BASIN").collect()} == {("train", "NA", 2)}


@pytest.fixture(scope="module")
def index(spark):
    return spark.createDataFrame([(f"c{c}-{i:04}", c) for c, n in {0: 800, 1: 150, 4: 50}.items() for i in range(n)], "rel_path string, ss_cat int")


def test_probabilities(spark, index):
    p = {r.ss_cat: r.prob for r in sa.class_probabilities(index, 0.5).collect()}
    w = {0: 0.8**0.5, 1: 0.15**0.5, 4: 0.05**0.5}
    assert p == pytest.approx({c: v / sum(w.values()) for c, v in w.items()})
    counts = spark.createDataFrame([(0, 5, 0.5), (1, 0, 0.3), (2, 7, 0.0), (3, 1, 0.5)], "ss_cat int, n int, prob double")
    assert {r.ss_cat: r.prob for r in sa.set_probabilities(counts).collect()} == {0: 0.5, 3: 0.5}


def test_draws_follow_the_weights(index):
    got = sa.weighted_draws(index, 6000, 0.5, 1).collect()
    share = Counter(r.ss_cat for r in got)
    p = {r.ss_cat: r.prob for r in sa.class_probabilities(index, 0.5).collect()}
    assert len(got) == 6000 and all(abs(share[c] / 6000 - q) < 0.03 for c, q in p.items())
    assert all(r.rel_path.startswith(f"c{r.ss_cat}-") for r in got) and len({r.rel_path for r in got}) > 500


def test_ramp(spark):
    a = [r.alpha for r in sa.alpha_ramp(spark, 60, 1.0, 0.4, 5, 20, "linear").orderBy("epoch").collect()]
    assert a[:6] == [1.0] * 6 and a[24] == pytest.approx(0.4) and a[59] == pytest.approx(0.4) and a[15] == pytest.approx(1 - 0.6 * 10 / 19)
    assert [r.alpha for r in sa.alpha_ramp(spark, 3, ramp=1).collect()] == [0.4] * 3
    with pytest.raises(ValueError):
        sa.alpha_ramp(spark, 3, mode="steps")


def test_balanced_subset_and_split(spark, index):
    got = sa.per_class(index, 60, 42).collect()
    assert Counter(r.ss_cat for r in got) == {0: 60, 1: 60, 4: 50}
    assert sorted(map(tuple, got)) == sorted(map(tuple, sa.per_class(index.repartition(5), 60, 42).collect()))
    split = spark.createDataFrame([("c0-0001", "val"), ("c0-0001", "val"), ("nope", "val"), ("c1-0001", "train")], "rel_path string, split string")
    assert [r.rel_path for r in sa.in_split(index, split, "val").collect()] == ["c0-0001"]


def test_condition_dropout_is_joint(index):
    rows = index.select("rel_path", F.col("ss_cat").alias("label"), F.lit(50.0).alias("wind_kt"))
    got = sa.dropped_condition(rows, 0.1, 3, "rel_path").collect()
    gone = [r for r in got if r.label == 6]
    assert all((r.label == 6) == (r.wind_kt == 0) for r in got) and 60 < len(gone) < 140
