import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import feed
from gridloom.streaming import sampler as sa


def test_a_buffer_shuffles_within_its_reach(spark):
    rows = spark.range(0, 5000, 1, 3).select("id", F.array(F.col("id")).alias("more"))
    got = feed.buffered(rows, 16, 7)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    parts = got.withColumn("p", F.spark_partition_id()).collect()
    assert sorted(r.id for r in parts) == list(range(5000)) and all(r.more == [r.id] for r in parts)
    for p, begin in ((0, 0), (1, 1666), (2, 3333)):
        order = [r.id - begin for r in parts if r.p == p]
        assert order != sorted(order) and all(k >= i - 63 for k, i in enumerate(order))  # never sooner than a buffer allows
        assert sum(abs(k - i) for k, i in enumerate(order)) / len(order) > 16 and max(k - i for k, i in enumerate(order)) > 64
    again = [r.id for r in feed.buffered(rows, 16, 7).collect()]
    assert again == [r.id for r in got.collect()] and again != [r.id for r in feed.buffered(rows, 16, 7, epoch=1).collect()]
    small = spark.range(0, 10, 1, 1)
    assert sorted(r.id for r in feed.buffered(small, 16, 1).collect()) == list(range(10)) and feed.buffered(small.where("false"), 16, 1).count() == 0
    with pytest.raises(ValueError):
        feed.buffered(small, 0, 1)


def test_batches_of_any_size_give_one_order(spark):
    rows = spark.range(0, 3000, 1, 1)
    orders = []
    for size in (100, 2500):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        orders.append([r.id for r in feed.buffered(rows, 8, 3).collect()])
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(orders[0]) == sorted(orders[1]) == list(range(3000))


@pytest.fixture(scope="module")
def index(spark):
    rows = [(f"{c}-{i:03}.nc", c, 40.0 + 20 * c) for c, n in ((0, 200), (1, 20), (5, 2)) for i in range(n)]
    return spark.createDataFrame(rows, "rel_path string, ss_cat int, wind_kt double")


def test_weight_changes_and_restarts_agree(spark, index, tmp_path):
    def run(name, stops):
        at = tmp_path / name
        sa.set_alpha(spark, f"{at}/control", 0, 1.0)
        sa.set_alpha(spark, f"{at}/control", 2, 0.0)
        counts = [sa.sample_with_control(spark, index, f"{at}/control", 3, f"{at}/rows", f"{at}/checkpoint", n, 300) for n in stops]
        return counts, sorted(map(tuple, spark.read.parquet(f"{at}/rows").select("draw", "ss_cat", "rel_path", "alpha").collect()))

    whole, parts = run("whole", [4]), run("parts", [1, 3, 4])
    assert whole[1] == parts[1] and len(whole[1]) == 1200 and whole[0] == [4]
    rare = lambda low, high: sum(c == 5 for d, c, *_ in whole[1] if low <= d < high)
    assert rare(0, 600) < 30 < 130 < rare(600, 1200) and {(d >= 600, a) for d, _, _, a in whole[1]} == {(False, 1.0), (True, 0.0)}
    with pytest.raises(ValueError, match="no weight"):
        sa.set_alpha(spark, f"{tmp_path}/late", 5, 1.0)
        sa.alpha_of(spark, f"{tmp_path}/late", 4)


def test_stream_of_elements(spark, index, tmp_path):
    images = index.select("rel_path", F.array(F.lit(180.0), F.lit(310.0), F.lit(math.nan)).alias("bt"))
    stream = sa.elements_stream(spark, index, images, 0.5, 3, 50)
    assert sa.take_batches(stream, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", 2) == 2
    got = spark.read.parquet(f"{tmp_path}/rows").collect()
    assert sorted(r.draw for r in got) == list(range(100))
    assert all(r.bt == [-1.0, 1.0, -1.0] and r.cond.wind_kt == 40 + 20 * r.cond.ss_cat and r.rel_path.startswith(f"{r.cond.ss_cat}-") for r in got)
