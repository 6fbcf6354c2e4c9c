"""Every query against its SQL on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridloom.plans import bindings
from gridloom.plans.oracles import ORACLES
from gridloom.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "orders", "lineitem", "embeddings", "documents", "labels")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def comparable(rows):
    """Rows in an order that rounding doesn't change."""

    def cell(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return None
        return v if isinstance(v, (str, bool)) else float(v)

    rows = [tuple(cell(v) for v in r) for r in rows]
    return sorted(rows, key=lambda r: [(v is None, round(v, 3) if isinstance(v, float) else str(v)) for v in sorted(enumerate(r), key=lambda x: isinstance(x[1], float)) for v in v[1:]])


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    want = comparable(duck.execute(f"SELECT {quoted} FROM ({ORACLES[name]})").fetchall())
    got = comparable(map(tuple, df.select(*columns).collect()))
    assert len(got) == len(want) and got
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=2e-5) if not any(isinstance(v, (str, bool)) or v is None for v in (*a, *b)) else all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-5 for x, y in zip(a, b)), (a, b)


def test_queries_without_sql_run(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        assert QUERIES[name](spark, SF).count() > 0, name


@pytest.mark.parametrize("name", ["augmented_elements", "rot90", "shift_reflect", "erase_bar"])
def test_images_are_computed_once(spark, name):
    """Neither again for each pixel nor in filters before the rows are made."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1 and "size(" not in plan
    assert plan.count("element_at(") == plan.count("element_at(lambda") == (name != "erase_bar")


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_does_not_import_the_language_model_part():
    root = Path(entry.__file__).parent
    for path in (root / "gridloom").rglob("*.py"):
        if "llm" not in path.parts:
            assert "gridloom.llm" not in path.read_text(), path


def test_whole_queries_take_every_row(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    got = QUERIES["upsample"](spark, SF).groupBy("id").count().collect()
    assert {(r.id, r["count"]) for r in got} == {(r.vec_id, 256) for r in vectors.select("vec_id").collect()}
    paths = {r.rel_path for r in bindings.index(spark, SF).select("rel_path").collect()}
    for name in ("shard_lookup", "point_lookup"):
        found = [r.rel_path for r in QUERIES[name](spark, SF).select("rel_path").collect()]
        assert len(found) == len(paths) and set(found) == paths
    assert QUERIES["time_embedding"](spark, SF).select("t").distinct().count() == 1000
    assert QUERIES["condition_embedding"](spark, SF).groupBy("id").count().where("count = 4").count() == len(got)
