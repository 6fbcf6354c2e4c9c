import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import graph_index as gi
from gridloom.llm.common import table


def plain(ids, x, queries, k):
    out = {}
    for q, v in queries:
        score = (x * v).sum(axis=1)
        order = np.lexsort([ids, -score])
        out[q] = [(int(ids[i]), float(score[i])) for i in order if ids[i] != q][:k]
    return out


def test_recall_against_brute_force(spark):
    e = table(spark, "/root/testdata/sf0.1", "embeddings")
    rows = e.select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = plain(ids, x, [(int(i), v) for i, v in zip(ids, x) if i % 20 == 0], 20)
    got = {}
    for r in gi.nearest(e).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    recall = np.mean([len({v for _, v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    scores = {q: dict(zip(ids.tolist(), (x * x[list(ids).index(q)]).sum(axis=1))) for q in list(want)[:20]}
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21))
        assert [(-s, v) for _, v, s in hits] == sorted((-s, v) for _, v, s in hits)
        if q in scores:
            assert all(abs(s - scores[q][v]) < 1e-12 for _, v, s in hits)


@pytest.fixture(scope="module")
def odd(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 0.5]) for i in range(0, 100)] + [(200, [2.0, 1.0]), (201, [-1.0, 0.0]), (220, None), (240, []), (260, [0.0, 0.0]), (280, [nan, 1.0]), (300, [inf, 1.0]), (320, [None, 1.0]), (None, [1.0, 1.0]), (340, [1.0, 2.0, 3.0]), (341, [1.0, 0.0, 0.0]), (0, [1.0, 0.5])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS label", "2 AS rank", "0.5D AS score", "3 AS shard", "4 AS ids", "5 AS dim", "6 AS block")


def test_copies_ties_and_bad_vectors(odd):
    got = {}
    for r in gi.nearest(odd).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 20, 40, 60, 80, 200, 340}
    assert sorted(got[340]) == [(1, 341, 1.0)]
    assert [v for _, v, _ in sorted(got[20])] == [200, *[i for i in range(0, 20)]][:20]
    assert [v for _, v, _ in sorted(got[0])] == [200, *range(1, 20)]
    assert [v for _, v, _ in sorted(got[200])] == list(range(20))


def test_many_shards(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)) * rng.uniform(0.2, 3, (600, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    index = gi.build_index(gi.usable(df), 11, shard_rows=150)
    assert index.count() == 4
    queries = gi.usable(df).where("vec_id % 20 = 0")
    got = {}
    for r in gi.search(queries, index, 10, query_block=7).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = plain(np.arange(600), x, [(i, x[i]) for i in range(0, 600, 20)], 10)
    assert np.mean([len(got[q] & {v for v, _ in want[q]}) / 10 for q in want]) >= 0.9


def test_fewer_candidates_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.1, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(gi.nearest(df).collect())] == [(0, 1, 1), (0, 2, 2)]
    assert gi.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("norm", [1.0, 1e4, 1e8, 1e25, 1e-25])
def test_a_vector_of_odd_length_hides_no_other(norm):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(4000, 32))
    x /= np.sqrt((x * x).sum(1))[:, None]
    x[7] *= norm
    x[20] *= norm
    index = gi._build_shard(pa.table({"shard": [0] * len(x), "embedding": x.tolist(), "ids": [[i] for i in range(len(x))]}))
    asked = np.arange(0, 4000, 20)
    q, v, _ = gi.Shard(index.to_pylist()[0]).search(asked, x[asked], 20, gi.BEAM)
    found = set(zip(q.tolist(), v.tolist()))
    want = plain(np.arange(4000), x, [(int(i), x[i]) for i in asked], 20)
    assert sum((q, v) in found for q in want for v, _ in want[q]) / (20 * len(want)) >= 0.9
    assert sum((20, v) in found for v, _ in want[20]) >= 18


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [3.0, 5.0]), (2, [4.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(gi.nearest(df).collect())] == [(0, 1, 1, 5.0), (0, 2, 2, 2.0)]


def test_many_tables_of_shards(spark, monkeypatch, odd):
    want = sorted(tuple(r) for r in gi.nearest(odd).collect())
    monkeypatch.setattr(gi, "SMALL_TABLE", 0)
    assert sorted(tuple(r) for r in gi.nearest(odd).collect()) == want
