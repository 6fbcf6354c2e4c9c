import hashlib

import duckdb
import numpy as np
import pytest

from gridloom.llm import vector_codes as vc
from gridloom.llm.common import table
from gridloom.llm.queries import ORACLES, op11_vector_codes


def plain_codes(rows, rounds=vc.ROUNDS):
    """(id, label, vector) rows by full searches: id to (code, error), and the codebooks."""
    x = np.array([np.floor(4096 * np.asarray(v, float)) for _, _, v in rows]).astype(int)
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], x[i].tolist()))
    w = x.shape[1] // 8
    books = [x[order[:16], p * w : (p + 1) * w].tolist() for p in range(8)]

    def search():
        out = []
        for p, b in enumerate(books):
            own = []
            for v in x[:, p * w : (p + 1) * w].tolist():
                d = [sum((a - c) ** 2 for a, c in zip(v, e)) for e in b]
                own.append((d.index(min(d)), min(d)))
            out.append(own)
        return out

    for _ in range(rounds):
        for p, own in enumerate(search()):
            for j in range(len(books[p])):
                mine = [x[i, p * w : (p + 1) * w].tolist() for i in range(len(rows)) if own[i][0] == j]
                if mine:
                    books[p][j] = [sum(c) // len(mine) for c in zip(*mine)]
    last = search()
    return {r[0]: ("".join(f"{last[p][i][0]:02x}" for p in range(8)), sum(last[p][i][1] for p in range(8))) for i, r in enumerate(rows)}, books


SCHEMA = "vec_id long, embedding array<float>, label int, code string, x string, error double"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], label, "c", "x", 0.5) for i, label, v in rows], SCHEMA).repartition(3)


@pytest.mark.parametrize("kind", ["normal", "ties", "few", "wide"])
def test_equals_full_searches(spark, kind):
    rng = np.random.default_rng(4)
    n = {"few": 9}.get(kind, 300)
    v = rng.normal(0, 0.2, (n, 64 if kind == "wide" else 16)).astype(np.float32)
    if kind == "ties":  # few distinct values: equal distances, equal entries and empty ones
        v = (rng.integers(-2, 3, (n, 16)) / 4096).astype(np.float32)
    rows = [(int(i), int(i) % 3 if i % 7 else None, x) for i, x in zip(rng.permutation(n), v)]
    want, books = plain_codes(rows)
    got, found = vc.vector_codes(frame(spark, rows))
    got = got.collect()
    assert {r.vec_id: (r.code, r.error) for r in got} == want and len(got) == n
    assert [b.tolist() for b in found] == books
    sums = {}
    for i, label, _ in rows:
        sums[label] = sums.get(label, 0) + want[i][1]
    assert all(r.label_error == sums[dict((a, b) for a, b, _ in rows)[r.vec_id]] for r in got)


def test_bounds_hold_and_save_work():
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 3000, (16, 8))
    x = np.floor(centres[rng.integers(0, 16, 3000)] + rng.normal(0, 120, (3000, 8))).astype(np.int64)
    book = x[:16].copy()
    groups = vc.group_entries(book)
    own = lower = None
    moved, works = np.zeros(groups.max() + 1, np.int64), []
    for _ in range(8):
        own, lower, best, work = vc.assign_part(x, own, lower, book, moved, groups)
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        assert (own == d.argmin(1)).all() and (best == d.min(1)).all()
        d[np.arange(len(x)), own] = 1 << 60
        for g in range(groups.max() + 1):
            assert (lower[:, g] <= np.sqrt(d[:, groups == g].min(1))).all()
        works.append(work)
        new = np.array([x[own == j].sum(0) // max((own == j).sum(), 1) if (own == j).any() else book[j] for j in range(16)])
        moved, book = vc.moves(book, new, groups), new
    assert works[-1] < 0.5 * works[0]


def test_odd_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, 1, rng.normal(0, 1, 16)) for i in range(5, 40)]
    odd = [(1, 1, None), (2, 1, [None] * 16), (3, 1, [float("nan")] * 16), (4, 1, [float("inf")] + [0.0] * 15)]
    misfits = [(0, 9, [0.5] * 12), (50, None, [0.5] * 24), (51, 1, []), (52, 1, [1e30] + [0.0] * 15)]
    got, books = vc.vector_codes(frame(spark, rows + odd + misfits))
    got = {r.vec_id: r for r in got.collect()}
    want, plain = plain_codes(rows)
    assert {i: (r.code, r.error) for i, r in got.items() if r.code} == want and [b.tolist() for b in books] == plain
    assert {i for i, r in got.items() if r.code is None} == {0, 50, 51, 52} and got[0].label_error is None and got[52].label_error == got[5].label_error
    twice, _ = vc.vector_codes(frame(spark, [(1, 1, rows[0][2]), (1, 1, rows[0][2]), (None, None, rows[1][2])]))
    assert sorted(r.error for r in twice.collect()) == [0, 0, 0] and {r.code for r in twice.collect()} == {"00" * 8, "02" * 8}
    none, books = vc.vector_codes(frame(spark, odd))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error"]


def test_many_labels_are_joined_in_copies(spark, monkeypatch):
    monkeypatch.setattr(vc, "LABELS", 1)
    rows = [(i, i % 3 if i else None, [i / 50] * 8) for i in range(40)]
    got, _ = vc.vector_codes(frame(spark, rows))
    monkeypatch.undo()
    want, _ = vc.vector_codes(frame(spark, rows))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_codes_stand_for_near_vectors(spark, sf):
    codes, books = vc.vector_codes(table(spark, sf, "embeddings"))
    near = vc.decoded(codes, books).join(table(spark, sf, "embeddings"), "vec_id").collect()
    for r in near:
        gap = sum((np.floor(4096 * a) - round(4096 * b)) ** 2 for a, b in zip(np.array(r.embedding), r.approximation))
        assert gap == r.error


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    columns = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op11_vector_codes']}) ORDER BY vec_id").fetchall()
    got = sorted(tuple(r) for r in op11_vector_codes(spark, sf).select(*columns).collect())
    assert got == want and got
    assert len(hashlib.sha256(b"").hexdigest()) == len(got[0][4])
