import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gridloom.llm import substring_dedup as sd
from gridloom.llm.queries import op5_substring_dedup


def plain(rows):
    """(doc_id, text) in order to (id, bytes, removed, spans, kept)."""
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            s = b[p : p + 100]
            if s in seen:
                gone[p : p + 100] = b"\1" * 100
            seen.add(s)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, kept))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, len(r.span_starts), bytes(r.kept)) for r in sd.remove_repeats(df).collect()), key=str)


def test_against_brute_force(docs):
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("seed", range(3))
def test_random_repeats(spark, seed):
    rng = random.Random(seed)
    pool = ["".join(rng.choice("ab ") for _ in range(rng.randint(20, 260))) for _ in range(12)]
    rows = [(i, "".join(rng.choice(pool) if rng.random() < 0.7 else "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 150))) for _ in range(rng.randint(0, 8)))) for i in range(60)]
    rows += [(100, "ab" * 400), (101, "a" * 350), (102, "é" * 150)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_small_groups_and_slices(spark, monkeypatch):
    rng = random.Random(9)
    base = "".join(rng.choice("abcdefghij ") for _ in range(3000))
    rows = [(i, base[rng.randint(0, 800) : rng.randint(1200, 3000)]) for i in range(40)]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == plain(rows)


def test_spans_merge():
    import numpy as np

    s, e, o = sd.merge_spans(np.array([5, 0, 7, 3, 0]), np.array([7, 4, 9, 5, 1]), np.array([1, 1, 1, 1, 0]))
    assert list(zip(o, s, e)) == [(0, 0, 1), (1, 0, 9)]


def test_documents_keep_their_columns(docs, no_docs):
    cut = sd.deduplicated(docs)
    assert cut.schema.simpleString() == docs.schema.simpleString() and cut.count() == docs.count()
    assert all(r.n_chars == len(r.text) and r.part == "part" for r in cut.collect())
    assert sd.deduplicated(no_docs).count() == 0 and sd.remove_repeats(no_docs).count() == 0


def test_query(spark, sf):
    from gridloom.llm.common import table

    want = plain([(r.doc_id, r.text) for r in table(spark, sf, "documents").collect()])
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op5_substring_dedup(spark, sf).collect()), key=str)
    assert sorted(((*w[:4], hashlib.sha256(w[4]).hexdigest()) for w in want), key=str) == got


def test_multikey_order_is_the_order_of_bytes():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 3, 500) for _ in range(4)]
    order, fresh = sd.multikey_groups(words)
    rows = [tuple(w[i] for w in words) for i in order.tolist()]
    assert rows == sorted(rows)
    assert [i for i in range(500) if i == 0 or rows[i] != rows[i - 1]] == np.flatnonzero(fresh).tolist()


def test_equal_hashes_of_other_bytes_are_told_apart(monkeypatch):
    """All hashes are equal: bytes decide."""
    table = lambda texts: pa.table({"part": [0] * len(texts), "doc_id": list(range(len(texts))), "copy": pa.array([0] * len(texts), pa.int32()), "start": pa.array([0] * len(texts), pa.int32()), "distance": pa.array([5] * len(texts), pa.int32()), "context": pa.array(texts, pa.binary())})
    texts = [bytes([65 + i % 3]) * 100 for i in range(9)]
    monkeypatch.setattr(sd, "keys_of", lambda w8, length: np.zeros(len(w8) + 8 - length, np.uint64))
    got = sd._resolve(table(texts))
    assert sorted(got.column("doc_id").to_pylist()) == [3, 4, 5, 6, 7, 8]


def test_many_buckets(spark, docs, monkeypatch):
    rows = lambda: Counter((r.doc_id, r.n_removed, tuple(r.span_starts)) for r in sd.remove_repeats(docs, 20_000).collect())
    want = rows()
    monkeypatch.setattr(sd, "sampled_splitters", lambda *a: np.empty(0, np.int64))
    assert rows() == want
