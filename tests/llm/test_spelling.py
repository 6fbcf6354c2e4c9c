import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from gridloom.llm import spelling as sp
from gridloom.llm.queries import ORACLES, op12_spelling


def plain_counts(rows):
    out = Counter()
    for d, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            out[w] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    out = {}
    for w, n in counts.items():
        others = [o for o in counts if near(w, o)]
        best = min(others, key=lambda o: (-counts[o], o), default=None)
        out[w] = (best if best and counts[best] >= 5 * n else None, n, len(others))
    roots = {}
    for w in out:
        r = w
        while out[r][0]:
            r = out[r][0]
        roots[w] = r
    return {(w, f, roots[w], n, k, counts[f] if f else None) for w, (f, n, k) in out.items()}


def texts(kind):
    rng = random.Random(8)
    if kind == "stem":  # words that share long stems: buckets are cut again and again
        words = ["aaaaaa" + "".join(rng.choice("abc") for _ in range(rng.randint(2, 5))) for _ in range(150)] + ["".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) + "zzzzzz" for _ in range(60)]
    elif kind == "few letters":
        words = ["".join(rng.choice("ab") for _ in range(rng.randint(6, 9))) for _ in range(250)]
    else:
        words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(6, 12))) for _ in range(60)]
        words += [w[:k] + rng.choice("xyÿ") + w[k + rng.randint(0, 1) :] for w in words for k in (0, 3, len(w))]
        words += [w + "s" for w in words[:40]] + ["Straße", "Straßes", "ÉCOLES", "école's écoles"]
    weights = [rng.choice([1, 1, 2, 5, 30, 160]) for _ in words]
    return [(i, " ".join(rng.choices(words, weights, k=rng.randint(1, 700)))) for i in range(24)] + [(None, "null identifier words " * 9), (98, None), (99, "")]


SCHEMA = "doc_id long, text string, word string, n int, root string"


@pytest.mark.parametrize("kind", ["mixed", "stem", "few letters"])
@pytest.mark.parametrize("dense", [sp.DENSE, 2])
def test_equals_all_pairs(spark, kind, dense):
    rows = texts(kind)
    docs = spark.createDataFrame([(*r, "word", 1, "root") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in sp.spelling_variants(docs, dense=dense).collect()]
    want = plain_variants(plain_counts(rows))
    assert len(got) == len(want) and set(got) == want
    assert any(w != r for w, _, r, *_ in got) or kind != "mixed"


def test_pairs_come_once_from_any_bucket(spark):
    words = spark.createDataFrame([(w, 5) for w in ("abcdef", "abcdeff", "aabcdef", "abcdex", "xbcdef", "abcddef", "abcefd")], "word string, n long")
    for dense in (0, 1, 100):
        pairs = [tuple(sorted(r)) for r in sp.near_pairs(words, dense).select("s", "r").collect()]
        want = {tuple(sorted((a.word, b.word))) for a in words.collect() for b in words.collect() if near(a.word, b.word)}
        assert len(pairs) == len(set(pairs)) and set(pairs) == want


def test_long_chains_end(spark):
    rows = [(chr(97 + i) * 6, chr(98 + i) * 6 if i < 20 else None) for i in range(21)]
    got = sp.rooted(spark.createDataFrame(rows, "word string, form string")).collect()
    assert {r.root for r in got} == {"u" * 6} and len(got) == 21


def test_edges(spark, docs, no_docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert {tuple(r) for r in sp.spelling_variants(docs).collect()} == plain_variants(plain_counts(rows))
    assert sp.spelling_variants(no_docs).count() == 0
    long = spark.createDataFrame([(i, "Ab" * 40_000 + " " + "ab" * 40_000 + "c") for i in range(5)], "doc_id long, text string")
    assert sorted(r.n_near for r in sp.spelling_variants(long).collect()) == [1, 1]


def test_query_equals_sql(spark, sf):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    columns = ["word", "form", "root", "n", "n_near", "form_n"]
    want = set(duck.execute(f"SELECT {', '.join(columns)} FROM ({ORACLES['op12_spelling']})").fetchall())
    got = [tuple(r) for r in op12_spelling(spark, sf).select(*columns).collect()]
    assert len(got) == len(want) and set(got) == want and got
    rows = duck.execute("SELECT doc_id, text FROM documents").fetchall()
    assert want == plain_variants(plain_counts(rows))
    rows = [(1, "écoles ecoles écolés éecoles ÿtalents italents " * 6)]
    duck.execute("CREATE OR REPLACE TABLE documents_2 AS SELECT 1 AS doc_id, ? AS text", [rows[0][1]])
    again = ORACLES["op12_spelling"].replace("FROM documents)", "FROM documents_2)")
    assert set(duck.execute(f"SELECT {', '.join(columns)} FROM ({again})").fetchall()) == plain_variants(plain_counts(rows))
