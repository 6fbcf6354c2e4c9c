import random
from collections import Counter

import pytest

from gridloom.llm import decontaminate as dc
from tests.llm.conftest import words


def shingles(w, k):
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def plain(docs, items):
    out = []
    for d, text in docs:
        w = (text or "").split()
        for i, item in items:
            q = (item or "").split()
            if q:
                k = min(5, len(q))
                own = shingles(q, k)
                n = len(own & shingles(w, k))
                if n >= 0.8 * len(own):
                    out.append((d, i, len(own), n))
    return Counter(out)


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(4)
    items = [(i, words(rng, n)) for i, n in enumerate([3, 5, 6, 16, 17, 31, 40, 64, 70, 150, 300] * 3)]
    items += [(90, None), (91, ""), (92, " "), (93, "one two three four"), (94, items[3][1])]
    docs = []
    for i in range(150):
        body = words(rng, rng.choice([0, 3, 50, 400, 5000])).split()
        for _ in range(rng.randint(0, 2)):
            q = (rng.choice(items)[1] or "").split()
            if len(q) > 20 and rng.random() < 0.4:
                q[rng.randrange(len(q))] = "other"
            if len(q) > 20 and rng.random() < 0.3:
                q = q[: int(len(q) * 0.6)]
            at = rng.randint(0, len(body))
            body[at:at] = q
        docs.append((i, " ".join(body)))
    docs += [(200, None), (201, ""), (202, "x one two three four y"), (203, "one two three"), (203, "one two three four")]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), docs, items


def test_against_brute_force(planted):
    docs, items, d, i = planted
    got = Counter(tuple(r)[:4] for r in dc.contained_items(docs, items).collect())
    assert got == plain(d, i) and len(got) > 60


def test_items_in_blocks(planted, monkeypatch):
    monkeypatch.setattr(dc, "BLOCK", 7)
    docs, items, d, i = planted
    assert Counter(tuple(r)[:4] for r in dc.contained_items(docs, items).collect()) == plain(d, i)


def test_clean_documents_stay(planted, docs, no_docs):
    frame, items, d, i = planted
    leaks = {k[0] for k in plain(d, i)}
    kept = [r.doc_id for r in dc.clean_documents(frame, items).collect()]
    assert sorted(kept) == sorted(k for k, _ in d if k not in leaks)
    assert dc.clean_documents(docs, items.limit(0)).count() == docs.count()
    assert dc.clean_documents(docs, items).columns == docs.columns
    assert dc.contained_items(no_docs, items).count() == 0 and dc.contained_items(docs, items.limit(0)).count() == 0


def test_short_and_repetitive_items_are_never_missed(spark):
    rng = random.Random(9)
    items = [(i, words(rng, 1 + i % 13)) for i in range(130)]
    items += [(200, " ".join(["ha"] * 100)), (201, " ".join([*"abcdefghij" * 20]))]
    docs = []
    for i, text in items:
        body = words(rng, 300).split()
        body[150:150] = text.split()
        docs.append((i, " ".join(body)))
    got = dc.contained_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = Counter(tuple(r)[:4] for r in got.collect())
    assert got == plain(docs, items) and len(got) >= len(items)
