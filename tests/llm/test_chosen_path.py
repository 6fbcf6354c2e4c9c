import random
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from gridloom.llm import chosen_path as cp
from tests.llm.conftest import SCHEMA, words


def shingles(text):
    w = (text or "").split()
    k = min(5, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(rows):
    texts = sorted({r.text or "" for r in rows})
    sets = [shingles(t) for t in texts]
    links = {i: set() for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both) - 1e-9:
                links[i].add(j)
                links[j].add(i)
    root = {}
    for i in range(len(texts)):
        seen, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - seen:
                seen.add(k)
                todo.append(k)
        root[i] = seen
    at = {t: i for i, t in enumerate(texts)}
    count = Counter(r.text or "" for r in rows)
    least = {}
    for r in rows:
        if r.doc_id is not None:
            least[r.text or ""] = min(r.doc_id, least.get(r.text or "", r.doc_id))
    out = []
    for r in rows:
        i = at[r.text or ""]
        ids = [least[texts[k]] for k in root[i] if texts[k] in least]
        out.append((r.doc_id, min(ids, default=None), count[r.text or ""] - 1, len(links[i])))
    return Counter(out)


def test_against_all_pairs(docs):
    got = Counter(tuple(r) for r in cp.similarity_classes(docs).collect())
    assert got == plain(docs.collect())


def test_large_near_group_goes_through_pivots_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp, "BUCKET", 10)
    monkeypatch.setattr(cp, "BLOCK", 16)
    rng = random.Random(1)
    base, shared = words(rng, 150).split(), words(rng, 50)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(99)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, f"{shared} {words(rng, 120)}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(tuple(r) for r in cp.similarity_classes(df).collect()) == plain(df.collect())


def near_copies(n, rng, length=60, most=6):
    base = words(rng, length).split()
    out = set()
    while len(out) < n:
        w = list(base)
        for _ in range(rng.randint(1, most)):
            w[rng.randrange(length)] = f"v{rng.randrange(9999)}"
        out.add(" ".join(w))
    return sorted(out)


def dense_links(texts):
    """All pairs by a dense matrix of shingles: links of each text, and the smallest text reachable from each."""
    sets = [shingles(t) for t in texts]
    number = {s: i for i, s in enumerate(sorted(set().union(*sets)))}
    shared = [s for s, c in Counter(s for x in sets for s in x).items() if c > 1]
    column = {s: i for i, s in enumerate(shared)}
    x = np.zeros((len(texts), len(shared)), np.float32)
    for i, one in enumerate(sets):
        x[i, [column[s] for s in one if s in column]] = 1
    both, size = x @ x.T, np.array([len(s) for s in sets])
    linked = both >= 0.8 * (size[:, None] + size[None, :] - both) - 1e-4
    np.fill_diagonal(linked, False)
    root = np.arange(len(texts))
    for _ in texts:
        low = np.minimum(root, np.where(linked, root[None, :], len(texts)).min(1))
        if (low == root).all():
            break
        root = low
    assert len(number) >= len(shared)
    return linked.sum(1), root


def test_five_thousand_near_copies_against_all_pairs(spark):
    rng = random.Random(11)
    passage = words(rng, 40)
    texts = near_copies(5000, rng) + [f"{passage} {words(rng, 60)}" for _ in range(500)]
    links, root = dense_links(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in cp.similarity_classes(df).collect()}
    assert got == {i: (int(root[i]), int(links[i])) for i in range(len(texts))}
    classes = {r.doc_id: r.class_id for r in cp.similarity_classes(df, count_links=False).collect()}
    assert classes == {i: int(root[i]) for i in range(len(texts))}


def test_candidate_edges_grow_with_a_hot_group_and_not_its_square(spark):
    edges = {}
    for n in (500, 2500):
        df = spark.createDataFrame(list(enumerate(near_copies(n, random.Random(12)))), "doc_id long, text string")
        keyed = df.select("doc_id", "text", F.unhex(F.md5("text")).alias("cls"))
        classes = cp.materialize(keyed.mapInArrow(cp._sketch_batches, "doc_id long, cls binary, paths array<long>, sketch binary, size int"), "sketches")
        edges[n] = cp.candidate_edges(classes).count()
    assert edges[2500] < 8 * edges[500], edges


def test_runs_follow_the_recall():
    assert cp.runs_for(0.5) == 1 and cp.RUNS == cp.runs_for(cp.RECALL)
    assert np.exp(-0.8 * cp.RATE * cp.SPLIT_KEEPS * cp.RUNS) <= 1 - cp.RECALL < np.exp(-0.8 * cp.RATE * cp.SPLIT_KEEPS * (cp.RUNS - 1))


def test_classes_without_links_are_the_same(docs):
    full = Counter((r.doc_id, r.class_id, r.n_copies) for r in cp.similarity_classes(docs).collect())
    assert full == Counter(tuple(r) for r in cp.similarity_classes(docs, count_links=False).collect())


def test_one_of_each_class(docs):
    kept = cp.one_per_class(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert {0, 3, 4, 5, 10} <= set(ids) and not {1, 2, 6, 7} <= set(ids)
    assert 6 not in ids and 7 not in ids and ids.count(5) == 1


def test_empty(no_docs):
    assert cp.similarity_classes(no_docs).count() == 0
    assert cp.one_per_class(no_docs).count() == 0


def test_exact_links_of_blocks():
    rng = random.Random(2)
    texts = [words(rng, 30) for _ in range(3)]
    sets = cp.shingle_sets(pa.array([*texts, texts[0], texts[1] + " more"]))
    full = cp.exact_links(sets)
    assert full[0, 3] and full[1, 4] and full.sum() == 4
    split = cp.exact_links(sets, np.array([True, True, True, False, True]))
    assert split[0, 3] and split.sum() == 2


def test_schema_is_documents(docs):
    assert docs.schema.simpleString().startswith("struct<doc_id:bigint,text:string") and len(SCHEMA.split(",")) == len(docs.columns)
