import math
import zlib
from collections import Counter

import pytest
import xxhash

from gridloom.llm.sharding import Leaf, assign, shard_documents, shard_of, topology


def test_columns_slots_and_growth(docs):
    got = shard_documents(docs).collect()
    assert len(got) == docs.count()
    for r in got:
        assert 0 <= r.shard < 16 and r.law == "key" and r.grown_shard in (r.shard, 16)
    for s in range(16):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    by = Counter((r.size, r.text_crc32) for r in got)
    assert by == Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in (r.text for r in docs.collect()))


def test_equal_keys_share_a_shard_and_nulls_have_one(docs):
    got = shard_documents(docs).collect()
    for key in {r.doc_id for r in got}:
        assert len({r.shard for r in got if r.doc_id == key}) == 1


def test_empty(no_docs):
    assert shard_documents(no_docs).count() == 0


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20_000)


def shards(keys, leaves):
    return {r.id: r.s for r in keys.select("id", shard_of(keys["id"], leaves).alias("s")).collect()}


def test_shares_follow_weights(keys):
    got = Counter(shards(keys, [Leaf(0, 0, 0, 3), Leaf(0, 1, 1, 1), Leaf(1, 0, 2, 2)]).values())
    for s, w in ((0, 3), (1, 1), (2, 2)):
        assert abs(got[s] / 20_000 - w / 6) < 0.02


def test_changes_stay_in_the_changed_subtrees(keys):
    tree = topology(16)
    before = shards(keys, tree)
    grown = shards(keys, topology(17, base=16))
    moved = [k for k in before if before[k] != grown[k]]
    assert moved and all(grown[k] == 16 for k in moved)
    assert abs(len(moved) / 20_000 - 1 / 17) < 0.01
    lighter = [Leaf(x.region, x.rack, x.shard, 0.5 if x.shard == 5 else 1) for x in tree]
    after = shards(keys, lighter)
    for k in before:
        if before[k] != after[k]:
            assert before[k] // 4 == 1  # only keys of the region that got lighter move


def test_weightless_tree_is_an_error(spark):
    with pytest.raises(ValueError):
        assign(spark.range(1), "id", [Leaf(0, 0, 0, 0.0)])


def plain_shard(key, leaves):
    """A plain descent: xxHash64 with Spark's seed 42, chained over key and node."""

    def draw(children):
        def score(name, w):
            h = xxhash.xxh64_intdigest(name.encode(), xxhash.xxh64_intdigest(key.encode(), 42))
            return -math.log(((h >> 11) + 0.5) / 2**53) / w

        return min((score(name, w), node) for name, node, w in children)[1] if len(children) > 1 else children[0][1]

    def total(xs):
        return sum(x.weight for x in xs)

    regions = sorted({x.region for x in leaves})
    r = draw([(f"r{r}", r, total([x for x in leaves if x.region == r])) for r in regions])
    racks = sorted({x.rack for x in leaves if x.region == r})
    k = draw([(f"r{r}/k{k}", k, total([x for x in leaves if (x.region, x.rack) == (r, k)])) for k in racks])
    return draw([(f"s{x.shard}", x.shard, x.weight) for x in leaves if (x.region, x.rack) == (r, k)])


def test_placement_equals_a_plain_descent(spark):
    df = spark.createDataFrame([(i, "t") for i in [*range(-5, 2000), None]], "doc_id long, text string")
    for r in shard_documents(df).collect():
        key = "" if r.doc_id is None else str(r.doc_id)
        assert (r.shard, r.grown_shard) == (plain_shard(key, topology(16)), plain_shard(key, topology(17)))


def test_shard_counts_follow_one_another(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text")
    at = {n: {r.doc_id: r for r in shard_documents(df, n).collect()} for n in (16, 17, 18)}
    for a, b in ((16, 17), (17, 18)):
        assert all(at[a][i].grown_shard == at[b][i].shard for i in at[a])
    with pytest.raises(ValueError):
        shard_documents(df, 8)


def test_rows_of_one_key_are_numbered_in_many_buckets(spark):
    df = spark.range(5000).selectExpr("CAST(NULL AS long) AS doc_id", "CAST(id AS string) AS text")
    got = shard_documents(df).collect()
    assert sorted(r.slot for r in got) == list(range(5000))
