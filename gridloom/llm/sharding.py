"""Sharding by a hierarchical weighted hash tree (DataFrame expressions only).

A tree has region, rack and shard levels. At each level a key draws one child: child ``c`` of weight
``w`` gets ``-ln(u(key, c)) / w`` with ``u`` uniform from a hash, and the smallest wins, so a child is
chosen in proportion to its weight. The score of a child depends on the key and on that child alone.
When a weight changes, only draws against that child change: keys move into (or out of) subtrees whose
weight changed and nowhere else, and a new shard that opens its own region takes keys only into itself.

Edge cases: a null key is the empty string; equal keys share a shard; an empty table gives an empty
table; a null text has one byte of size and the checksum of the empty string; columns of the input
that clash with the output's names are replaced. Very long texts are only measured and summed, whole.
Repeated rows share a shard and have slots of their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SLOT_BUCKETS = 1024
BASE = 16


@dataclass(frozen=True)
class Leaf:
    region: int
    rack: int
    shard: int
    weight: float = 1.0


def topology(shards: int, base: int = BASE, racks_per_region: int = 2, shards_per_rack: int = 2) -> list[Leaf]:
    """The first ``base`` shards fill regions in order; each later shard opens a region of its own."""
    per_region = racks_per_region * shards_per_rack
    out = []
    for s in range(shards):
        if s < base:
            out.append(Leaf(s // per_region, (s % per_region) // shards_per_rack, s))
        else:
            out.append(Leaf(-(-base // per_region) + s - base, 0, s))
    return out


def _uniform(key: Column, node: Column) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, node), 11)
    return (bits.cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _draw(key: Column, children: list[tuple[str, int, float]]) -> Column:
    """The index of the drawn child; ties go to the smaller index."""
    if len(children) == 1:
        return F.lit(children[0][1])
    scored = [F.struct((-F.ln(_uniform(key, F.lit(name))) / F.lit(float(w))).alias("s"), F.lit(i).alias("i")) for name, i, w in children if w > 0]
    return F.array_min(F.array(*scored))["i"]


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard that ``key`` descends to. Weights of racks and regions are sums over their leaves."""
    if not any(x.weight > 0 for x in leaves):
        raise ValueError("a tree needs a leaf of positive weight")
    key = F.coalesce(key.cast("string"), F.lit(""))
    total = lambda xs: sum(x.weight for x in xs)
    regions = sorted({x.region for x in leaves})
    in_region = {r: [x for x in leaves if x.region == r] for r in regions}

    def within(r: int) -> Column:
        racks = sorted({x.rack for x in in_region[r]})
        by_rack = {k: [x for x in in_region[r] if x.rack == k] for k in racks}
        shard = lambda k: _draw(key, [(f"s{x.shard}", x.shard, x.weight) for x in by_rack[k]])
        drawn = _draw(key, [(f"r{r}/k{k}", k, total(by_rack[k])) for k in racks if total(by_rack[k]) > 0])
        return _case(drawn, [(k, shard(k)) for k in racks if total(by_rack[k]) > 0])

    live = [r for r in regions if total(in_region[r]) > 0]
    return _case(_draw(key, [(f"r{r}", r, total(in_region[r])) for r in live]), [(r, within(r)) for r in live]).cast("int")


def _case(drawn: Column, branches: list[tuple[int, Column]]) -> Column:
    if len(branches) == 1:
        return branches[0][1]
    out = F.when(drawn == F.lit(branches[0][0]), branches[0][1])
    for value, column in branches[1:-1]:
        out = out.when(drawn == F.lit(value), column)
    return out.otherwise(branches[-1][1])


def assign(df: DataFrame, key: str, leaves: list[Leaf], out: str = "shard") -> DataFrame:
    """``df`` with the shard of each row; no shuffle."""
    return df.withColumn(out, shard_of(F.col(key), leaves))


def with_slots(df: DataFrame, shard: str, order: list[str], buckets: int = SLOT_BUCKETS, out: str = "slot") -> DataFrame:
    """``df`` with a gapless number from 0 inside each shard.

    A shard is cut into ``buckets`` hash buckets of the order columns, numbered one by one and
    shifted by the rows of the buckets before, so that no task holds a whole shard. The counts have at
    most shards x buckets rows (16 x 1024 by default), which bounds the broadcast.
    """
    bucketed = df.withColumn("__bucket", F.pmod(F.xxhash64(*order, F.lit("slot")), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy(F.col(shard).alias("__s"), F.col("__bucket").alias("__b")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__s").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__s", "__b", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = Window.partitionBy(shard, "__bucket").orderBy(*order)
    numbered = bucketed.withColumn("__row", F.row_number().over(own) - 1)
    joined = numbered.join(F.broadcast(starts), (F.col(shard) == F.col("__s")) & (F.col("__bucket") == F.col("__b")))
    return joined.withColumn(out, (F.col("__start") + F.col("__row")).cast("long")).drop("__s", "__b", "__start", "__row", "__bucket")


def shard_documents(docs: DataFrame, shards: int = BASE, base: int = BASE) -> DataFrame:
    """Shard, slot and the shard after one more is added, by the law ``key``: doc_id and shard count decide. The tree
    of a count is that of the count before and one region more, down to ``base`` shards, where it begins."""
    if shards < base:
        raise ValueError(f"a tree begins with {base} shards; give a smaller base")
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + F.lit(1)).alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col("doc_id"), topology(shards, base)).alias("shard"),
        shard_of(F.col("doc_id"), topology(shards + 1, base)).alias("grown_shard"),
    )
    return with_slots(narrow, "shard", ["doc_id", "text_crc32", "size"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
