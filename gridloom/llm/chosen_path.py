"""Similarity self-join of texts on word shingles by chosen paths.

Two different texts are linked if the Jaccard similarity of their sets of ``SHINGLE``-word runs is at least
``SIMILARITY``. Equal texts are one class, found first by a digest, and take part once.

A set ``x`` follows the paths of the tokens it samples: token ``j`` in run ``r`` if ``hash_r(j) < RATE / |x|``,
with hash functions that all sets share. Similar sets sample common tokens: 0.8 ``RATE`` of them a run are
expected. Sets of a path that has at most ``BUCKET`` are compared with one another by min-wise sketches (an
estimate of at least ``SKETCH_LEAST``, over five standard errors below 0.8, makes a candidate). A larger bucket
is split again on sampled tokens of the sets' sketches, ``BRANCH`` times, down to ``DEPTH`` levels (a linked pair
comes through with ``SPLIT_KEEPS`` on each of the paths it shares); what is then still large agrees everywhere
and is all made one candidate group. Runs are repeated until a linked pair is found with ``RECALL`` (``runs_for``).

Before a large bucket is split, its sets are compared with ``PIVOTS`` of its members, those that come first in as
many orders which all paths share, so that buckets of one hot group have the same pivots. Sets near a pivot
(``PIVOT_NEAR``) are its candidates; pivots near each other are one cluster with all that is near them. A bucket
with at most ``FEW`` sets outside a cluster is done: these few are compared with all its sets, ``CHUNK`` at a time,
and the others are one candidate group already. Thus copies of one text end at the first level, whatever their
number. From any other bucket a set goes that is nearer to a pivot, by ``PIVOT_GAP``, than every set outside the
pivot's cluster: distances of sketches are a metric, so all that could be linked to it is in the cluster too.

Candidate groups, the components of candidate pairs, are verified exactly on whole shingle sets, in blocks of
``BLOCK`` texts and ``BLOCK_SHINGLES`` shingles at most, so that no task holds a large group. Each block is
compared with itself; its linked sets come down to one label; then blocks meet, and a pair of blocks sends on one
edge for two labels. Where links are counted every two blocks meet: the work grows with the square of a group of
*different* near copies, as the number of its links does. Where only classes are asked for (``one_per_class``) all
sets meet the group's ``LEADERS`` first, and only sets that are not in the group's largest class by then meet
the rest.

Edge cases: texts without words have no shingles and no links (equal ones are one class); texts under five
words have one shingle; null is the empty text; a row with a null doc_id keeps its null; rows repeating a
doc_id each keep theirs; an empty table gives no rows. Long texts are read whole. Only doc_id and text are
read, so other columns may have any name. Ties: a similarity of ``SIMILARITY`` exactly is a link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import SHINGLE, WORDS, discard, give_back, materialize, mix64, run_hashes, runs, slices
from gridloom.llm.components import components

SIMILARITY = 0.8
RATE, RECALL = 4, 1 - 3e-5
SKETCH, SKETCH_LEAST = 48, 0.5
BUCKET, BRANCH, DEPTH = 300, 2, 6
SPLIT_KEEPS = (1 - (1 - SIMILARITY) ** BRANCH) ** (DEPTH - 1)
PIVOTS, PIVOT_NEAR, PIVOT_GAP, FEW, CHUNK = 6, 0.4, 0.35, 512, 4096
BLOCK, BLOCK_SHINGLES, LEADERS = 1024, 1 << 20, 8
SEED = 2


def runs_for(recall: float) -> int:
    """Runs until a pair of similarity ``SIMILARITY`` is found with probability ``recall``: the paths that it
    shares and that survive splitting are Poisson, with the same mean in every run."""
    runs, missed = 0, 1.0
    while missed > 1 - recall:
        runs, missed = runs + 1, missed * float(np.exp(-SIMILARITY * RATE * SPLIT_KEEPS))
    return runs


RUNS = runs_for(RECALL)


def _hashers(n: int) -> list[tuple[np.uint64, np.uint64]]:
    rng = np.random.default_rng(SEED)
    return [(np.uint64(a) * np.uint64(2) + np.uint64(1), np.uint64(b)) for a, b in rng.integers(0, 2**63, (n, 2), dtype=np.uint64)]


def shingle_sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words, offsets = WORDS.of_texts(texts)
    everywhere = run_hashes(words)
    out = []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        n = b - a
        if n >= SHINGLE:
            out.append(np.unique(everywhere[a : b - SHINGLE + 1]))
        else:
            out.append(run_hashes(words[a:b], n) if n else np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Each set's paths (hashes of run and sampled token), and its sketch: uint16 rows."""
    hashers = _hashers(SKETCH + RUNS)
    sizes = np.array([len(s) for s in sets])
    full = np.flatnonzero(sizes)
    sketch = np.zeros((len(sets), SKETCH), np.uint16)
    paths: list[np.ndarray] = [np.empty(0, np.int64)] * len(sets)
    if not len(full):
        return paths, sketch
    flat = np.concatenate([sets[i] for i in full])
    at = np.cumsum(sizes[full]) - sizes[full]
    for k, (a, b) in enumerate(hashers[:SKETCH]):
        sketch[full, k] = mix64(np.minimum.reduceat(flat * a + b, at)).astype(np.uint16)
    share = np.minimum(np.float64(RATE) / sizes[full], 1.0)
    most = np.repeat((share * (2.0**64 - 4096)).astype(np.uint64), sizes[full])
    owner = np.repeat(full, sizes[full])
    found = []
    for r, (a, b) in enumerate(hashers[SKETCH:]):
        hit = np.flatnonzero(mix64(flat * a + b) <= most)
        found.append((owner[hit], mix64(flat[hit] + hashers[r][1]).view(np.int64)))
    who, what = np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])
    by = np.argsort(who, kind="stable")
    who, what = who[by], what[by]
    edges = np.searchsorted(who, np.arange(len(sets) + 1))
    return [what[i:j] for i, j in zip(edges, edges[1:])], sketch


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices(b, "text", 2 << 20)):
        sets = shingle_sets(batch.column("text"))
        paths, sketch = sketches(sets)
        at = np.concatenate([[0], np.cumsum([len(p) for p in paths])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(paths) if len(paths) else np.empty(0, np.int64)))
        size = pa.array(np.array([len(x) for x in sets], np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("cls"), lists, pa.array([r.tobytes() for r in sketch], pa.binary()), size], ["doc_id", "cls", "paths", "sketch", "size"])
    give_back()


def _forest(near: np.ndarray) -> np.ndarray:
    """The smallest member reachable from each, over a boolean adjacency matrix."""
    label = np.arange(len(near))
    while True:
        low = np.where(near, label[None, :], len(near)).min(1)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _bucket_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges of small buckets: members whose sketches agree enough, as stars."""
    done: set[bytes] = set()  # digests of member lists seen before, a bounded number
    edges: list[tuple[bytes, bytes]] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["a", "b"])
    for table in runs(batches, "path"):
        if table.num_rows < 2:
            continue
        members = sorted(zip(table.column("cls").to_pylist(), table.column("sketch").to_pylist()))
        names = [m[0] for m in members]
        digest = hashlib.blake2b(b"".join(names), digest_size=16).digest()
        if digest in done:
            continue
        if len(done) < 50_000:
            done.add(digest)
        sketch = np.frombuffer(b"".join(m[1] for m in members), np.uint16).reshape(-1, SKETCH)
        agree = (sketch[:, None, :] == sketch[None, :, :]).mean(2) if len(sketch) <= 64 else np.stack([(sketch == row).mean(1) for row in sketch])
        for i, j in enumerate(_forest(agree >= SKETCH_LEAST).tolist()):
            if i != j:
                edges.append((names[i], names[j]))
        if len(edges) > 10_000:
            yield flush()
            edges = []
    if edges:
        yield flush()
    give_back()


def _sketch_rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SKETCH)


def _pivot_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each set of a bucket and each pivot: positions in which their sketches agree (``near``), the same where
    the set isn't near the pivot's cluster (``far``, else -1), and a candidate edge to each cluster it is near."""
    for batch in batches:
        own, names = _sketch_rows(batch.column("sketch")), batch.column("cls").to_pylist()
        heads = [batch.column(f"pivot{k}").to_pylist() for k in range(PIVOTS)]
        pivots = [_sketch_rows(batch.column(f"pivot{k}_sketch")) for k in range(PIVOTS)]
        agree = np.stack([(own == p).sum(1) for p in pivots], 1)
        near = agree >= PIVOT_NEAR * SKETCH
        tied = np.stack([np.stack([(p == q).sum(1) >= PIVOT_NEAR * SKETCH for q in pivots], 1) for p in pivots], 1)
        for _ in range(PIVOTS - 1):
            tied = (tied[:, :, :, None] & tied[:, None, :, :]).any(2) | tied
        in_cluster = (tied & near[:, None, :]).any(2)
        first = tied.argmax(2)  # the first pivot of each one's cluster stands for it
        edges: list[list[bytes]] = []
        for i, name in enumerate(names):
            to: dict[int, bytes] = {}
            for k in range(PIVOTS):
                if near[i, k] and heads[k][i] != name:
                    to.setdefault(int(first[i, k]), heads[k][i])
            edges.append(list(to.values()))
        columns = [batch.column("path"), batch.column("cls"), batch.column("sketch"), pa.array(edges, pa.list_(pa.binary()))]
        columns += [pa.array(agree[:, k].astype(np.int32)) for k in range(PIVOTS)] + [pa.array(np.where(in_cluster[:, k], -1, agree[:, k]).astype(np.int32)) for k in range(PIVOTS)]
        yield pa.RecordBatch.from_arrays(columns, ["path", "cls", "sketch", "edges", *(f"near{k}" for k in range(PIVOTS)), *(f"far{k}" for k in range(PIVOTS))])


def _few_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate edges between the few (side 0) and a chunk of their bucket: each set's first one, and of the few
    those that a set brings together."""
    for table in runs(batches, "key"):
        side, names = np.asarray(table.column("side").combine_chunks()), np.array(table.column("cls").to_pylist(), object)
        sketch = _sketch_rows(table.column("sketch"))
        few = np.flatnonzero(side == 0)
        few = few[np.argsort(names[few])]
        first = np.full(len(names), -1)
        root = list(range(len(few)))

        def find(i: int) -> int:
            while root[i] != i:
                i = root[i]
            return i

        edges: list[tuple[bytes, bytes]] = []
        for i, f in enumerate(few.tolist()):
            near = np.flatnonzero(((sketch == sketch[f]).sum(1) >= SKETCH_LEAST * SKETCH) & (names != names[f]))
            for other in set(first[near].tolist()) - {-1}:
                x, y = find(other), find(i)
                if x != y:
                    root[max(x, y)] = min(x, y)
                    edges.append((names[few[x]], names[few[y]]))
            fresh = near[first[near] < 0]
            first[fresh] = i
            edges += [(names[n], names[f]) for n in fresh.tolist()]
        if edges:
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["a", "b"])
    give_back()


def candidate_edges(classes: DataFrame) -> DataFrame:
    """a, b of candidate pairs (as stars) of classes with columns cls, paths, sketch."""
    rows = classes.select("cls", F.explode(F.array_distinct("paths")).alias("path"))
    found: list[DataFrame] = []  # written level by level, so that plans stay small
    done_with: list[DataFrame] = []
    each = range(PIVOTS)
    for depth in range(1, DEPTH + 1):
        if depth > 1:
            rows = materialize(rows, "rows")
            discard(*done_with)
            done_with = [rows]
        counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
        shared = materialize(rows.join(counts, "path"), "paths")
        small = shared.where(F.col("n") <= BUCKET).join(classes.select("cls", "sketch"), "cls").select("path", "cls", "sketch")
        edges = small.repartition("path").sortWithinPartitions("path").mapInArrow(_bucket_batches, "a binary, b binary")
        done_with.append(shared)
        large = shared.where(F.col("n") > BUCKET)
        if large.isEmpty():
            found.append(materialize(edges, "candidates"))
            break
        if depth == DEPTH:
            least = large.groupBy("path").agg(F.min("cls").alias("b"))
            stars = large.join(least, "path").select(F.col("cls").alias("a"), "b").where("a != b")
            found.append(materialize(edges.unionAll(stars.distinct()), "candidates"))
            break
        full = large.join(classes.select("cls", "sketch"), "cls").select("path", "cls", "sketch")
        heads = full.groupBy("path").agg(*[F.min_by(F.struct("cls", "sketch"), F.xxhash64("cls", F.lit(k))).alias(f"p{k}") for k in each])
        heads = heads.select("path", *[F.col(f"p{k}.cls").alias(f"pivot{k}") for k in each], *[F.col(f"p{k}.sketch").alias(f"pivot{k}_sketch") for k in each])
        ints = [f"near{k} int" for k in each] + [f"far{k} int" for k in each]
        judged = materialize(full.join(heads, "path").mapInArrow(_pivot_batches, f"path long, cls binary, sketch binary, edges array<binary>, {', '.join(ints)}"), "pivots")
        done_with.append(judged)
        edges = edges.unionAll(judged.select(F.col("cls").alias("a"), F.explode("edges").alias("b")).distinct())
        outside = [F.sum((F.col(f"far{k}") >= 0).cast("long")).alias(f"out{k}") for k in each]
        buckets = judged.groupBy("path").agg(F.count(F.lit(1)).alias("n"), *outside, *[F.max(f"far{k}").alias(f"high{k}") for k in each])
        fewest = F.least(*[F.col(f"out{k}") for k in each])
        done = buckets.where(fewest <= FEW)
        best = F.array_position(F.array(*[F.col(f"out{k}") for k in each]), fewest).cast("int")
        chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("int")
        in_done = judged.join(done.where(fewest > 0).select("path", best.alias("best"), chunks.alias("chunks")), "path")
        far = F.element_at(F.array(*[F.col(f"far{k}") for k in each]), F.col("best"))
        few = in_done.where(far >= 0).select("path", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(0).alias("side"), "cls", "sketch")
        rest = in_done.select("path", F.pmod(F.xxhash64("cls"), F.col("chunks")).cast("int").alias("chunk"), F.lit(1).alias("side"), "cls", "sketch")
        met = few.unionAll(rest).select(F.xxhash64("path", "chunk").alias("key"), "side", "cls", "sketch")
        edges = edges.unionAll(met.repartition("key").sortWithinPartitions("key").mapInArrow(_few_batches, "a binary, b binary"))
        found.append(materialize(edges, "candidates"))
        goes = [(F.col(f"near{k}") >= PIVOT_NEAR * SKETCH) & (F.col(f"near{k}") > F.col(f"high{k}") + PIVOT_GAP * SKETCH) for k in each]
        stay = judged.join(buckets.where(fewest > FEW), "path").where(~reduce(or_, goes))
        # the branch's tokens: members of the sketch, other ones for every path
        pick = lambda t: F.pmod(F.xxhash64("path", F.lit(t)), F.lit(SKETCH)).cast("int")
        token = lambda t: F.xxhash64("path", pick(t), F.substring(F.col("sketch"), 2 * pick(t) + 1, F.lit(2)))
        rows = stay.select("cls", F.explode(F.array_distinct(F.array(*[token(t) for t in range(BRANCH)]))).alias("path"))
    discard(*done_with)
    return reduce(DataFrame.unionAll, found)


def exact_links(sets: list[np.ndarray], left: np.ndarray | None = None) -> np.ndarray:
    """Which pairs have a similarity of at least SIMILARITY, as a boolean matrix; with ``left`` (boolean per
    set) only pairs of one set in it and one out of it."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    rows, cols = (np.arange(n), np.arange(n)) if left is None else (np.flatnonzero(left), np.flatnonzero(~left))
    linked = np.zeros((n, n), bool)
    if not (len(rows) and len(cols) and sizes.sum()):
        return linked
    if n == 2:
        common = np.zeros((2, 2))
        common[0, 1] = common[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        common = common[np.ix_(rows, cols)]
    else:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
        _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        keep = count[column] >= 2
        place = np.cumsum(count >= 2) - 1
        column, owner = place[column[keep]], owner[keep]
        by = np.argsort(column, kind="stable")
        column, owner = column[by], owner[by]
        common = np.zeros((len(rows), len(cols)), np.float32)
        width = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            i, j = np.searchsorted(column, [start, start + width])
            x = np.zeros((n, min(width, int(column[j - 1]) - start + 1) if j > i else 1), np.float32)
            x[owner[i:j], column[i:j] - start] = 1
            common += x @ x.T if left is None else x[rows] @ x[cols].T
    union = sizes[rows][:, None] + sizes[cols][None, :] - common
    near = (common >= SIMILARITY * union - 1e-6) & (sizes[rows][:, None] > 0) & (sizes[cols][None, :] > 0)
    linked[np.ix_(rows, cols)] = near
    if left is not None:
        linked |= linked.T
    np.fill_diagonal(linked, False)
    return linked


VERIFIED = "a binary, b binary, links long"


def _emitted(rows: list[tuple[bytes, bytes | None, int | None]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.binary(), pa.binary(), pa.int64()))], ["a", "b", "links"])


def _within_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each set of a block: the label (smallest set) of its class within the block, and its links in it."""
    out: list[tuple[bytes, bytes | None, int | None]] = []
    for table in runs(batches, "pair"):
        rows: dict[bytes, str] = dict(zip(table.column("cls").to_pylist(), table.column("text").to_pylist()))
        names = sorted(rows)
        linked = exact_links(shingle_sets(pa.array([rows[c] for c in names], pa.string())))
        count, root = linked.sum(1).tolist(), _forest(linked).tolist()
        out += [(name, names[r], c) for name, r, c in zip(names, root, count)]
        if len(out) > 10_000:
            yield _emitted(out)
            out = []
    if out:
        yield _emitted(out)
    give_back()


def _across_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of two blocks: the links of each set (without b), and one edge for two labels with a link between them."""
    out: list[tuple[bytes, bytes | None, int | None]] = []
    for table in runs(batches, "pair"):
        rows = {(s, c): (x, t) for s, c, x, t in zip(*(table.column(k).to_pylist() for k in ("side", "cls", "label", "text")))}
        keys = sorted(rows)
        side = np.array([k[0] for k in keys], bool)
        if side.all() or not side.any():
            continue
        linked = exact_links(shingle_sets(pa.array([rows[k][1] for k in keys], pa.string())), side)
        count = linked.sum(1)
        out += [(keys[i][1], None, int(count[i])) for i in np.flatnonzero(count).tolist()]
        labels, number = np.unique(np.array([rows[k][0] for k in keys], object), return_inverse=True)
        i, j = np.nonzero(np.triu(linked))
        for x, y in np.unique(np.sort(np.stack([number[i], number[j]], 1), 1), axis=0).tolist() if len(i) else []:
            if x != y:
                out.append((labels[x], labels[y], None))
        if len(out) > 10_000:
            yield _emitted(out)
            out = []
    if out:
        yield _emitted(out)
    give_back()


def _across(left: DataFrame, right: DataFrame, name: str, upper: bool = False) -> DataFrame:
    """Links between the blocks of ``left`` (columns root, block, others: how many blocks stand on the right) and
    those of ``right``; ``upper``: only of a smaller with a larger block number."""
    sides = []
    for side, rows in enumerate((left, right)):
        other = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        if upper:
            other = other.where("block < other" if side == 0 else "other < block")
        i, j = ("block", "other") if side == 0 else ("other", "block")
        sides.append(other.select(F.xxhash64("root", i, j).alias("pair"), F.lit(side).alias("side"), "cls", "label", "text"))
    both = sides[0].unionAll(sides[1])
    return materialize(both.repartition("pair").sortWithinPartitions("pair").mapInArrow(_across_batches, VERIFIED), name)


def _edges(verified: DataFrame) -> DataFrame:
    return verified.where("b is not null").select("a", "b")


def _verified(texts: DataFrame, count_links: bool) -> tuple[DataFrame, DataFrame]:
    """Exact links of candidate groups (cls, root, blocks, block, text): (cls, n_links), which is empty unless
    links are counted, and the edges (a, b) that connect the classes."""
    keyed = texts.withColumn("pair", F.xxhash64("root", "block")).select("pair", "cls", "text")
    within = materialize(keyed.repartition("pair").sortWithinPartitions("pair").mapInArrow(_within_batches, VERIFIED), "within")
    links, edges = within.select(F.col("a").alias("cls"), F.col("links").alias("n_links")), within.where("a != b").select("a", "b")
    many = texts.where("blocks > 1")
    if many.isEmpty():
        return links, edges
    label = within.select(F.col("a").alias("cls"), F.col("b").alias("label"))
    many = materialize(many.join(label, "cls").withColumn("others", F.col("blocks")), "labelled")
    if count_links:
        across = _across(many, many, "across", upper=True)
        counted = across.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("links").alias("n"))
        links = links.join(counted, "cls", "left").select("cls", (F.col("n_links") + F.coalesce("n", F.lit(0))).alias("n_links"))
        return links, edges.unionAll(_edges(across))
    # all meet the leaders of their group
    led = _across(_leaders(many), many.withColumn("others", F.lit(1)), "leaders")
    edges = edges.unionAll(_edges(led))
    # classes of labels so far; what is not in the largest of its group meets all the rest
    joined = components(_edges(led)).select(F.col("node").alias("label"), F.col("root").alias("part"))
    parts = many.select("root", "cls", "label", "blocks").join(joined, "label", "left").withColumn("part", F.coalesce("part", "label"))
    sizes = parts.groupBy("root", "part").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("root").agg(F.max_by("part", F.struct("m", "part")).alias("largest"), F.sum("m").alias("all"), F.max("m").alias("most"))
    rest = largest.select("root", "largest", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("lefts")).where("lefts > 0")
    if rest.isEmpty():
        return links, edges
    minor = parts.join(rest, "root").where("part != largest").select("cls", F.pmod(F.xxhash64("cls", F.lit(7)), F.col("lefts")).cast("int").alias("lblock"))
    left = many.join(minor, "cls").withColumn("block", F.col("lblock"))
    right = many.join(rest.select("root", "lefts"), "root").withColumn("others", F.col("lefts"))
    return links, edges.unionAll(_edges(_across(left, right, "rest")))


def _leaders(many: DataFrame) -> DataFrame:
    """``LEADERS`` sets of each group, those of smallest hash, as one block."""
    order = F.struct(F.xxhash64("cls", F.lit(1)).alias("h"), F.col("cls").alias("c"))
    # a set per group and slot: partial minima, and no group in one place
    slot = F.pmod(F.xxhash64("cls", F.lit(3)), F.lit(LEADERS))
    first = many.groupBy("root", slot.alias("slot")).agg(F.min(order).alias("x")).select(F.col("x.c").alias("cls"))
    return many.join(first, "cls").withColumn("block", F.lit(0))


def similarity_classes(docs: DataFrame, count_links: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id (smallest doc_id of all texts connected by links),
    n_copies (further rows with an equal text) and n_links (different texts of similarity >= 0.8; only
    with ``count_links``)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("cls"))
    sketched = materialize(keyed.mapInArrow(_sketch_batches, "doc_id long, cls binary, paths array<long>, sketch binary, size int"), "sketches")
    classes = sketched.groupBy("cls").agg(F.min(F.coalesce(F.col("doc_id"), F.lit(2**63 - 1))).alias("rep"), F.count(F.lit(1)).alias("n"), F.first("paths").alias("paths"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    classes = materialize(classes, "classes")
    groups = components(candidate_edges(classes))
    members = groups.join(classes.select(F.col("cls").alias("node"), "rep", "size"), "node")
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("m"), F.sum("size").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / F.lit(BLOCK)), F.ceil(F.col("shingles") / F.lit(BLOCK_SHINGLES))).cast("int")
    members = members.join(sizes, "root").select(F.col("node").alias("cls"), "rep", "root", blocks.alias("blocks"), F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"))
    members = materialize(members, "groups")
    # the members grow with the data: a merge join at any size
    members = members.hint("merge")
    texts = keyed.join(members, (keyed["cls"] == members["cls"]) & (F.coalesce(keyed["doc_id"], F.lit(2**63 - 1)) == members["rep"])).select(members["cls"], "text", "root", "blocks", "block")
    links, edges = _verified(materialize(texts, "texts"), count_links)
    linked = components(edges)
    rep = classes.select("cls", "rep", "n")
    named = linked.join(rep, linked["node"] == rep["cls"])
    class_ids = named.groupBy("root").agg(F.min("rep").alias("class_rep"))
    of_class = named.join(class_ids, "root").select("cls", "class_rep")
    full = rep.join(of_class, "cls", "left")
    class_id = F.coalesce("class_rep", "rep")
    columns = [F.when(class_id < 2**63 - 1, class_id).alias("class_id"), (F.col("n") - 1).alias("n_copies")]
    if count_links:
        full = full.join(links, "cls", "left")
        columns.append(F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    full = full.select("cls", *columns)
    return sketched.select("doc_id", "cls").join(full, "cls").drop("cls")


def one_per_class(docs: DataFrame) -> DataFrame:
    """The first document of every class, with its own columns; equal rows come down to one. Rows without a
    doc_id stay unless their class has one with it."""
    chosen = similarity_classes(docs, count_links=False).where(F.col("doc_id").eqNullSafe(F.col("class_id"))).select(F.col("doc_id").alias("__chosen")).distinct()
    kept = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col("__chosen")), "left_semi")
    return kept.withColumn("__text", F.xxhash64("text")).dropDuplicates(["doc_id", "__text"]).select(*docs.columns)
