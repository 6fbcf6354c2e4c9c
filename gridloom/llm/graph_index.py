"""Approximate nearest neighbours (largest inner product) by robust-pruned directed graphs, one per shard.

Vectors are lifted by one coordinate so that the largest inner product is the smallest distance. The lift is
shifted to be small for all but the longest vectors, and queries order by the inner product itself. Single
precision serves the graph alone: vectors are scaled by the shard's median length, and those much longer or
shorter than it (``PLAIN``) stay out of the graph and are compared with every query exactly, so that no vector of
odd length rounds away the others. A shard's
graph grows in batches: greedy beam searches over the graph so far propose neighbours of the new vectors;
robust pruning with a relaxed distance (``ALPHA``) keeps diverse edges, at most ``DEGREE``; reverse edges
are added and pruned alike. A query is answered by a beam search in every shard and exact scores, in double
precision on the original vectors, of what the beams hold.

Equal vectors are one node that carries its smallest ids (one more than a query wants), so any number of
copies costs one node. Shards have about ``SHARD_ROWS`` distinct vectors, so a task's memory is bounded. Queries
stream past a shard's index, which travels once for ``QUERY_BLOCK`` of them (under a tenth of their own bytes); each
query visits each shard, so work grows with queries times shards. All rows are indexed. Tests hold recall at 20
against brute force to 0.9 at least.

Edge cases: vectors that are null, empty, zero or hold null, NaN or infinite components take no part, nor
do rows without an id; vectors meet only those of their own dimension; repeated (id, vector) rows count
once; of rows that share an id but not the vector all are candidates, and the smallest vector is the query; ties go
to the smaller id; fewer candidates than wanted are all returned; empty tables give none; further columns are
left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import give_back, materialize

DEGREE, BEAM, ALPHA, BATCH, EXPAND, ENTRIES = 32, 160, 1.2, 512, 4, 16
SHARD_ROWS, QUERY_BLOCK, NEIGHBOURS, SEED = 8192, 1 << 17, 20, 11
SMALL_TABLE, SALT = 100_000, 64
PLAIN = (1e-6, 1e6)  # lengths within the graph, in median lengths


def lift(x: np.ndarray) -> np.ndarray:
    """float32 vectors of equal length but for a shift of the last coordinate, which no distance changes: less the
    largest norm, in the form that keeps its digits. Short vectors beside a long one have almost none of it."""
    x = x.astype(np.float64)
    squares = np.einsum("ij,ij->i", x, x)
    most = squares.max()
    shifted = -squares / np.maximum(np.sqrt(most) + np.sqrt(np.maximum(most - squares, 0)), 1e-300)
    return np.column_stack([x, shifted]).astype(np.float32)


def beam_search(points: np.ndarray, graph: np.ndarray, entries: np.ndarray, queries: np.ndarray, beam: int, expand: int = EXPAND, by_product: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """For each query the beam's nodes (-1: none), nearest first, and their squared distances less |q|^2, or
    ``by_product`` the inner products times -2."""
    n, b = len(points), len(queries)
    width = max(beam, len(entries))
    norms = np.zeros(n, np.float32) if by_product else np.einsum("ij,ij->i", points, points)
    ids = np.full((b, width), -1, np.int64)
    dist = np.full((b, width), np.inf, np.float32)
    done = np.ones((b, width), bool)
    seen = np.zeros((b, n + 1), bool)
    rows = np.arange(b)[:, None]
    ids[:, : len(entries)], done[:, : len(entries)] = entries, False
    dist[:, : len(entries)] = norms[entries] - 2 * queries @ points[entries].T
    seen[:, entries] = True
    seen[:, n] = True  # where missing edges point
    order = np.argsort(dist, axis=1, kind="stable")
    ids, dist, done = ids[rows, order], dist[rows, order], done[rows, order]
    active = np.arange(b)
    while len(active):
        open_ = ~done[active]
        rank = np.cumsum(open_, axis=1)
        pick = open_ & (rank <= expand)
        live = pick.any(1)
        active, pick = active[live], pick[live]
        if not len(active):
            break
        who, col = np.nonzero(pick)
        done[active[who], col] = True
        near = graph[ids[active[who], col]]
        # put every query's new neighbours side by side
        slot = np.arange(len(who)) - np.searchsorted(who, who)
        wide = np.full((len(active), expand, graph.shape[1]), n, np.int64)
        wide[who, slot] = near
        wide = wide.reshape(len(active), -1)
        wide[wide < 0] = n
        fresh = ~seen[active[:, None], wide]
        wide[~fresh] = n
        seen[active[:, None], wide] = True
        wide.sort(axis=1)
        wide[:, 1:][wide[:, 1:] == wide[:, :-1]] = n
        far = wide == n
        keep = ~far.all(0)
        wide, far = wide[:, keep], far[:, keep]
        if not wide.shape[1]:
            continue
        at = np.where(far, 0, wide)
        d = norms[at] - 2 * np.matmul(points[at], queries[active][:, :, None])[:, :, 0]
        d[far] = np.inf
        all_d = np.concatenate([dist[active], d], axis=1)
        best = np.argpartition(all_d, width - 1, axis=1)[:, :width]
        r = np.arange(len(active))[:, None]
        best = best[r, np.argsort(all_d[r, best], axis=1, kind="stable")]
        dist[active] = all_d[r, best]
        ids[active] = np.concatenate([ids[active], np.where(far, -1, wide)], axis=1)[r, best]
        done[active] = np.concatenate([done[active], far], axis=1)[r, best]
    return ids[:, :beam], dist[:, :beam]


def robust_prune(points: np.ndarray, owners: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each owner at most ``degree`` of its candidates (-1: none): nearest first, dropping those that are
    nearer, by the factor ``alpha``, to a chosen one than to the owner."""
    b, m = candidates.shape
    at = np.maximum(candidates, 0)
    gone = (candidates < 0) | (candidates == owners[:, None])
    rows = np.arange(b)[:, None]
    x = points[at]
    d = ((x - points[owners][:, None, :]) ** 2).sum(2)
    d[gone] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    at, gone, d, x = at[rows, order], gone[rows, order], d[rows, order], x[rows, order]
    squares = np.einsum("bmd,bmd->bm", x, x)
    between = squares[:, :, None] + squares[:, None, :] - 2 * np.matmul(x, x.transpose(0, 2, 1))
    gone[:, 1:] |= at[:, 1:] == at[:, :-1]
    out = np.full((b, degree), -1, np.int32)
    for r in range(min(degree, m)):
        first = np.argmin(gone, axis=1)
        live = np.flatnonzero(~gone[np.arange(b), first])
        if not len(live):
            break
        out[live, r] = at[live, first[live]]
        gone[live, first[live]] = True
        gone[live] |= alpha * alpha * np.maximum(between[live, first[live]], 0) <= d[live]
    return out


def entry_points(n: int) -> np.ndarray:
    """All nodes of a small shard; else some spread over it."""
    if n <= BEAM:
        return np.arange(n)
    return np.unique(np.random.default_rng(SEED).integers(0, n, ENTRIES))


def build(points: np.ndarray, degree: int = DEGREE, beam: int = 64, alpha: float = ALPHA) -> np.ndarray:
    """The graph of lifted vectors: rows of at most ``degree`` neighbours, -1 for none."""
    n = len(points)
    graph = np.full((n, degree), -1, np.int32)
    order = np.random.default_rng(SEED).permutation(n)
    entries = entry_points(n)
    order = np.concatenate([entries, order[~np.isin(order, entries)]])
    start = min(n, 2 * degree + len(entries))
    seed = order[:start]
    graph[seed] = robust_prune(points, seed, np.tile(seed, (start, 1)), degree, alpha)
    while start < n:
        batch = order[start : start + min(BATCH, start)]
        found, _ = beam_search(points, graph, entries, points[batch], beam)
        graph[batch] = robust_prune(points, batch, found, degree, alpha)
        sources, targets = np.repeat(batch, degree), graph[batch].ravel()
        sources, targets = sources[targets >= 0], targets[targets >= 0]
        by = np.argsort(targets, kind="stable")
        sources, targets = sources[by], targets[by]
        touched, first, counts = np.unique(targets, return_index=True, return_counts=True)
        rank = np.arange(len(targets)) - np.repeat(first, counts)
        fit = rank < 2 * degree
        incoming = np.full((len(touched), min(2 * degree, counts.max())), -1, np.int64)
        incoming[np.repeat(np.arange(len(touched)), counts)[fit], rank[fit]] = sources[fit]
        have = (graph[touched] >= 0).sum(1)
        roomy = have + counts <= degree
        for rows, full in ((np.flatnonzero(roomy), False), (np.flatnonzero(~roomy), True)):
            if not len(rows):
                continue
            both = np.concatenate([graph[touched[rows]], incoming[rows]], axis=1)
            if full:
                for s in range(0, len(rows), 256):
                    graph[touched[rows[s : s + 256]]] = robust_prune(points, touched[rows[s : s + 256]], both[s : s + 256], degree, alpha)
            else:
                graph[touched[rows]] = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)[:, :degree]
        start += len(batch)
    return graph


INDEX_SCHEMA = "shard long, size int, dim int, middle double, vectors binary, graph binary, ids binary, id_counts binary"


def _lengths(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(1)
    return most * np.sqrt(((x / most[:, None]) ** 2).sum(1))


def _build_shard(table: pa.Table) -> pa.Table:
    vectors = np.array(table.column("embedding").to_pylist(), np.float64)
    lengths = _lengths(vectors)
    middle = np.sort(lengths)[len(lengths) // 2]
    odd = (lengths < PLAIN[0] * middle) | (lengths > PLAIN[1] * middle)
    order = np.lexsort((*vectors.T[::-1], odd))  # the graph's nodes come first
    vectors = np.ascontiguousarray(vectors[order])
    ids = table.column("ids").to_pylist()
    ids = [sorted(ids[i]) for i in order]
    graph = build(lift(vectors[: len(vectors) - odd.sum()] / middle))
    row = [int(table.column("shard")[0].as_py()), len(vectors), vectors.shape[1], float(middle), vectors.tobytes(), graph.tobytes(), np.array([i for x in ids for i in x], np.int64).tobytes(), np.array([len(x) for x in ids], np.int32).tobytes()]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), *[pa.binary()] * 4]
    return pa.Table.from_arrays([pa.array([v], t) for v, t in zip(row, types)], [x.split()[0] for x in INDEX_SCHEMA.split(", ")])


def usable(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """id and vector of the rows that take part."""
    v = F.col(vector).cast("array<double>")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(good, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), v.alias("embedding"))


def _small(table: DataFrame, most: int) -> DataFrame:
    """``table``, to be broadcast if it has at most ``most`` rows of a few numbers."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def build_index(vectors: DataFrame, copies: int = NEIGHBOURS + 1, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per shard, written to the shared folder. Copies are pre-aggregated before the shuffle: a
    row number up to ``copies`` is cut off on the map side."""
    own = Window.partitionBy("embedding").orderBy("vec_id")
    first = vectors.groupBy("embedding", "vec_id").agg(F.lit(1).alias("__one")).withColumn("__r", F.row_number().over(own)).where(F.col("__r") <= copies)
    nodes = materialize(first.groupBy("embedding").agg(F.collect_list("vec_id").alias("ids")), "ann-nodes")
    sizes = nodes.groupBy(F.size("embedding").alias("dim")).agg(F.count(F.lit(1)).alias("n"))
    spread = sizes.select("dim", F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(shard_rows))).cast("long").alias("shards"))
    placed = nodes.withColumn("dim", F.size("embedding")).join(_small(spread, SMALL_TABLE), "dim")
    shard = F.col("dim").cast("long") * F.lit(1 << 32) + F.pmod(F.xxhash64("embedding"), F.col("shards"))
    rows = placed.select(shard.alias("shard"), "embedding", "ids")
    return materialize(rows.groupBy("shard").applyInArrow(_build_shard, INDEX_SCHEMA), "ann-index")


RESULT_SCHEMA = "query_id long, vec_id long, score double"


class Shard:
    """A shard's index in memory, from its row."""

    def __init__(self, row: dict):
        self.vectors = np.frombuffer(row["vectors"], np.float64).reshape(row["size"], row["dim"])
        self.graph = np.frombuffer(row["graph"], np.int32).reshape(-1, DEGREE)
        self.counts = np.frombuffer(row["id_counts"], np.int32)
        self.ids, self.starts = np.frombuffer(row["ids"], np.int64), np.cumsum(self.counts) - self.counts
        inside = self.vectors[: len(self.graph)]
        self.points = lift(inside / row["middle"])
        # the longest vectors may have no edge that leads to them
        longest = np.argsort(-_lengths(inside), kind="stable")[:ENTRIES]
        self.entries = np.union1d(entry_points(len(self.points)), longest)

    def _odd(self, wanted: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Queries and nodes of the vectors outside the graph that are among a query's first k of them, with ties."""
        rest = self.vectors[len(self.graph) :]
        if not len(rest):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        score = wanted @ rest.T
        least = np.partition(score, -min(k, len(rest)), axis=1)[:, -min(k, len(rest))]
        who, node = np.nonzero(score >= least[:, None])
        return who, node + len(self.graph)

    def search(self, keys: np.ndarray, wanted: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query, id and score of each query's k nearest of this shard."""
        lifted = np.column_stack([wanted / _lengths(wanted)[:, None], np.zeros(len(wanted))]).astype(np.float32)
        found, _ = beam_search(self.points, self.graph, self.entries, lifted, beam, by_product=True)
        who, col = np.nonzero(found >= 0)
        node = found[who, col]
        more_who, more = self._odd(wanted, k + 1)
        who, node = np.concatenate([who, more_who]), np.concatenate([node, more])
        score = (self.vectors[node] * wanted[who]).sum(axis=1)
        n = self.counts[node]
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        q, v, sc = np.repeat(keys[who], n), self.ids[np.repeat(self.starts[node], n) + inner], np.repeat(score, n)
        keep = q != v
        q, v, sc = q[keep], v[keep], sc[keep]
        order = np.lexsort([v, -sc, q])
        q, v, sc = q[order], v[order], sc[order]
        first = np.arange(len(q)) - np.searchsorted(q, q) < k
        return q[first], v[first], sc[first]


def _search_batches(k: int, beam: int):
    """A shard's index comes first, then the queries of its block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, shard = None, None
        for batch in batches:
            blocks, is_index = batch.column("block").to_pylist(), np.asarray(batch.column("vec_id").is_null())
            shards = batch.column("shard").to_pylist()
            cuts = [i for i in range(len(blocks)) if i == 0 or is_index[i] or (shards[i], blocks[i]) != (shards[i - 1], blocks[i - 1]) or is_index[i - 1]]
            for a, b in zip(cuts, [*cuts[1:], len(blocks)]):
                if is_index[a]:
                    at, shard = (shards[a], blocks[a]), Shard({n.split()[0]: batch.column(n.split()[0])[a].as_py() for n in INDEX_SCHEMA.split(", ")})
                    continue
                if at != (shards[a], blocks[a]):
                    continue
                for s in range(a, b, 512):
                    rows = batch.slice(s, min(512, b - s))
                    columns = shard.search(np.asarray(rows.column("vec_id")), np.array(rows.column("embedding").to_pylist(), np.float64), k, beam)
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])
        give_back()

    return run


def search(queries: DataFrame, index: DataFrame, k: int = NEIGHBOURS, beam: int = BEAM, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's ``k`` nearest found."""
    asked = queries.groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("dim", F.size("embedding"))
    blocks = max(1, -(-queries.count() // query_block))
    of_dim = index.select("shard", "dim")
    if index.count() <= SMALL_TABLE:
        asked = asked.join(F.broadcast(of_dim), "dim")
    else:  # one dimension has all rows: salted
        salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALT)).cast("int")
        asked = asked.withColumn("salt", salt).join(of_dim.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["dim", "salt"])
    asked = asked.select("shard", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "embedding")
    served = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    both = served.unionByName(asked, allowMissingColumns=True)
    hits = both.repartition("shard", "block").sortWithinPartitions("shard", "block", F.col("vec_id").asc_nulls_first()).mapInArrow(_search_batches(k, beam), RESULT_SCHEMA)
    own = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def nearest(vectors: DataFrame, every: int = 20, k: int = NEIGHBOURS) -> DataFrame:
    """Queries: rows whose id is divisible by ``every``; candidates: all rows but the query's own."""
    rows = usable(vectors)
    return search(rows.where(F.col("vec_id") % every == 0), build_index(rows, k + 1), k)
