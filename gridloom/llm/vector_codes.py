"""Vector code compression: eight small codebooks fitted by Lloyd's rounds with Yinyang bounds, in exact integers.

Components become integers, floor(4096 x), and vectors are cut into equal parts, each with a codebook of its own. The
entries of a codebook are clustered into groups once. A part of a vector keeps its entry and, for each group, a lower
bound of its distance to the group's other entries. When entries move, a bound shrinks by the farthest move in its
group. A group is scanned only if its bound no longer exceeds the distance to the own entry (which is computed, so it
is exact); a scan compares exact squared distances and then indexes, so ties go to the lower index as in a full search.
Bounds are integers: distances rounded down, moves rounded up. A bound that equals the own distance is scanned.

Each round is two jobs: one writes every vector's integers, entries and bounds to the shared folder, the next adds them
up, within tasks first, to the sums of the codebooks' components. Only the codebooks, of a fixed size, reach the driver.

Edge cases: rows whose vector is null or has null or non-finite components are left out. Those whose length isn't that
of the smallest vec_id's vector or isn't a positive multiple of the parts, or that have a component of 65,536 or more
(whose squares could overflow), stay with null code and error. Repeated rows count as often as they are there; of equal
vec_ids the smaller vector is first, null ids are last. With under 16 vectors there are as many entries; without any,
no rows. Only the columns named are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import materialize

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: Components below this keep squared distances of up to 2^61 in 64 bits.
LARGEST = 1 << 16
GROUP = 8  # entries a group, about
FAR = np.int64(1) << 30  # the bound of a group without other entries
LABELS = 100_000  # label sums up to so many rows are broadcast


def _root_down(squares: np.ndarray) -> np.ndarray:
    return np.floor(np.sqrt(squares.astype(float)) * (1 - 1e-12)).astype(np.int64)


def _root_up(squares: np.ndarray) -> np.ndarray:
    return np.ceil(np.sqrt(squares.astype(float)) * (1 + 1e-12)).astype(np.int64)


def group_entries(book: np.ndarray) -> np.ndarray:
    """The group of each entry of one codebook: a few rounds of clustering from far-apart seeds."""
    n = max(1, -(-len(book) // GROUP))
    seeds = [0]
    gaps = lambda centres: ((book[:, None, :].astype(float) - np.asarray(centres, float)[None]) ** 2).sum(2)
    while len(seeds) < n:
        seeds.append(int(gaps(book[seeds]).min(1).argmax()))
    centres = book[seeds].astype(float)
    for _ in range(5):
        of = gaps(centres).argmin(1)
        centres = np.stack([book[of == g].mean(0) if (of == g).any() else centres[g] for g in range(n)])
    return gaps(centres).argmin(1)


def moves(old: np.ndarray, new: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """The farthest move, rounded up, in each group of one codebook."""
    far = _root_up(((new - old) ** 2).sum(1))
    return np.array([far[groups == g].max(initial=0) for g in range(groups.max() + 1)], np.int64)


def assign_part(x: np.ndarray, own: np.ndarray | None, lower: np.ndarray | None, book: np.ndarray, moved: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Of one part of many vectors: the nearest entry, the groups' bounds, the squared distance, and how many distances
    were computed. ``own`` and ``lower`` are those of the last round (None in the first)."""
    n, g_n = len(x), int(groups.max()) + 1
    first = own is None
    own = np.zeros(n, np.int64) if first else own
    lower = np.full((n, g_n), -1, np.int64) if first else np.maximum(lower - moved, 0)
    before = ((x - book[own]) ** 2).sum(1)
    nearest, best, work = own.copy(), before.copy(), n
    fails = (lower < 0) | (lower * lower <= before[:, None])
    scans = []
    for g in range(g_n):
        rows, entries = np.flatnonzero(fails[:, g]), np.flatnonzero(groups == g)
        if not len(rows) or not len(entries):
            continue
        d = ((x[rows, None, :] - book[entries][None]) ** 2).sum(2)
        work += d.size
        at = d.argmin(1)  # the first of equals, and entries ascend
        value, entry = d[np.arange(len(rows)), at], entries[at]
        better = (value < best[rows]) | ((value == best[rows]) & (entry < nearest[rows]))
        best[rows[better]], nearest[rows[better]] = value[better], entry[better]
        scans.append((g, rows, entries, d))
    for g, rows, entries, d in scans:
        d[nearest[rows, None] == entries[None]] = FAR * FAR
        lower[rows, g] = np.minimum(_root_down(d.min(1)), FAR)
    left = np.flatnonzero(nearest != own)  # an entry that was left counts among its group's others again
    lower[left, groups[own[left]]] = np.minimum(lower[left, groups[own[left]]], _root_down(before[left]))
    return nearest, lower, best, work


def assign(x: np.ndarray, own: np.ndarray | None, lower: np.ndarray | None, books: list[np.ndarray], moved: list[np.ndarray], groups: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The parts' entries (n, parts), bounds (n, all groups), the summed squared distances and the work."""
    width, at, out = x.shape[1] // len(books), 0, []
    for p, book in enumerate(books):
        n = int(groups[p].max()) + 1
        out.append(assign_part(x[:, p * width : (p + 1) * width], None if own is None else own[:, p], None if lower is None else lower[:, at : at + n], book, moved[p], groups[p]))
        at += n
    return np.stack([o[0] for o in out], 1), np.concatenate([o[1] for o in out], 1), np.sum([o[2] for o in out], 0), sum(o[3] for o in out)


def _matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix of 64-bit integers."""
    flat = np.asarray(column.flatten())
    return flat.reshape(len(column), -1).astype(np.int64)


def _lists(values: np.ndarray) -> pa.Array:
    at = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel().astype(np.int32), pa.int32()))


def integers(vectors: DataFrame, vector: str, key: str, keep: list[str]) -> tuple[DataFrame, int]:
    """The columns ``keep`` and x, the integers of each vector that takes part (null if it doesn't fit), and their length."""
    v = F.col(vector).cast("array<double>")
    whole = vectors.where(F.col(vector).isNotNull() & ~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))))
    small = (F.size(v) > 0) & (F.size(v) % PARTS == 0) & ~F.exists(v, lambda c: F.abs(c) >= LARGEST)
    first = whole.where(small).select(F.size(v).alias("n"), F.col(key), v.alias("v")).orderBy(F.col(key).asc_nulls_last(), "v").limit(1).collect()
    length = first[0].n if first else 0
    x = F.when(small & (F.size(v) == length), F.transform(v, lambda c: F.floor(c * SCALE).cast("int")))
    return whole.select(*keep, x.alias("x")), length


def _step(state: DataFrame, keep: list[str], books, moved, groups, first: bool, last: bool) -> DataFrame:
    """One assignment of all vectors: their new state or, in the last, ``code`` and ``error``."""
    made = [("code", "string"), ("error", "long")] if last else [("x", "array<int>"), ("own", "array<int>"), ("lower", "array<int>")]
    schema = T.StructType([state.schema[c] for c in keep] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in made])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, 4096):
                part = batch.slice(begin, 4096)
                x = _matrix(part.column("x"))
                own, lower = (None, None) if first else (_matrix(part.column("own")), _matrix(part.column("lower")))
                own, lower, error, _ = assign(x, own, lower, books, moved, groups)
                if last:
                    digits = own.astype(np.uint8).tobytes().hex()
                    out = [pa.array([digits[i : i + 2 * PARTS] for i in range(0, len(digits), 2 * PARTS)], pa.string()), pa.array(error, pa.int64())]
                else:
                    out = [part.column("x"), _lists(own), _lists(lower)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *out], schema.names)

    return state.mapInArrow(run, schema)


def _sums(state: DataFrame, sizes: list[int], width: int) -> dict[tuple[int, int], tuple[int, list[int]]]:
    """(part, entry) to count and summed components: added within tasks, then over tasks; entries x parts x (width + 1)
    numbers come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros((k, width + 1), np.int64) for k in sizes]
        for batch in batches:
            x, own = _matrix(batch.column("x")), _matrix(batch.column("own"))
            for p, t in enumerate(total):
                t[:, 0] += np.bincount(own[:, p], minlength=len(t))
                for i in range(width):  # whole numbers far below 2^53: exact
                    t[:, i + 1] += np.bincount(own[:, p], weights=x[:, p * width + i], minlength=len(t)).astype(np.int64)
        rows = [(p, j) for p, t in enumerate(total) for j in range(len(t))]
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in rows], pa.int32()), pa.array([j for _, j in rows], pa.int32()), pa.array([total[p][j].tolist() for p, j in rows], pa.list_(pa.int64()))], ["part", "entry", "sums"])

    parts = state.select("x", "own").mapInArrow(run, "part int, entry int, sums array<long>")
    added = parts.select("part", "entry", F.posexplode("sums").alias("i", "s")).groupBy("part", "entry", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out: dict[tuple[int, int], list[int]] = {}
    for r in added.collect():
        out.setdefault((r.part, r.entry), [0] * (width + 1))[r.i] = int(r.s)
    return {k: (v[0], v[1:]) for k, v in out.items()}


def _label_sums(coded: DataFrame, label: str) -> DataFrame:
    """``coded`` with the errors summed over its label. Sums are a row a label; above ``LABELS`` rows they are joined
    in 64 copies, each label's vectors dealt over them, so that no label is one task."""
    sums = coded.groupBy(F.col(label).alias("__label")).agg(F.sum("error").alias("label_error"))
    if sums.limit(LABELS + 1).count() <= LABELS:
        return coded.join(F.broadcast(sums), F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
    dealt = coded.withColumn("__salt", F.pmod(F.xxhash64("code", "error"), F.lit(64)))
    copies = sums.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(63))))
    return dealt.join(copies, F.col(label).eqNullSafe(F.col("__label")) & (F.col("__salt") == F.col("__copy")), "left").drop("__label", "__salt", "__copy")


def vector_codes(vectors: DataFrame, vector: str = "embedding", key: str = "vec_id", label: str = "label", rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """key, code (two hex digits a part), error (squared distances summed over parts) and label_error (errors summed over
    equal labels, null ones together) of every vector, and the codebooks (parts x entries x width)."""
    keep = [key, label]
    rows, length = integers(vectors.select(key, label, vector), vector, key, keep)
    width = length // PARTS
    misfits = rows.where(F.col("x").isNull()).select(*keep, F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not length:
        return misfits.select(key, "code", "error", F.lit(None).cast("long").alias("label_error")), [np.empty((0, 0), np.int64)] * PARTS
    state = rows.where(F.col("x").isNotNull())
    seeds = np.array([r.x for r in state.orderBy(F.col(key).asc_nulls_last(), "x").limit(ENTRIES).select("x").collect()], np.int64)
    books = [seeds[:, p * width : (p + 1) * width] for p in range(PARTS)]
    groups = [group_entries(b) for b in books]
    moved = [np.zeros(g.max() + 1, np.int64) for g in groups]
    for r in range(rounds):
        state = materialize(_step(state, keep, books, moved, groups, r == 0, False), f"codes-{r}")
        sums = _sums(state, [len(b) for b in books], width)
        new = [b.copy() for b in books]
        for (p, j), (n, total) in sums.items():
            if n:
                new[p][j] = [s // n for s in total]
        moved = [moves(b, c, g) for b, c, g in zip(books, new, groups)]
        books = new
    coded = _step(state, keep, books, moved, groups, rounds == 0, True)
    return _label_sums(materialize(coded.unionByName(misfits), "codes"), label).select(key, "code", "error", "label_error"), books


def books_digest(books: list[np.ndarray]) -> str:
    """The sha256 of all entries' components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def decoded(codes: DataFrame, books: list[np.ndarray], code: str = "code") -> DataFrame:
    """The rows with ``approximation``, the vector that the code stands for (null without a code)."""
    table = F.array(*[F.array(*[F.array(*[F.lit(v / SCALE) for v in entry]) for entry in b.tolist()]) for b in books])
    entry = lambda p: F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int") + 1
    return codes.withColumn("approximation", F.flatten(F.array(*[F.element_at(F.element_at(table, p + 1), entry(p)) for p in range(len(books))])))
