"""Benchmark decontamination by size-partitioned MinHash containment search.

Which documents hold most of a benchmark item? Items are short and documents may be long, so an item and
a whole document have a tiny resemblance. Items are therefore partitioned by size (powers of two of
their word shingles), and for a partition whose items have up to ``s`` shingles each document is cut
into windows of ``2 s`` shingles that advance by ``s``: a passage of an item lies whole in some window,
with a resemblance of at least 1/4 (an item of over ``s / 2`` shingles against ``2 s``), or 0.19 where
only 0.8 of it is there. Each of ``HASHES`` min-wise hash functions is a band of one row: a window and
an item are candidates if some band agrees. A contained item stays undetected with a probability under
``0.75 ** HASHES`` (1e-6 at 48; 4e-5 at a containment of 0.8, 3e-4 where its shingles lie scattered over the
document). Windows of all sizes come from one set of block minima, so a text is hashed once.

That bound needs an item of over ``s / 2`` distinct shingles, and the smallest ``s`` is ``LEAST_WIDTH``. Items
with fewer (short ones, and long ones that repeat themselves) are not sketched: each of their shingles is
looked up among all of a document's, so none of them is missed.

Candidates are verified with exact shingles (runs of words compared as strings): containment is the
share of the item's distinct shingles that the whole document holds.

Words are separated by white space. A text of fewer than five words has one shingle, all its words, and
counts as contained where these follow one another in a document. Null, empty or white texts match
nothing. Repeated items and documents each give their rows; an empty table gives none. Only ids and texts
are read, so other columns may have any name. Ties: a containment of exactly the share asked for is a match.

The items go to the executors in blocks of ``BLOCK`` items whose texts have at most ``BLOCK_BYTES``, one
pass over the documents for each block; benchmarks of any size are whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import SHINGLE, WORDS, give_back, parts_for, run_hashes, slices, work_path

HASHES, BLOCK, BLOCK_BYTES, CONTAINMENT, SEED = 48, 20_000, 8 << 20, 0.8, 20
LEAST_WIDTH = 16


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    return rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def _split(words: list[str], size: int) -> set[tuple[str, ...]]:
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else set()


class ItemIndex:
    """Items partitioned by size; for each partition and band, the sorted minima with their items. Items too
    small for their partition's bound are in ``exact``: by shingle size, the sorted hashes with their items."""

    def __init__(self, items: list[tuple[object, str]], hashes: int = HASHES, containment: float = CONTAINMENT):
        self.containment, self.hashes = containment, hashes
        self.a, self.b = _multipliers(hashes)
        self.items: list[tuple[object, int, set[tuple[str, ...]]]] = []
        self.hashed: list[np.ndarray] = []
        parts: dict[tuple[int, int], list[int]] = {}
        small: dict[int, list[int]] = {}
        for key, text in items:
            words = (text or "").split()
            if not words:
                continue
            size = min(SHINGLE, len(words))
            hashed = np.unique(run_hashes(WORDS(words), size))
            width = max(LEAST_WIDTH, 1 << int(len(words) - size).bit_length())
            if 2 * len(hashed) <= width:
                small.setdefault(size, []).append(len(self.items))
            else:
                parts.setdefault((size, width), []).append(len(self.items))
            self.items.append((key, size, _split(words, size)))
            self.hashed.append(hashed)
        self.signs: dict[tuple[int, int], np.ndarray] = {}
        self.parts = {}
        for at, members in sorted(parts.items()):
            minima = np.array([[int((self.hashed[m] * a + b).min()) for a, b in zip(self.a, self.b)] for m in members], np.uint64)
            order = np.argsort(minima, axis=0, kind="stable")
            self.parts[at] = (np.take_along_axis(minima, order, 0), np.array(members)[order])
        # hashes that must agree; shingles of an item that share a hash count once
        self.need = np.array([max(1, math.ceil(containment * len(own) - 1e-9) - len(own) + len(h)) for (_, _, own), h in zip(self.items, self.hashed)], np.int64)
        self.exact: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for size, members in sorted(small.items()):
            flat, whose = np.concatenate([self.hashed[m] for m in members]), np.repeat(members, [len(self.hashed[m]) for m in members])
            order = np.argsort(flat, kind="stable")
            self.exact[size] = flat[order], whose[order]

    def looked_up(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """By document, the small items of whose shingles it has enough."""
        out: dict[int, set[int]] = {}
        for size, (keys, members) in self.exact.items():
            everywhere = run_hashes(words, size)
            known = self._known(size)
            at = np.flatnonzero(known[(everywhere & np.uint64(len(known) - 1)).astype(np.int64)])
            doc = np.searchsorted(offsets, at, "right") - 1
            inside = at + size <= offsets[doc + 1]
            low = np.searchsorted(keys, everywhere[at], "left")
            found = inside & (keys[np.minimum(low, len(keys) - 1)] == everywhere[at])
            pairs = np.unique(doc[found] * len(keys) + low[found])  # a shingle counts once in a document
            doc, low = pairs // len(keys), pairs % len(keys)
            n = np.searchsorted(keys, keys[low], "right") - low
            item = members[np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
            both, counts = np.unique(np.repeat(doc, n) * len(self.items) + item, return_counts=True)
            for b in both[counts >= self.need[both % len(self.items)]].tolist():
                out.setdefault(b // len(self.items), set()).add(b % len(self.items))
        return out

    def candidates(self, words: np.ndarray, offsets: np.ndarray) -> dict[int, set[int]]:
        """By document, the items that agree in a band with one of its windows, or are looked up. The documents' word hashes
        follow one another in ``words``; ``offsets`` has where each begins."""
        out = self.looked_up(words, offsets)
        for size in sorted({s for s, _ in self.parts}):
            mine = [(width, at) for (s, width), at in self.parts.items() if s == size]
            counts = np.maximum(np.diff(offsets) - size + 1, 0)
            docs = np.flatnonzero(counts)
            if not len(docs):
                continue
            everywhere = run_hashes(words, size)
            starts = offsets[:-1][docs]
            step = min(w for w, _ in mine)
            blocks = -(-counts[docs] // step)
            inner = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            owner = np.repeat(np.arange(len(docs)), blocks)
            first = starts[owner] + inner * step
            last = np.minimum(first + step, (starts + counts[docs])[owner])
            edges = np.column_stack([first, last]).ravel()
            edges[-1:] = min(edges[-1], len(everywhere))  # the last block runs to the end
            edges = edges[:-1] if edges[-1] == len(everywhere) else edges
            plans = []
            for width, (minima, members) in mine:
                n = width // step
                heads = np.flatnonzero(inner % n == 0)
                whose = owner[heads]
                plans.append((heads, np.flatnonzero(whose[1:] == whose[:-1]), whose, minima, members))
            for k in range(self.hashes):
                low = np.minimum.reduceat(everywhere * self.a[k] + self.b[k], edges)[::2]
                for heads, joined, whose, minima, members in plans:
                    window = np.minimum.reduceat(low, heads)
                    window[joined] = np.minimum(window[joined], window[joined + 1])
                    near = np.flatnonzero(self._signs(k, minima)[(window & np.uint64(0xFFFF)).astype(np.int64)])
                    column = minima[:, k]
                    for w in near.tolist():
                        i = int(np.searchsorted(column, window[w]))
                        while i < len(column) and column[i] == window[w]:
                            out.setdefault(int(docs[whose[w]]), set()).add(int(members[i, k]))
                            i += 1
        return out

    def _signs(self, k: int, minima: np.ndarray) -> np.ndarray:
        """Which low 16 bits some minimum of band k has."""
        key = (k, id(minima))
        if key not in self.signs:
            self.signs[key] = np.zeros(1 << 16, bool)
            self.signs[key][(minima[:, k] & np.uint64(0xFFFF)).astype(np.int64)] = True
        return self.signs[key]

    def _known(self, size: int) -> np.ndarray:
        """Which low bits some shingle of a small item has."""
        key = (-1, size)
        if key not in self.signs:
            keys = self.exact[size][0]
            self.signs[key] = np.zeros(1 << max(16, (16 * len(keys)).bit_length()), bool)
            self.signs[key][(keys & np.uint64(len(self.signs[key]) - 1)).astype(np.int64)] = True
        return self.signs[key]

    def verify(self, words: list[str], candidates: set[int]) -> list[tuple[object, int, int]]:
        """(item, its shingles, those in the document) of the candidates that are contained."""
        shingles: dict[int, set[tuple[str, ...]]] = {}
        out = []
        for c in sorted(candidates):
            key, size, own = self.items[c]
            if size not in shingles:
                shingles[size] = _split(words, size)
            n = len(own & shingles[size])
            if n >= self.containment * len(own):
                out.append((key, len(own), n))
        return out


def _blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple[object, str]]]:
    """Bounded blocks of items: dealt by hash of their place (equal items too) into as many as BLOCK rows and
    BLOCK_BYTES need, written once, and fetched one at a time, each from its own folder."""
    own = items.select(F.col(key).alias("__key"), F.coalesce(F.col(text), F.lit("")).alias("__item"))
    n, size = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("__item")), F.lit(0))).first()
    blocks = max(parts_for(n, BLOCK), parts_for(size, BLOCK_BYTES))
    if blocks == 1:
        rows = [(r[0], r[1]) for r in own.collect()]
        if rows:
            yield rows
        return
    path = work_path(items.sparkSession, "items")
    own.withColumn("__block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(blocks, "__block").write.partitionBy("__block").parquet(path)
    written = items.sparkSession.read.schema(T.StructType([T.StructField("__key", items.schema[key].dataType), T.StructField("__item", T.StringType()), T.StructField("__block", T.IntegerType())])).parquet(path)
    for b in range(blocks):
        rows = [(r[0], r[1]) for r in written.where(F.col("__block") == b).select("__key", "__item").collect()]
        if rows:
            yield rows


def contained_items(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", containment: float = CONTAINMENT, hashes: int = HASHES) -> DataFrame:
    """doc_key, item_key, item_shingles, matched, containment: one row for each item that a document contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_key), F.col(text).alias("__text"))
    out_schema = T.StructType([T.StructField(doc_key, docs.schema[doc_key].dataType), T.StructField(item_key, items.schema[item_key].dataType), T.StructField("item_shingles", T.LongType()), T.StructField("matched", T.LongType()), T.StructField("containment", T.DoubleType())])
    found: DataFrame | None = None
    for block in _blocks(items, item_key, text):
        index = spark.sparkContext.broadcast(ItemIndex(block, hashes, containment))

        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            schema, search = to_arrow_schema(out_schema), index.value
            for batch in (s for b in batches for s in slices(b, "__text", 1 << 20)):
                hits: list[tuple] = []
                for i, near in search.candidates(*WORDS.of_texts(batch.column("__text"))).items():
                    key, words = batch.column(doc_key)[i].as_py(), batch.column("__text")[i].as_py().split()
                    hits += [(key, item, n, m, m / n) for item, n, m in search.verify(words, near)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*hits) if hits else [[]] * 5, schema)], schema=schema)
            give_back()

        part = rows.mapInArrow(run, out_schema)
        found = part if found is None else found.unionAll(part)
    return found if found is not None else spark.createDataFrame([], out_schema)


def clean_documents(docs: DataFrame, items: DataFrame, containment: float = CONTAINMENT) -> DataFrame:
    """The documents that contain no item, with their own columns."""
    leaks = contained_items(docs, items, containment=containment).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(leaks, F.col("doc_id").eqNullSafe(F.col("__leak")), "left_anti").select(*docs.columns)
