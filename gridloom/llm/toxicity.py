"""Toxicity scores from a factorization machine over hashed terms.

Terms of a text are its lower-cased words and their prefixes of four to seven letters (inflected forms
share them), each hashed to one of ``2**HASH_BITS`` numbers; a text is the set of its terms. The score is
``sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>)``: linear weights, and pairwise interactions of factors,
so that two terms that are toxic only together can be told from either alone.

The machine is fitted on the driver by AdaGrad on a bounded sample of labelled rows (``SAMPLE_ROWS``,
those of smallest hash of the document's id); terms enter where they are in ``LEAST_DF`` sampled texts
and differ between the labels (chi-squared of ``LEAST_CHI2``). So interactions are learned only among terms
that differ in themselves: one that tells the labels apart in combination alone (either/or, each in half the
texts of both labels) is left out. Scoring is one pass over all texts.

Edge cases: null or empty texts and texts without known terms get the bias alone; labels that are null
are left out; without labels every score is 0.25; repeated rows score alike; long texts are read whole; a
score of 0.5 exactly is label 1; an empty table gives no rows; only the columns named are read, so others may have any
name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import materialize, texts_of

HASH_BITS = 22
SAMPLE_ROWS = 20_000
LEAST_DF, LEAST_CHI2 = 4, 4.0
FACTORS, EPOCHS, BATCH, RATE, DECAY, SEED = 4, 12, 128, 0.1, 1e-4, 7
PREFIXES = (4, 5, 6, 7)

_WORD = re.compile(r"\w+")


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def terms_of(word: str) -> list[int]:
    import xxhash

    mask = (1 << HASH_BITS) - 1
    own = [xxhash.xxh64_intdigest(word) & mask]
    return own + [xxhash.xxh64_intdigest(f"{word[:n]}*") & mask for n in PREFIXES if len(word) >= n]


@dataclass
class Machine:
    """``terms`` (sorted hashes) with their weights and factors."""

    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margins(self, indices: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Of documents given as index lists, one after another, document i from offsets[i] to offsets[i + 1]."""
        n = len(offsets) - 1
        out = np.full(n, self.bias)
        full = np.flatnonzero(np.diff(offsets))
        if len(full):
            at = offsets[full]
            v = self.factors[indices]
            sums, squares = np.add.reduceat(v, at), np.add.reduceat(v * v, at)
            out[full] += np.add.reduceat(self.weights[indices], at) + 0.5 * (sums * sums - squares).sum(1)
        return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def prior(n: int, n1: int) -> float:
    """Log-odds of the smoothed rate; 0.25 without any rows."""
    return float(np.log((n1 + 0.5) / (n - n1 + 1.5)))


def fit(documents: list[np.ndarray], labels: np.ndarray, terms: np.ndarray, factors: int = FACTORS, epochs: int = EPOCHS, seed: int = SEED) -> Machine:
    """Fit on sets of term numbers (places in ``terms``) with 0/1 labels."""
    n, n1 = len(labels), int(labels.sum())
    bias = prior(n, n1)
    if not len(terms) or n1 in (0, n):
        return Machine(bias, terms[:0], np.empty(0), np.empty((0, factors)))
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in documents])]).astype(np.int64)
    own = np.concatenate(documents).astype(np.int64)
    rng = np.random.default_rng(seed)
    w, v = np.zeros(len(terms)), rng.normal(0, 0.01, (len(terms), factors))
    gw, gv, gb = np.full(len(terms), 1e-2), np.full((len(terms), factors), 1e-2), 1e-2
    m = Machine(bias, terms, w, v)
    for _ in range(epochs):
        order = rng.permutation(n)
        for s in range(0, n, BATCH):
            rows = order[s : s + BATCH]
            lengths = offsets[rows + 1] - offsets[rows]
            at = np.concatenate([[0], np.cumsum(lengths)])
            idx = own[np.repeat(offsets[rows] - at[:-1], lengths) + np.arange(at[-1])]
            error = sigmoid(m.margins(idx, at)) - labels[rows]
            grad = float(error.mean())
            gb += grad * grad
            m.bias -= RATE * grad / np.sqrt(gb)
            if not len(idx):
                continue
            per = np.repeat(error, lengths)
            full = np.flatnonzero(lengths)
            sums = np.zeros((len(rows), factors))
            sums[full] = np.add.reduceat(v[idx], at[full])
            dv = per[:, None] * (np.repeat(sums, lengths, axis=0) - v[idx])
            by = np.argsort(idx, kind="stable")
            cut = np.flatnonzero(np.diff(idx[by], prepend=-1))
            touched = idx[by][cut]
            tw = np.add.reduceat(per[by], cut) / len(rows) + DECAY * w[touched]
            tv = np.add.reduceat(dv[by], cut) / len(rows) + DECAY * v[touched]
            gw[touched] += tw * tw
            gv[touched] += tv * tv
            w[touched] -= RATE * tw / np.sqrt(gw[touched])
            v[touched] -= RATE * tv / np.sqrt(gv[touched])
    return m


class Scorer:
    """Scores texts; keeps the known terms of words in a bounded cache."""

    def __init__(self, machine: Machine, limit: int = 600_000):
        self.machine, self.limit = machine, limit
        self.place = {int(t): i for i, t in enumerate(machine.terms)}
        self.cache: dict[str, bytes] = {}

    def _known(self, word: str) -> bytes:
        return np.array([self.place[t] for t in terms_of(word) if t in self.place], np.int32).tobytes()

    def scores(self, texts: list[str]) -> np.ndarray:
        rows = []
        cache = self.cache
        for t in texts:
            words = words_of(t)
            if missing := [w for w in words if w not in cache]:
                if len(cache) > self.limit:
                    cache.clear()
                    missing = words
                cache.update((w, self._known(w)) for w in missing)
            rows.append(np.unique(np.frombuffer(b"".join(map(cache.__getitem__, words)), np.int32)))
        at = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return sigmoid(self.machine.margins(np.concatenate(rows) if rows else np.empty(0, np.int32), at))


def held_out(doc_id: str | Column) -> Column:
    """Rows whose labels are never learned from."""
    key = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """Texts of at most ``rows`` labelled documents that aren't held out: doc_id, text, label.

    The sampled ids are at most ``rows`` rows of two numbers, which bounds the broadcast.
    """
    known = labels.where(F.col(label).isNotNull() & ~held_out("doc_id")).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def _term_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [np.unique(np.array([x for w in words_of(t) for x in terms_of(w)], np.int32)) for t in texts_of(batch.column("text"))]
        at = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(sets) if sets else np.empty(0, np.int32), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("label"), lists], ["label", "terms"])


def select_terms(sample: DataFrame, n: int, n1: int) -> np.ndarray:
    """The sorted terms that tell the labels apart, counted on the executors."""
    counts = sample.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("label").alias("a"))
    d = lambda c: F.col(c).cast("double")
    gap = d("a") * (n - n1 - (d("df") - d("a"))) - (d("df") - d("a")) * (n1 - d("a"))
    chi2 = F.lit(float(n)) * gap * gap / F.greatest(F.lit(1.0), d("df") * (n - d("df")) * float(n1) * float(n - n1))
    kept = counts.where((F.col("df") >= LEAST_DF) & (chi2 >= LEAST_CHI2)).select("term").toArrow()
    return np.sort(kept.column("term").to_numpy())


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Machine:
    """Terms are hashed, counted and chosen on the executors; the driver gets the chosen terms (at most
    2 ** HASH_BITS numbers) of at most ``rows`` documents."""
    sample = materialize(labelled_sample(docs, labels, label, rows).select("label", "text").mapInArrow(_term_batches, "label int, terms array<int>"), "terms")
    n, n1 = sample.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    terms = select_terms(sample, n, n1) if n1 not in (0, n) else np.empty(0, np.int32)
    known = docs.sparkSession.sparkContext.broadcast(terms)

    def numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = known.value
        for batch in batches:
            lists = batch.column("terms")
            flat, at = np.asarray(lists.values), np.asarray(lists.offsets).astype(np.int64)
            place = np.minimum(np.searchsorted(chosen, flat), max(len(chosen) - 1, 0))
            hit = chosen[place] == flat if len(chosen) else np.zeros(len(flat), bool)
            counts = np.concatenate([[0], np.cumsum(hit)])[at].astype(np.int32)
            own = place[at[0] : at[-1]][hit[at[0] : at[-1]]].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(counts - counts[0]), pa.array(own))], ["label", "terms"])

    got = sample.mapInArrow(numbers, "label int, terms array<int>").toArrow()
    y, sets = got.column("label").to_numpy(), []
    for lists in got.column("terms").chunks:
        flat, at = np.asarray(lists.values), np.asarray(lists.offsets)
        sets += [flat[a:b] for a, b in zip(at[:-1], at[1:])]
    order = sorted(range(len(sets)), key=lambda i: (int(y[i]), len(sets[i]), sets[i].tobytes()))  # arrival order must not matter
    return fit([sets[i] for i in order], y[order].astype(float), terms)


def score_documents(docs: DataFrame, machine: Machine, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key and score (0 to 1) of every row."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(scorer.scores(texts_of(part.column(text))), pa.float64())], [key, "score"])

    from pyspark.sql import types as T

    rows = docs.select(F.col(key), F.col(text))
    return rows.mapInArrow(run, T.StructType([rows.schema[key], T.StructField("score", T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train and score: doc_id, held_out, score, predicted."""
    scored = score_documents(docs, train(docs, labels, label, rows))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
