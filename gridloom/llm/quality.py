"""A quality classifier by hierarchical empirical Bayes.

Three kinds of evidence are combined for each document:

1. A document classifier: logistic regression on style features of the text (shares of byte classes,
   word statistics, repetition), fitted by Newton steps on a bounded sample of labelled rows.
2. The host (``source``): the expected share of good documents over all of its documents.
3. The path under the host (here ``lang``, the one further level the table has).

A level's posterior is a Beta posterior whose prior is its parent's posterior with a strength estimated by
the method of moments from all groups of the level, so that sparse sites shrink toward their parent and
sparse hosts toward the global rate. A document's own evidence is left out of its groups' posteriors. The
final log-odds are the classifier's plus the path posterior's log-odds less the global ones, bounded by
``SITE_WEIGHT``: a site's record tips doubtful documents and doesn't overrule a clear text.

Groups are pre-aggregated before any shuffle; the table of groups is broadcast only below ``GROUP_LIMIT``
groups and joined in salted copies above it.

Edge cases: null and empty texts are rated as empty; null hosts and paths form groups of their own;
labels that are null are left out, and without labels of both kinds the classifier says the prior rate
(0.5 if there are none); an empty table gives no rows; further columns are kept out of the result, whatever
their names. Very long texts are read whole; repeated rows count as often as they are there, and are rated alike; a
rating equal to the threshold is accepted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import give_back, materialize, texts_of

SAMPLE_ROWS = 20_000
RIDGE, STEPS = 1.0, 25
SITE_WEIGHT = 1.0
GROUP_LIMIT, SALTS = 200_000, 64
THRESHOLD = 0.5

_SYMBOLS = (b"!?", b"#$%&*", b"|<>{}[]", b".,;:", b"0123456789", b" \t", b"\n", b"@/\\_=+~^-")


def _classes() -> np.ndarray:
    out = np.zeros((256, len(_SYMBOLS) + 3))
    for k, group in enumerate(_SYMBOLS):
        out[list(group), k] = 1
    out[65:91, -3] = 1
    out[0x80:0x9F, -3] = 0.5  # second bytes of accented capitals
    out[97:123, -2] = 1
    out[0xA0:0xC0, -2] = 0.5
    out[0:9, -1] = out[14:32, -1] = out[0xC0:, -1] = 1
    return out


_CLASSES = _classes()
FEATURES = _CLASSES.shape[1] + 10


def features(text: str) -> np.ndarray:
    """Style features of the whole text."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(data))
    shares = np.bincount(data, minlength=256) @ _CLASSES / n
    words = text.split()
    k = max(1, len(words))
    distinct = len(set(words))
    lines = text.split("\n")
    bigrams = len(set(zip(words, words[1:])))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    more = [
        np.log1p(len(words)) / 5, distinct / k, bigrams / k, len(set(lines)) / len(lines), float(sizes.mean()) / 5 if len(words) else 0.0, float(sizes.max()) / 20 if len(words) else 0.0,
        sum(map(str.isupper, words)) / k, sum(map(str.isalpha, words)) / k, shares[-3] / (shares[-2] + shares[-3] + 1e-3), len(words) == 0,
    ]
    return np.concatenate([shares, np.array(more, float)])


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def margins(self, x: np.ndarray) -> np.ndarray:
        return expand((x - self.mean) / self.scale) @ self.weights + self.bias


def expand(z: np.ndarray) -> np.ndarray:
    """Standard scores, bounded, with their squares: too little and too much can both be bad."""
    z = np.clip(z, -6, 6)
    return np.concatenate([z, z * z / 6], axis=1)


def fit(x: np.ndarray, y: np.ndarray) -> Logistic:
    """Ridge logistic regression by Newton's method."""
    n, n1 = len(y), float(y.sum())
    width = FEATURES
    if not n or n1 in (0, n):
        return Logistic(np.zeros(width), np.ones(width), np.zeros(2 * width), float(np.log((n1 + 0.5) / (n - n1 + 0.5))))
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([expand((x - mean) / scale), np.ones(n)])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], RIDGE)
    ridge[-1] = 1e-6
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-9)[:, None]).T @ z + np.diag(ridge), z.T @ (p - y) + ridge * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Logistic(mean, scale, w[:-1], float(w[-1]))


def _feature_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = np.array([features(t) for t in texts_of(batch.column("text"))]).reshape(batch.num_rows, FEATURES)
        at = np.arange(batch.num_rows + 1, dtype=np.int32) * FEATURES
        yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(at), pa.array(rows.ravel()))], ["label", "x"])


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Logistic:
    """On at most ``rows`` labelled documents, those of smallest hash of their id; the driver gets their features only."""
    known = labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text").mapInArrow(_feature_batches, "label int, x array<double>").toArrow()
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, FEATURES)
    y = got.column("label").to_numpy().astype(float)
    order = np.lexsort([*x.T, y])  # arrival order must not matter
    return fit(x[order], y[order])


def classify_texts(docs: DataFrame, model: Logistic, keep: list[str]) -> DataFrame:
    """``keep`` and the classifier's log-odds ``evidence`` of every row; texts don't travel further."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("__text"))
    schema = T.StructType([rows.schema[c] for c in keep] + [T.StructField("evidence", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                x = np.array([features(t) for t in texts_of(part.column("__text"))])
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(np.clip(shared.value.margins(x), -30, 30))], [*keep, "evidence"])
        give_back()

    return rows.mapInArrow(run, schema)


def _strength(groups: DataFrame, rate: float) -> float:
    """Prior strength by moments: the spread of groups' shares beyond what their sizes explain."""
    spread = groups.where("n >= 2").agg(F.sum(F.col("n") * (F.col("good") / F.col("n") - F.lit(rate)) ** 2), F.sum("n"), F.count(F.lit(1))).first()
    between, n, k = (float(v or 0) for v in spread)
    if k < 2 or not n:
        return 100.0
    noise = rate * (1 - rate)
    excess = max(between - k * noise, 0.0) / n
    return float(np.clip(noise / excess - 1, 1.0, 1000.0)) if excess > 0 else 1000.0


def site_posteriors(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float, float]:
    """Per (host, path): the counts of both levels. Then the global rate and both prior strengths."""
    p = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))
    paths = scored.groupBy(host, path).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(p).alias("good"))
    paths = materialize(paths, "quality-sites")
    hosts = paths.groupBy(F.col(host).alias("__host")).agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"))
    n, good = paths.agg(F.sum("n"), F.sum("good")).first()
    rate = float(np.clip((good + 0.5) / (n + 1), 1e-3, 1 - 1e-3)) if n else 0.5
    k_host = _strength(hosts.select(F.col("host_n").alias("n"), F.col("host_good").alias("good")), rate)
    k_path = _strength(paths, rate)
    both = paths.join(hosts, F.col(host).eqNullSafe(F.col("__host"))).select(F.col(host).alias("__h"), F.col(path).alias("__p"), F.col("n").alias("path_n"), F.col("good").alias("path_good"), "host_n", "host_good")
    return both, rate, k_host, k_path


def rate_documents(docs: DataFrame, model: Logistic, host: str = "source", path: str = "lang", key: str = "doc_id", threshold: float = THRESHOLD) -> DataFrame:
    """key, host, path, evidence, host_posterior, path_posterior, quality (probability) and predicted."""
    scored = materialize(classify_texts(docs, model, [key, host, path]), "quality-evidence")
    sites, rate, k_host, k_path = site_posteriors(scored, host, path)
    same = F.col(host).eqNullSafe(F.col("__h")) & F.col(path).eqNullSafe(F.col("__p"))
    if sites.limit(GROUP_LIMIT + 1).count() <= GROUP_LIMIT:
        joined = scored.join(F.broadcast(sites), same)
    else:
        salted = scored.withColumn("__salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        copies = sites.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = salted.join(copies, same & (F.col("__salt") == F.col("__copy")))
    own = F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col("evidence")))
    logit = lambda p: F.ln(p / (F.lit(1.0) - p))
    host_post = (F.col("host_good") - own + F.lit(k_host * rate)) / (F.col("host_n") - 1 + F.lit(k_host))
    path_post = (F.col("path_good") - own + F.lit(k_path) * F.col("host_posterior")) / (F.col("path_n") - 1 + F.lit(k_path))
    bounded = lambda c: F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), c))
    shift = F.greatest(F.lit(-SITE_WEIGHT), F.least(F.lit(SITE_WEIGHT), logit(F.col("path_posterior")) - F.lit(float(np.log(rate / (1 - rate))))))
    out = joined.withColumn("host_posterior", bounded(host_post)).withColumn("path_posterior", bounded(path_post))
    out = out.withColumn("quality", F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.col("evidence") + shift))))
    return out.select(key, host, path, "evidence", "host_posterior", "path_posterior", "quality", (F.col("quality") >= threshold).cast("int").alias("predicted"))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> DataFrame:
    """Train on the labels and rate every document."""
    return rate_documents(docs, train(docs, labels, label, rows))


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are rated good, with their own columns (rows that share a doc_id: if any of them is)."""
    good = quality(docs, labels).where("predicted = 1").select(F.col("doc_id").alias("__good")).distinct()
    return docs.join(good, F.col("doc_id").eqNullSafe(F.col("__good")), "left_semi").select(*docs.columns)
