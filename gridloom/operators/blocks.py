"""The network's residual and attention blocks on images that are one row each: nothing is exploded or shuffled.

An image is an array of height x width x channels numbers, row-major with channels last. A block maps an image to an
image and needs no other row, so it runs over Arrow batches in the task that holds the row. Weights are a network's, of
a fixed size, and travel with the task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from gridloom.operators.layers import norm_groups


@dataclass(frozen=True)
class Norm:
    """Scale and shift of each channel."""

    scale: np.ndarray
    shift: np.ndarray


@dataclass(frozen=True)
class ResWeights:
    """conv1 (3, 3, in, out), conv2 (3, 3, out, out), film (embedding, 4 out), skip (in, out) or None, and their biases."""

    conv1: np.ndarray
    bias1: np.ndarray
    norm1: Norm
    conv2: np.ndarray
    bias2: np.ndarray
    norm2: Norm
    film: np.ndarray
    film_bias: np.ndarray
    skip: np.ndarray | None = None
    skip_bias: np.ndarray | None = None


@dataclass(frozen=True)
class AttentionWeights:
    """query, key and value (channels, heads, width), out (heads, width, channels), their biases, and the norm before."""

    norm: Norm
    query: np.ndarray
    query_bias: np.ndarray
    key: np.ndarray
    key_bias: np.ndarray
    value: np.ndarray
    value_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray


def group_norm(x: np.ndarray, norm: Norm, most: int = 32, eps: float = 1e-5) -> np.ndarray:
    """x (height, width, channels) at mean 0 and variance 1 within groups of channels, scaled and shifted by channel."""
    h, w, c = x.shape
    g = norm_groups(c, most)
    grouped = x.reshape(h, w, g, c // g)
    mean = grouped.mean((0, 1, 3), keepdims=True)
    return ((grouped - mean) / np.sqrt(grouped.var((0, 1, 3), keepdims=True) + eps)).reshape(h, w, c) * norm.scale + norm.shift


def conv(x: np.ndarray, kernel: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """3 x 3 with zeros beyond the edges: nine moved copies of the image, each times its matrix (in, out)."""
    h, w, _ = x.shape
    padded = np.pad(x, ((1, 1), (1, 1), (0, 0)))
    return sum(padded[dy : dy + h, dx : dx + w] @ kernel[dy, dx] for dy in range(3) for dx in range(3)) + bias


def swish(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def res_block_of(x: np.ndarray, emb: np.ndarray, w: ResWeights, most: int = 32) -> np.ndarray:
    gamma1, beta1, gamma2, beta2 = np.split(emb @ w.film + w.film_bias, 4)
    h = swish(group_norm(conv(x, w.conv1, w.bias1), w.norm1, most) * (1 + gamma1) + beta1)
    h = swish(group_norm(conv(h, w.conv2, w.bias2), w.norm2, most) * (1 + gamma2) + beta2)
    return (x if w.skip is None else x @ w.skip + w.skip_bias) + h


def attended(q: np.ndarray, k: np.ndarray, v: np.ndarray, block: int) -> np.ndarray:
    """softmax(q k' / sqrt(width)) v of one head, a block of keys at a time: a running maximum, sum and value of every
    query are rescaled as the maximum grows, so tokens x block scores are held and never tokens x tokens."""
    top, total, out = np.full(len(q), -np.inf), np.zeros(len(q)), np.zeros((len(q), v.shape[1]))
    for at in range(0, len(k), block):
        scores = q @ k[at : at + block].T / math.sqrt(q.shape[1])
        higher = np.maximum(top, scores.max(1))
        weights, keep = np.exp(scores - higher[:, None]), np.exp(top - higher)
        total, out, top = total * keep + weights.sum(1), out * keep[:, None] + weights @ v[at : at + block], higher
    return out / total[:, None]


def attention_block_of(x: np.ndarray, w: AttentionWeights, most: int = 32, block: int = 256) -> np.ndarray:
    h, width, c = x.shape
    tokens = group_norm(x, w.norm, most).reshape(h * width, c)
    heads = []
    for i in range(w.query.shape[1]):
        q, k, v = (tokens @ m[:, i] + b[i] for m, b in ((w.query, w.query_bias), (w.key, w.key_bias), (w.value, w.value_bias)))
        heads.append(attended(q, k, v, block) @ w.out[i])
    return x + (sum(heads) + w.out_bias).reshape(x.shape)


def _mapped(rows: DataFrame, out: str, arrays: list[str], run: Callable[..., np.ndarray]) -> DataFrame:
    """The rows with ``out``, an array made of theirs; null where one of them is null."""
    names = [c for c in rows.columns if c != out]
    schema = T.StructType([rows.schema[c] for c in names] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for values in zip(*(batch.column(a) for a in arrays)):
                whole = all(v.is_valid for v in values)
                made.append(run(*(np.asarray(v.values, float) for v in values)).ravel() if whole else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(made, pa.list_(pa.float64()))], [*names, out])

    columns = list(dict.fromkeys([*names, *arrays]))
    return rows.select(*columns).mapInArrow(over, schema)


def res_block(rows: DataFrame, x: str, emb: str, shape: tuple[int, int, int], weights: ResWeights, out: str = "y", most: int = 32) -> DataFrame:
    """Convolution, norm, FiLM from the embedding ``emb`` and swish, twice, and the image itself added (through a 1 x 1
    convolution where channels change)."""
    if shape[2] != weights.conv1.shape[3] and weights.skip is None:
        raise ValueError("a change of channels needs a skip convolution")
    return _mapped(rows, out, [x, emb], lambda a, e: res_block_of(a.reshape(shape), e, weights, most))


def attention_block(rows: DataFrame, x: str, shape: tuple[int, int, int], weights: AttentionWeights, out: str = "y", most: int = 32, block: int = 256) -> DataFrame:
    """Norm, self-attention of the pixels with several heads, and the image itself added."""
    if block <= 0:
        raise ValueError("block must be positive")
    return _mapped(rows, out, [x], lambda a: attention_block_of(a.reshape(shape), weights, most, block))


def norm_block(rows: DataFrame, x: str, shape: tuple[int, int, int], norm: Norm, out: str = "y", most: int = 32, eps: float = 1e-5) -> DataFrame:
    return _mapped(rows, out, [x], lambda a: group_norm(a.reshape(shape), norm, most, eps))
