"""Images as row-major arrays of doubles: cleaning, scaling, rearranging, and bin geometry."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.scalar import col

# Brightness temperatures in kelvin.
BT_MIN, BT_MAX, COLD = 180.0, 310.0, 200.0
# Augmentation by class 0 to 5.
AUGMENT_P = (0.15, 0.20, 0.35, 0.60, 0.75, 0.85)
AUGMENT_SHIFT = (2, 2, 2, 2, 2, 2)
AUGMENT_BARS = (1, 1, 1, 2, 2, 3)


def _clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def normalize(bt: str | Column, low: float = BT_MIN, high: float = BT_MAX) -> Column:
    """To [-1, 1]; NaN and infinities become 0 K first, so they end at -1."""
    clean = lambda x: F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return F.transform(col(bt), lambda x: (_clip(clean(x.cast("double")), low, high) - low) / (high - low) * 2 - 1)


def denormalize(x: str | Column, low: float = BT_MIN, high: float = BT_MAX) -> Column:
    return F.transform(col(x), lambda v: (v.cast("double") + 1) / 2 * (high - low) + low)


def eval_clean(bt: str | Column, low: float = BT_MIN, high: float = BT_MAX) -> Column:
    """Clipped kelvin; NaN becomes the low end, infinities their own end."""
    return F.transform(col(bt), lambda x: F.when(F.isnan(x), F.lit(low)).otherwise(_clip(x.cast("double"), low, high)))


def held(f: Callable[..., Column], *values: str | Column) -> Column:
    """``f`` of values computed once a row. The optimizer moves what a column is made of into the lambda that reads it,
    where it would be computed again for every pixel."""
    row = F.struct(*(col(v).alias(f"v{k}") for k, v in enumerate(values)))
    return F.transform(F.array(row), lambda r: f(*(r[f"v{k}"] for k in range(len(values)))))[0]


def _turned(r: Column, c: Column, n: int, k: Column) -> Column:
    """Where the pixel at (r, c) of an image after ``k`` (0 to 3) quarter turns stood."""
    return F.when(k == 0, r * n + c).when(k == 1, c * n + (n - 1 - r)).when(k == 2, (n - 1 - r) * n + (n - 1 - c)).otherwise((n - 1 - c) * n + r)


def _mirror(i: Column, n: int) -> Column:
    return F.when(i < 0, -i).when(i >= n, 2 * (n - 1) - i).otherwise(i)


def turn_and_shift(x: str | Column, n: int, turns: str | Column, dy: str | Column, dx: str | Column) -> Column:
    """``rot90``, then ``shift_reflect``, each pixel fetched once; null if ``x`` is."""

    def moved(x: Column, k: Column, dy: Column, dx: Column) -> Column:
        def at(i: Column) -> Column:
            r, c = F.floor(i / n).cast("int"), (i % n).cast("int")
            return F.element_at(x, (_turned(_mirror(r + dy, n), _mirror(c + dx, n), n, k) + 1).cast("int"))

        return F.when(x.isNotNull(), F.transform(F.sequence(F.lit(0), F.lit(n * n - 1)), at))

    return held(moved, x, F.pmod(col(turns), F.lit(4)), dy, dx)


def rot90(x: str | Column, n: int, turns: str | Column) -> Column:
    """A square image turned counter-clockwise by quarter turns."""
    return turn_and_shift(x, n, turns, F.lit(0), F.lit(0))


def shift_reflect(x: str | Column, n: int, dy: str | Column, dx: str | Column) -> Column:
    """A square image moved by (dy, dx), its edges mirrored without repeating them."""
    return turn_and_shift(x, n, F.lit(0), dy, dx)


def erase_bar(x: str | Column, n: int, vertical: str | Column, start: str | Column, width: str | Column, fill: str | Column, by_pixel: bool = False) -> Column:
    """A full-length bar of ``width`` rows or columns replaced by ``fill``, a number or, ``by_pixel``, an array of
    the image's size (off by default in the augmentation)."""

    def erased(x: Column, vertical: Column, start: Column, end: Column, fill: Column) -> Column:
        def at(v: Column, i: Column) -> Column:
            place = F.when(vertical, (i % n).cast("int")).otherwise(F.floor(i / n).cast("int"))
            return F.when((place >= start) & (place < end), F.element_at(fill, i + 1) if by_pixel else fill).otherwise(v)

        return F.transform(x, at)

    return held(erased, x, vertical, start, col(start) + col(width), fill)


def augment_policy(spark: SparkSession, classes: int = 6) -> DataFrame:
    """ss_cat, p_aug, max_shift and max_bars; other class counts interpolate the six-class policy."""
    if classes <= 0:
        raise ValueError("classes must be positive")

    def along(values: tuple[float, ...], k: int) -> float:
        at = 0.0 if classes == 1 else k * (len(values) - 1) / (classes - 1)
        low = min(int(math.floor(at)), len(values) - 2)
        return values[low] + (values[low + 1] - values[low]) * (at - low)

    rows = [(k, float(along(AUGMENT_P, k)), round(along(AUGMENT_SHIFT, k)), round(along(AUGMENT_BARS, k))) for k in range(classes)]
    return spark.createDataFrame(rows, "ss_cat int, p_aug double, max_shift int, max_bars int")


def pixels(images: DataFrame, bt: str = "bt") -> DataFrame:
    """One row per pixel: the other columns, ``i`` (row-major place) and ``v``."""
    rest = [c for c in images.columns if c != bt]
    return images.select(*rest, F.posexplode(bt).alias("i", "v"))


def polar_bins(n: int, r_bins: int, theta_bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Ring and sector of each pixel of an n x n image about its centre."""
    y, x = (np.indices((n, n)) - (n - 1) / 2).reshape(2, -1)
    r_max = math.hypot((n - 1) / 2, (n - 1) / 2)
    part = lambda v, k: np.minimum(np.floor(v * k), k - 1).astype(np.int64)
    return part(np.sqrt(y * y + x * x) / (r_max + 1e-12), r_bins), part((np.arctan2(y, x) + math.pi) / (2 * math.pi), theta_bins)
