"""Column expressions: wind classes, storm bins, conditioning features, embeddings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Closed wind bands in knots, class midpoints, wind range.
WIND_BANDS = ((35, 63), (64, 82), (83, 95), (96, 112), (113, 136))
MIDPOINTS = (49.0, 73.0, 89.0, 104.0, 124.5)
LAST_MIDPOINT = 145.0
WIND_MIN, WIND_MAX, WIND_NULL = 35.0, 170.0, 0.0
NULL_LABEL = 6


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: str | Column) -> Column:
    """True for numbers, false for null, NaN and infinities."""
    c = col(c)
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def ss_category(wind: str | Column) -> Column:
    """Class 0 to 5 of closed bands; null in the gaps between them, below, for NaN and for null."""
    wind = col(wind).cast("double")
    out = F.when(wind.isNull() | F.isnan(wind), F.lit(None).cast("int"))
    for k, (low, high) in enumerate(WIND_BANDS):
        out = out.when(wind.between(low, high), F.lit(k))
    return out.when(wind > WIND_BANDS[-1][1], F.lit(len(WIND_BANDS)))


def midpoint(ss_cat: str | Column) -> Column:
    """Representative wind of a class; any other number has that of the last class."""
    ss_cat = col(ss_cat)
    out = F.when(ss_cat == 0, MIDPOINTS[0])
    for k, v in enumerate(MIDPOINTS[1:], 1):
        out = out.when(ss_cat == k, v)
    return out.otherwise(LAST_MIDPOINT)


def midpoint_general(label: str | Column, classes: int = 6, wind_min: float = WIND_MIN, wind_max: float = WIND_MAX) -> Column:
    """Wind of a conditioning label: a table for six classes (clipped), equal widths otherwise; the null label has none."""
    label = col(label)
    at = F.least(F.greatest(label, F.lit(0)), F.lit(classes - 1))
    own = midpoint(at) if classes == 6 else F.lit(wind_min) + (at.cast("double") + 0.5) * ((wind_max - wind_min) / classes)
    return F.when(label == classes, F.lit(WIND_NULL)).otherwise(own)


def season(month: str | Column) -> Column:
    m = col(month)
    return F.when(m.isin(12, 1, 2), "DJF").when(m.isin(3, 4, 5), "MAM").when(m.isin(6, 7, 8), "JJA").otherwise("SON")


def lat_bin(lat: str | Column) -> Column:
    a = F.abs(col(lat))
    return F.when(a < 10, "lat0_10").when(a < 20, "lat10_20").when(a < 30, "lat20_30").otherwise("lat30p")


def dur_bin(n: str | Column) -> Column:
    n = col(n)
    return F.when(n <= 4, "n1_4").when(n <= 12, "n5_12").when(n <= 30, "n13_30").otherwise("n31p")


def stratum(basin: str | Column, ss: str | Column, season_: str | Column, lat: str | Column, dur: str | Column) -> Column:
    return F.concat_ws("|", F.coalesce(col(basin).cast("string"), F.lit("nan")), F.concat(F.lit("ss"), col(ss).cast("string")), col(season_), col(lat), col(dur))


def index_prefix(path: str | Column) -> Column:
    """The number before the first hyphen of a file's name, or null."""
    name = F.substring_index(col(path), "/", -1)
    return F.substring_index(name, "-", 1).try_cast("bigint")


def relative_path(path: str | Column, root: str) -> Column:
    """The path below ``root``, without a scheme."""
    bare = F.regexp_replace(col(path), r"^[a-zA-Z][a-zA-Z0-9+.-]*:/{0,2}(?=/)", "")
    prefix = root.split("://")[-1].rstrip("/") + "/"
    return F.when(F.startswith(bare, F.lit(prefix)), F.substring(bare, len(prefix) + 1, 1 << 30)).otherwise(bare)


def label_clip(label: str | Column, classes: int = 6) -> Column:
    label = col(label)
    return F.when(label == classes, label).otherwise(F.least(F.greatest(label, F.lit(0)), F.lit(classes - 1)))


def wind_clip(wind: str | Column) -> Column:
    wind = col(wind)
    return F.when(wind == WIND_NULL, wind).otherwise(F.least(F.greatest(wind, F.lit(WIND_MIN)), F.lit(WIND_MAX)))


def wind_scaled(wind: str | Column) -> Column:
    """-1 to 1 over the wind range; -2 for the null wind."""
    wind = col(wind)
    scaled = (wind - WIND_MIN) / (WIND_MAX - WIND_MIN) * 2 - 1
    return F.when(wind == WIND_NULL, F.lit(-2.0)).otherwise(F.least(F.greatest(scaled, F.lit(-1.0)), F.lit(1.0)))


def wind_fourier(scaled: str | Column) -> Column:
    w = col(scaled)
    return F.array(w, F.sin(w * math.pi), F.cos(w * math.pi), F.sin(w * (2 * math.pi)), F.cos(w * (2 * math.pi)))


def time_embedding(t: str | Column, dim: int) -> Column:
    """Sines, then cosines, of t at half as many geometric frequencies; a zero closes an odd width."""
    half, t = dim // 2, col(t).cast("double")
    frequencies = [math.exp(-math.log(10000.0) * i / max(half - 1, 1)) for i in range(half)]
    parts = [F.sin(t * f) for f in frequencies] + [F.cos(t * f) for f in frequencies]
    return F.array(*parts, *([F.lit(0.0)] if dim % 2 else []))


def wind_target(targets: str | Column, ss_cat: str | Column) -> Column:
    """A configured wind (map of class string to text), or the midpoint where it is absent or no number."""
    return F.coalesce(F.try_element_at(col(targets), col(ss_cat).cast("string")).try_cast("double"), midpoint(ss_cat))


def seeded(seed: int | str, *keys: str | Column) -> Column:
    """md5 of seed and keys: a shuffle order that every engine repeats."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(col(k).cast("string") for k in keys)).cast("binary"))


def uniform(digest: Column, start: int = 1) -> Column:
    """A number in [0, 1) from eight hexadecimal digits of a digest."""
    return F.conv(F.substring(digest, start, 8), 16, 10).cast("double") / 4294967296.0


def round6(c: str | Column, digits: int = 6) -> Column:
    """Rounded, without negative zero."""
    return F.round(col(c), digits) + F.lit(0.0)
