"""Numbers: softmax, sigmoid, vectors, rounding, retry delays, boxes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Statuses that a request is repeated for.
RETRYABLE_STATUSES = (408, 409, 429, 500, 502, 503, 504)
JUDGE_RETRYABLE_STATUSES = (408, 429, 500, 502, 503, 504)


def softmax(x: Column) -> Column:
    """Of an array of doubles, shifted by its greatest element."""
    e = F.transform(x, lambda v: F.exp(v - F.array_max(x)))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def top_probability(x: Column) -> Column:
    """The greatest softmax value, without building the others."""
    return F.lit(1.0) / F.aggregate(x, F.lit(0.0), lambda a, v: a + F.exp(v - F.array_max(x)))


def sigmoid(x: Column) -> Column:
    """Branched by sign so that neither side overflows."""
    return F.when(x >= 0, 1 / (1 + F.exp(-x))).otherwise(F.exp(x) / (1 + F.exp(x)))


def first_argmax(x: Column) -> Column:
    """0-based place of the greatest element; the first of equal ones."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def all_finite(x: Column) -> Column:
    return ~F.exists(x, lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | v.isNull())


def dot(a: Column, b: Column) -> Column:
    """In double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def is_unit(a: Column, tolerance: float = 1e-3) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def clamp01(x: Column) -> Column:
    """Null stays null, which greatest and least alone would skip."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


def weighted_confidence(parts: list[Column], weights: tuple[float, ...] = (0.4, 0.3, 0.3)) -> Column:
    """Weighted sum of clamped scores; null if one is missing."""
    return sum((clamp01(p) * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0))


def retry_delay(attempt: Column, retry_after: Column) -> Column:
    """The server's wish within 0..30 s, else half a second doubled each time, 8 s at most."""
    asked = retry_after.try_cast("double")
    wish = F.when(asked.isNotNull(), F.least(F.greatest(asked, F.lit(0.0)), F.lit(30.0)))
    return F.coalesce(wish, F.least(F.lit(8.0), F.pow(F.lit(2.0), attempt) * 0.5))


def judge_delay(retry: Column) -> Column:
    """Doubled each time up to 16 s, with up to half a second at random."""
    return F.least(F.pow(F.lit(2.0), retry), F.lit(16.0)) + F.rand() * 0.5


def is_retryable(status: Column, judge: bool = False) -> Column:
    return status.isin(*(JUDGE_RETRYABLE_STATUSES if judge else RETRYABLE_STATUSES))


def token_is_valid(now: Column, expires: Column, skew: float = 60.0) -> Column:
    return now < expires - skew


def box_crop(left: Column, top: Column, right: Column, bottom: Column, width: Column, height: Column) -> Column:
    """Pixel box, grown outward; fractions of the size if all four lie in 0..1; null if empty or out of range."""
    four = (left, top, right, bottom)
    unit = left.between(0, 1) & top.between(0, 1) & right.between(0, 1) & bottom.between(0, 1)
    l, r = (F.when(unit, v * width).otherwise(v) for v in (left, right))
    t, b = (F.when(unit, v * height).otherwise(v) for v in (top, bottom))
    x0 = F.greatest(F.lit(0), F.least(width - 1, F.floor(l))).cast("int")
    y0 = F.greatest(F.lit(0), F.least(height - 1, F.floor(t))).cast("int")
    x1 = F.greatest(x0 + 1, F.least(width, F.ceil(r))).cast("int")
    y1 = F.greatest(y0 + 1, F.least(height, F.ceil(b))).cast("int")
    finite = F.lit(True)
    for v in four:
        finite = finite & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(finite & (right > left) & (bottom > top), F.struct(x0.alias("left"), y0.alias("top"), x1.alias("right"), y1.alias("bottom")))


def half_even(x: Column, digits: int) -> Column:
    """Rounded half to even by the number's exact binary value, as Python rounds.

    SQL rounds the shortest decimal text instead: 2.675 would give 2.68 for 2.67.
    """

    @F.pandas_udf(T.DoubleType())
    def rounded(v: pd.Series) -> pd.Series:
        return v.map(lambda a: None if a is None or a != a else round(a, digits))

    return rounded(x.cast("double"))


def elapsed_ms(begun: Column, ended: Column) -> Column:
    """Milliseconds between two timestamps, two places."""
    return F.round((F.unix_micros(ended) - F.unix_micros(begun)) / 1000, 2)


def utc_text(ts: Column) -> Column:
    """A timestamp as ISO text in UTC, whole seconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
