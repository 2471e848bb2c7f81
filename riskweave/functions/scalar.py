"""Column functions with no state: arithmetic guards and memo-text measures."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from riskweave.schema import URL_PATTERN

_INF = float("inf")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(numerator, denominator) -> Column:
    """``n / d``, or 0.0 where ``d`` is zero (ANSI mode would raise)."""
    n, d = _col(numerator), _col(denominator)
    return F.when(d == 0, F.lit(0.0)).otherwise(n / d)


def nan_to_null(c) -> Column:
    c = _col(c)
    return F.when(~F.isnan(c), c)


def finite_or_zero(c) -> Column:
    """NULL, NaN and the infinities become 0.0."""
    c = _col(c)
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == _INF), F.lit(0.0)).otherwise(c)


def clip(c, low=None, high=None) -> Column:
    c = _col(c)
    if low is not None:
        c = F.greatest(c, F.lit(low))
    if high is not None:
        c = F.least(c, F.lit(high))
    return c


def duration_us(text: str) -> int:
    """A duration such as ``'5 minutes'`` in microseconds."""
    us = int(pd.Timedelta(text).value // 1000)
    if us <= 0:
        raise ValueError(f"window must be positive, got {text!r}")
    return us


def shannon_entropy(text) -> Column:
    """Bits per character of a string; the empty string (or NULL) has 0.

    The characters are sorted and joined again, so that each run of equal ones
    is one regular-expression match and its length is the character's count:
    O(n log n) in the text length, whatever the alphabet.
    """
    t = _col(text)
    n = F.char_length(t).cast("double")
    runs = F.regexp_extract_all(
        F.array_join(F.sort_array(F.split(t, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0)
    )
    counts = F.transform(runs, lambda r: F.char_length(r).cast("double"))
    # One repeated character has no information; rounding must not say otherwise.
    bits = F.aggregate(
        counts,
        F.lit(0.0),
        lambda total, c: total + c * F.log2(c),
        lambda total: F.when(total > n * F.log2(n) - 1e-9, F.lit(0.0)).otherwise(
            F.log2(n) - total / n
        ),
    )
    return F.when(t == "", F.lit(0.0)).otherwise(F.coalesce(bits, F.lit(0.0)))


def contains_url(text) -> Column:
    return F.coalesce(_col(text).rlike(URL_PATTERN), F.lit(False)).cast("int")
