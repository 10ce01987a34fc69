"""Column functions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_logit(p: Column, clip: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(clip)), F.lit(1 - clip))
    return F.ln(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def platt(p: Column, intercept: Column | float, slope: Column | float, clip: float = 1e-6) -> Column:
    a, b = (c if isinstance(c, Column) else F.lit(float(c)) for c in (intercept, slope))
    return sigmoid(a + b * clipped_logit(p, clip))


def blend(a: Column, b: Column, weight: Column | float) -> Column:
    w = weight if isinstance(weight, Column) else F.lit(float(weight))
    return w * a + (1 - w) * b


def missing(c: Column) -> Column:
    """Null and NaN both mean missing."""
    return c.isNull() | F.isnan(c)


def padded(rows: Column, length: int, filler: Column) -> Column:
    """Right-padded to length."""
    return F.concat(rows, F.array_repeat(filler, F.greatest(F.lit(0), F.lit(length) - F.size(rows))))


def padding_mask(size: Column, length: int) -> Column:
    """0 for what is real, 1 for padding."""
    return F.transform(F.sequence(F.lit(1), F.lit(length)), lambda k: (k > size).cast("int"))


def standardized(x: Column, mean: Column, deviation: Column) -> Column:
    """Element by element; what isn't finite becomes 0."""
    z = F.zip_with(x, F.zip_with(mean, deviation, lambda m, s: F.struct(m.alias("m"), s.alias("s"))), lambda v, t: (v - t["m"]) / t["s"])
    return F.transform(z, lambda v: F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), F.lit(0.0)).otherwise(v))


def top_k(values: Column, names: Sequence[str], k: int) -> Column:
    """The k entries with the largest absolute values, the earlier first among equals."""
    listed = F.array(*[F.lit(n) for n in names])
    entries = F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("order"), i.alias("index"), F.element_at(listed, i + 1).alias("name"), v.alias("value")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))


def stay_number(time: Column) -> Column:
    """An id from a UTC time to milliseconds, as digits of date and time."""
    return F.date_format(time, "yyyyMMddHHmmssSSS").cast("long")


def composite_key(stay: Column, window: Column) -> Column:
    """stay and window in one number; null where the window is out of range."""
    return F.when(window.between(0, 999_999), stay * 1_000_000 + window)


def content_hash(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
