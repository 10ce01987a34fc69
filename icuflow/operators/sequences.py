"""Histories of windows as padded tensors: row-based, so gaps between windows are not filled."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.functions.scalars import missing, padded, padding_mask
from icuflow.operators.quantiles import exact_quantiles


def train_medians(df: DataFrame, columns: Sequence[str], exact: bool = False, accuracy: int = 1000) -> DataFrame:
    """One row: each column's median, missing values left out, of all columns together; null for a column without values."""
    clean = [F.when(~missing(F.col(c)), F.col(c)).alias(c) for c in columns]
    if not exact:
        return df.select(*clean).agg(*[F.percentile_approx(c, 0.5, accuracy).alias(c) for c in columns])
    found = exact_quantiles(df.select(*clean), columns, [0.5])
    return found.agg(*[F.max(F.when(F.col("column_name") == c, F.col("q")[0])).alias(c) for c in columns])


def imputed(df: DataFrame, medians: DataFrame, columns: Sequence[str]) -> DataFrame:
    """temporal: values with medians where missing; missing_mask: 1 there. medians is one row, so the join is a broadcast of it."""
    m = F.broadcast(medians.select(*[F.col(c).alias(f"{c}__median") for c in columns]))
    x = df.join(m, F.lit(True))
    values = F.array(*[F.when(missing(F.col(c)), F.col(f"{c}__median")).otherwise(F.col(c)).cast("double") for c in columns])
    mask = F.array(*[missing(F.col(c)).cast("int") for c in columns])
    return x.select(*df.columns, values.alias("temporal_row"), mask.alias("mask_row"))


def histories(df: DataFrame, length: int) -> DataFrame:
    """position and n_windows in the stay, and the last length rows up to each window as an array of structs."""
    order = Window.partitionBy("stay_id").orderBy("window_id")
    return df.select(
        "*",
        F.row_number().over(order).alias("position"),
        F.count("*").over(Window.partitionBy("stay_id")).alias("n_windows"),
        F.collect_list(F.struct("window_id", "temporal_row", "mask_row")).over(order.rowsBetween(1 - length, 0)).alias("history"),
    )


def tensors(df: DataFrame, length: int, width: int) -> DataFrame:
    """temporal and missing_mask padded to length, padding_mask and sequence_length, for rows with a history."""
    n = F.size("history")
    zeros, none = (F.array_repeat(F.lit(z), width) for z in (0.0, 0))
    return df.select(
        "stay_id",
        F.col("window_id").alias("terminal_window_id"),
        n.alias("sequence_length"),
        padded(F.col("history.temporal_row"), length, zeros).alias("temporal"),
        padded(F.col("history.mask_row"), length, none).alias("missing_mask"),
        padding_mask(n, length).alias("padding_mask"),
        (F.col("history.window_id") == F.array_sort("history.window_id")).alias("chronological"),
        F.col("label") if "label" in df.columns else F.lit(None).cast("int").alias("label"),
    )


def integrity(length: int, width: int) -> Column:
    """Lengths, finite values, masks of 0 and 1, and padding only at the end."""
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    checks = [
        F.size("temporal") == length,
        F.size("missing_mask") == length,
        F.forall("temporal", lambda r: (F.size(r) == width) & F.forall(r, finite)),
        F.forall("missing_mask", lambda r: F.forall(r, lambda v: v.isin(0, 1))),
        F.col("padding_mask") == padding_mask(F.col("sequence_length"), length),
        F.col("chronological"),
    ]
    return reduce(lambda a, b: a & b, checks)


def norm_statistics(df: DataFrame, values: str = "temporal_row") -> DataFrame:
    """feature, n, mean, deviation (population; 1 where it is tiny) over all rows' elements."""
    x = df.select(F.posexplode(values).alias("feature", "v")).where(~missing(F.col("v")))
    s = x.groupBy("feature").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("deviation"))
    return s.withColumn("deviation", F.when(F.col("deviation") < 1e-8, F.lit(1.0)).otherwise(F.col("deviation")))


def mask_total(df: DataFrame) -> DataFrame:
    """All ones of all missing masks, and the number of cells."""
    ones = F.aggregate("missing_mask", F.lit(0).cast("long"), lambda a, r: a + F.aggregate(r, F.lit(0).cast("long"), lambda b, v: b + v))
    return df.agg(F.count("*").alias("n_sequences"), F.sum(ones).alias("n_missing"), F.sum("sequence_length").cast("long").alias("n_steps"))


def summaries(df: DataFrame, width: int) -> DataFrame:
    """Last value, mean, slope (last minus first over length) and missing rate of each feature over the real steps."""
    real = F.slice("temporal", F.lit(1), F.col("sequence_length"))
    n = F.col("sequence_length")
    x = df.withColumn("real", real).withColumn("real_mask", F.slice("missing_mask", F.lit(1), n))
    out = []
    for k in range(width):
        col = F.transform("real", _at(k))
        mask = F.transform("real_mask", _at(k))
        total = F.aggregate(col, F.lit(0.0), lambda a, v: a + v)
        out += [
            F.element_at(col, -1).alias(f"f{k}_last"),
            (total / n).alias(f"f{k}_mean"),
            ((F.element_at(col, -1) - F.element_at(col, 1)) / n).alias(f"f{k}_slope"),
            (F.aggregate(mask, F.lit(0), lambda a, v: a + v) / n).alias(f"f{k}_missing"),
        ]
    return x.select("stay_id", "terminal_window_id", "label", "sequence_length", *out)


def _at(k: int):
    return lambda r: r[k]
