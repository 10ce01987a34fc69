"""Audits: each returns its findings as rows, so that a job can gate on them. None collects data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_audit(df: DataFrame) -> DataFrame:
    """column_name, n_null for every column, in one pass."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot([], df.columns, "column_name", "n_null")


def any_null_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.agg(F.count("*").alias("n_rows"), F.count_if(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in columns])).alias("n_any_null"))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def duplicate_audit(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many keys repeat, and how many rows they have beyond one each."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count("*").alias("n_keys"), F.sum("n").alias("n_rows"), F.count_if(F.col("n") > 1).alias("n_duplicate_keys"), F.sum(F.col("n") - 1).alias("n_extra_rows"))


def overlap_audit(parts: DataFrame, key: str, part: str) -> DataFrame:
    """Keys that are in several parts, by the set of parts: one aggregation instead of a join for each pair."""
    sets = parts.groupBy(key).agg(F.array_sort(F.collect_set(part)).alias("parts"))
    return sets.groupBy(F.array_join("parts", "+").alias("parts"), (F.size("parts") > 1).alias("overlap")).agg(F.count("*").alias("n_keys"))


def inconsistent_groups(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys whose columns aren't constant (nulls count as a value)."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*[F.struct(c) for c in columns])).alias("n_values")).where("n_values > 1")


def table_difference(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str], tolerance: float) -> DataFrame:
    """One row: keys on one side only, values apart by more than tolerance, and the largest distance."""
    left = a.select(*keys, *[F.col(v).alias(f"a_{v}") for v in values], F.lit(1).alias("in_a"))
    right = b.select(*keys, *[F.col(v).alias(f"b_{v}") for v in values], F.lit(1).alias("in_b"))
    x = left.join(right, list(keys), "full_outer")
    far = [F.abs(F.col(f"a_{v}") - F.col(f"b_{v}")) for v in values]
    return x.agg(
        F.count_if(F.col("in_b").isNull()).alias("only_a"),
        F.count_if(F.col("in_a").isNull()).alias("only_b"),
        F.count_if(reduce(lambda p, q: p | q, [d > tolerance for d in far])).alias("n_apart"),
        F.coalesce(F.max(F.greatest(*far, F.lit(0.0))), F.lit(0.0)).alias("max_distance"),
    )


def key_difference(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys missing from actual and keys that it has beyond expected."""
    e, a = expected.select(*keys).distinct(), actual.select(*keys).distinct()
    return e.join(a, list(keys), "left_anti").withColumn("side", F.lit("missing")).unionByName(a.join(e, list(keys), "left_anti").withColumn("side", F.lit("extra")))


def schema_check(df: DataFrame, required: Mapping[str, str]) -> DataFrame:
    """column_name, expected, actual, ok for each required column."""
    actual = dict(df.dtypes)
    rows = [(c, t, actual.get(c), actual.get(c) == t) for c, t in required.items()]
    return df.sparkSession.createDataFrame(rows, "column_name string, expected string, actual string, ok boolean")


def forbidden_columns(names: DataFrame, exact: Sequence[str], words: Sequence[str]) -> DataFrame:
    """Feature names that are forbidden or contain a word that tells of the future."""
    found = F.when(F.lower("name").isin(list(exact)), F.lit("forbidden")).when(F.lower("name").rlike("|".join(words)), F.lit("future"))
    return names.withColumn("reason", found).where("reason is not null")


def conservation(whole: DataFrame, parts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """measure, whole, parts, ok: rows and distinct keys of the whole equal the sums over the parts."""
    measures = {"rows": F.count("*"), **{k: F.count_distinct(k) for k in keys}}
    one = lambda df, name: df.agg(*[e.alias(m) for m, e in measures.items()]).unpivot([], list(measures), "measure", name)
    sums = reduce(lambda a, b: a.unionByName(b), [one(p, "n") for p in parts.values()]).groupBy("measure").agg(F.sum("n").alias("parts"))
    return one(whole, "whole").join(sums, "measure").withColumn("ok", F.col("whole") == F.col("parts"))


def gap_statistics(windows: DataFrame) -> DataFrame:
    """Per stay: number of windows, largest gap between neighbours, and whether there is any."""
    from pyspark.sql import Window

    order = Window.partitionBy("stay_id").orderBy("window_id")
    x = windows.select("stay_id", "window_id", (F.col("window_id") - F.lag("window_id").over(order)).alias("gap"))
    return x.groupBy("stay_id").agg(F.count("*").alias("n_windows"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("max_gap"), F.coalesce(F.max("gap") > 1, F.lit(False)).alias("has_gap"))
