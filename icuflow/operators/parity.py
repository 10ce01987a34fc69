"""Comparing two results of the same rows, such as batch and replayed stream."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icuflow.operators.quantiles import exact_quantiles


def parity_rows(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerances: Mapping[str, float]) -> DataFrame:
    """key, column_name, distance and ok for each compared value; rows that one side lacks aren't ok."""
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"a_{c}") for c in tolerances], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"b_{c}") for c in tolerances], F.lit(1).alias("_b"))
    x = left.join(right, list(keys), "full_outer")
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    one = lambda c, t: F.struct(F.lit(c).alias("column_name"), F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")).alias("distance"), (both & F.coalesce(F.abs(F.col(f"a_{c}") - F.col(f"b_{c}")) <= t, F.col(f"a_{c}").isNull() & F.col(f"b_{c}").isNull())).alias("ok"))
    return x.select(*keys, F.explode(F.array(*[one(c, t) for c, t in tolerances.items()])).alias("e")).select(*keys, "e.*")


def parity_report(rows: DataFrame) -> DataFrame:
    """Per column: rows, failures, and percentiles of the distance."""
    x = rows.groupBy("column_name").agg(F.count("*").alias("n"), F.count_if(~F.col("ok")).alias("n_failed"), F.max("distance").alias("max"))
    q = exact_quantiles(rows.withColumnRenamed("column_name", "compared"), ["distance"], (0.5, 0.95, 0.99, 0.999), ["compared"]).select(F.col("compared").alias("column_name"), "q")
    return x.join(q, "column_name", "left").select("column_name", "n", "n_failed", F.col("q")[0].alias("p50"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), F.col("q")[3].alias("p999"), "max")


def straddling(df: DataFrame, a: str, b: str, threshold: float) -> DataFrame:
    """Rows that two scores put on different sides of the threshold."""
    return df.where((F.col(a) >= threshold) != (F.col(b) >= threshold))


def nearest_threshold(df: DataFrame, score: str, threshold: float, k: int, *ties: str) -> DataFrame:
    return df.orderBy(F.abs(F.col(score) - threshold), *ties).limit(k)


def picked_stays(windows: DataFrame, gaps: DataFrame, long: int, very_long: int, k: int) -> DataFrame:
    """Up to k stays of each kind: gapped, very long, long, short (the first that fits)."""
    kind = F.when(F.col("has_gap"), "gapped").when(F.col("n_windows") >= very_long, "very_long").when(F.col("n_windows") > long, "long").otherwise("short")
    order = Window.partitionBy("kind").orderBy("stay_id")
    return gaps.withColumn("kind", kind).withColumn("pick", F.row_number().over(order)).where(F.col("pick") <= k)


def sorted_for_keys(df: DataFrame, key: str, path: str, files: int, row_group_bytes: int = 8 << 20) -> None:
    """df as Parquet files in ranges of the key, sorted inside, with bloom filters of it, so that few row groups hold any key."""
    writer = df.repartitionByRange(files, key).sortWithinPartitions(key).write.mode("overwrite")
    writer.option("parquet.block.size", row_group_bytes).option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(path)


def covering_ranges(keys: DataFrame, key: str, most: int = 64) -> list[tuple[int, int]]:
    """At most so many ranges that hold all the keys: equal shares of them, each from its first to its last."""
    cuts = keys.agg(F.percentile_approx(key, [k / most for k in range(1, most)], 100 * most)).first()[0] or []
    share = F.lit(0)
    for c in sorted(set(cuts)):
        share = share + (F.col(key) > c).cast("int")
    return sorted((r["low"], r["high"]) for r in keys.groupBy(share.alias("share")).agg(F.min(key).alias("low"), F.max(key).alias("high")).where("low is not null").collect())


def keyed_rows(heavy: DataFrame, keys: DataFrame, key: str, most: int = 64) -> DataFrame:
    """The rows of the heavy table whose integer key is among keys.

    The scan gets the keys' covering ranges, by which row groups and pages of a table written by sorted_for_keys() are left out;
    the semi join then takes the keys alone. No key is lost, however many there are: ranges only grow."""
    ranges = covering_ranges(keys.select(key), key, most)
    within = F.lit(False)
    for low, high in ranges:
        within = within | F.col(key).between(low, high)
    return heavy.where(within).join(keys.select(key).distinct(), key, "left_semi")
