"""Wide features of tumbling windows that are anchored at each stay's intime.

One aggregation by (stay, window) makes all statistics of all vitals: a conditional mean, minimum, maximum and last
value for each. Missing flags come before values are carried forward, trends after. Windows without any reading have
no row. NaN values count as missing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STATS = ("mean", "min", "max", "last")


def window_id(time: str = "charttime", start: str = "intime", minutes: int = 5) -> Column:
    """Whole seconds since start, in windows: a reading at a window's end belongs to the next."""
    return F.floor((F.unix_timestamp(time) - F.unix_timestamp(start)) / (60 * minutes))


def with_windows(obs: DataFrame, stays: DataFrame, minutes: int) -> DataFrame:
    """Readings at or after intime, with their window."""
    x = obs.join(stays.select("stay_id", "intime"), "stay_id")
    clean = F.when(~F.isnan("value"), F.col("value"))
    return x.withColumn("value", clean).withColumn("window_id", window_id(minutes=minutes)).where(F.col("charttime") >= F.col("intime"))


def wide(readings: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """One aggregation; the last value is the latest, the greater event id at equal times."""
    aggs = []
    for v in vitals:
        own = F.when(F.col("vital_sign") == v, F.col("value"))
        aggs += [F.avg(own).alias(f"{v}_mean"), F.min(own).alias(f"{v}_min"), F.max(own).alias(f"{v}_max")]
        seen = F.when(own.isNotNull(), F.struct("charttime", "event_id"))
        aggs.append(F.max_by(own, seen).alias(f"{v}_last"))
    return readings.groupBy("stay_id", "window_id").agg(*aggs)


def wide_by_joins(readings: DataFrame, vitals: Sequence[str]) -> DataFrame:
    """The same by a frame for each vital, the last reading by row number, and full outer joins: to compare, not to use."""
    keys = ["stay_id", "window_id"]
    frames = []
    for v in vitals:
        own = readings.where((F.col("vital_sign") == v) & F.col("value").isNotNull())
        stats = own.groupBy(*keys).agg(F.avg("value").alias(f"{v}_mean"), F.min("value").alias(f"{v}_min"), F.max("value").alias(f"{v}_max"))
        newest = Window.partitionBy(*keys).orderBy(F.desc("charttime"), F.desc("event_id"))
        last = own.withColumn("rn", F.row_number().over(newest)).where("rn = 1").select(*keys, F.col("value").alias(f"{v}_last"))
        frames.append(stats.join(last, keys))
    return reduce(lambda a, b: a.join(b, keys, "full_outer"), frames)


def completed(windows: DataFrame, vitals: Sequence[str], trends: Sequence[str], total_of: Sequence[str]) -> DataFrame:
    """Missing flags, then each statistic carried forward within the stay, then trends (last - mean) and a total of last values."""
    carried = Window.partitionBy("stay_id").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)
    flags = [F.col(f"{v}_last").isNull().cast("int").alias(f"{v}_missing") for v in vitals]
    stats = [F.last(f"{v}_{s}", ignorenulls=True).over(carried).alias(f"{v}_{s}") for v in vitals for s in STATS]
    x = windows.select("stay_id", "window_id", *stats, *flags)
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f"{v}_last"), F.lit(0.0)) for v in total_of])
    return x.select("*", *[(F.col(f"{v}_last") - F.col(f"{v}_mean")).alias(f"{v}_trend") for v in trends], total.alias("total_last"))


def window_features(obs: DataFrame, stays: DataFrame, vitals: Sequence[str], minutes: int, trends: Sequence[str] = (), total_of: Sequence[str] = (), joined: bool = False) -> DataFrame:
    readings = with_windows(obs, stays, minutes)
    return completed((wide_by_joins if joined else wide)(readings, vitals), vitals, trends or vitals[:3], total_of or vitals[-3:])


def enriched(windows: DataFrame, stays: DataFrame, unknown: str, columns: Sequence[str]) -> DataFrame:
    """Static columns joined on; a sentinel becomes null."""
    static = stays.dropDuplicates(["stay_id"]).select("stay_id", "subject_id", "age", "label", *[F.nullif(F.col(c), F.lit(unknown)).alias(c) for c in columns])
    return windows.join(static, "stay_id", "left")


def fixed_checkpoint(position: str, total: str, positions: Sequence[int]) -> Column:
    return F.col(position).isin(list(positions)) | (F.col(position) == F.col(total))


def adaptive_checkpoint(position: str, total: str, most: int) -> Column:
    """About most evenly spaced positions and the last: the rounded-up share changes there. Whole numbers only."""
    k = F.least(F.col(total), F.lit(most))
    share = lambda p: F.floor((p * k + F.col(total) - 1) / F.col(total))
    return (share(F.col(position)) != share(F.col(position) - 1)) | (F.col(position) == F.col(total))
