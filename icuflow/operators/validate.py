"""Message hygiene: every input row ends up either valid or rejected with a reason, never lost."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.operators.alerts import over_stays

MESSAGE = "schema_version string, event_id string, stay_id long, charttime string, ingestion_time string, source_mode string, source_type string, vital_sign string, value double"
REQUIRED = ("schema_version", "event_id", "stay_id", "charttime", "ingestion_time", "source_mode", "source_type", "vital_sign", "value")
REMEMBERED = 5000  # keys of each kind a stay


def parsed(raw: DataFrame, schema: str = MESSAGE, column: str = "value") -> DataFrame:
    """JSON text to columns; times in UTC without zone; malformed text gives nulls, which validation rejects.

    The text is parsed once: later filters don't move below an explode of one element, so the parser isn't repeated in them."""
    x = raw.select(F.explode(F.array(F.from_json(F.col(column).cast("string"), schema))).alias("m")).select("m.*")
    times = [F.try_to_timestamp(F.col(c)).alias(c) if c in ("charttime", "ingestion_time") else F.col(c) for c in x.columns]
    return x.select(*times)


def judged(df: DataFrame, aliases: Mapping[str, str], ranges: Mapping[str, tuple[float, float]], version: str = "1.0") -> DataFrame:
    """df with the vital's standard name and the first reason to reject it, or null."""
    name = F.lower(F.trim("vital_sign"))
    known = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])[name]
    low, high = (F.create_map(*[F.lit(x) for k, r in ranges.items() for x in (k, float(r[i]))])[known] for i in (0, 1))
    missing = F.trim("event_id") == ""
    for c in REQUIRED:
        missing = missing | F.col(c).isNull()
    finite = ~F.isnan("value") & (F.abs("value") < float("inf"))
    reason = (
        F.when(missing, "missing_field").when(F.col("schema_version") != version, "schema_version").when(known.isNull(), "unknown_vital").when(~finite, "not_finite").when(~F.col("value").between(low, high), "out_of_range")
    )
    return df.withColumn("reason", reason).withColumn("vital_sign", F.coalesce(known, F.col("vital_sign")))


def split(judged_rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    return judged_rows.where("reason is null").drop("reason"), judged_rows.where("reason is not null")


def late(df: DataFrame, seconds: int = 60) -> DataFrame:
    """Realtime rows that came more than so many seconds after their time are late; replayed ones never are."""
    lag = F.unix_timestamp("ingestion_time") - F.unix_timestamp("charttime")
    return df.withColumn("is_late", F.coalesce((F.col("source_mode") == "realtime") & (lag > seconds), F.lit(False)))


class SeenKeys:
    """Of one stay: the event ids, and the (vital, time) pairs, of the rows taken last. A refused row leaves no trace."""

    def __init__(self, most: int = REMEMBERED):
        self.most, self.ids, self.pairs = most, {}, {}

    def offer(self, event_id: str, vital: str, time) -> bool:
        if event_id in self.ids or (vital, time) in self.pairs:
            return False
        for known, key in ((self.ids, event_id), (self.pairs, (vital, time))):
            known[key] = None
            if len(known) > self.most:
                del known[next(iter(known))]
        return True


def deduplicated(df: DataFrame, order: Sequence[str] = ("ingestion_time", "event_id"), most: int = REMEMBERED) -> DataFrame:
    """In order of arrival, the rows of each stay that repeat neither the event id nor the (vital, time) of a row taken before."""
    step = lambda s, r: {"_taken": s.offer(r["event_id"], r["vital_sign"], r["charttime"])}
    return over_stays(df, list(order), lambda: SeenKeys(most), step, "_taken boolean").where("_taken").drop("_taken")


def complete_batches(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    """(stay, time) at which all needed vitals were read."""
    seen = F.collect_set(F.when(F.col("vital_sign").isin(list(needed)), F.col("vital_sign")))
    return df.groupBy("stay_id", "charttime").agg(F.size(seen).alias("n_vitals")).withColumn("complete", F.col("n_vitals") == len(needed))


def mixed_modes(df: DataFrame) -> DataFrame:
    """Stays whose messages come in several source modes."""
    return df.groupBy("stay_id").agg(F.count_distinct("source_mode").alias("n_modes")).where("n_modes > 1")


def meaningful_changes(df: DataFrame, values: Sequence[str], scores: Sequence[str], tolerance: float = 1e-9, least: float = 1e-6) -> DataFrame:
    """Why a row is news: first of its stay, a new window, a changed value, or a changed score (of several); what came or went counts as changed."""
    order = Window.partitionBy("stay_id").orderBy("window_id", "seq")
    before = lambda c: F.lag(c).over(order)

    def changed(columns: Sequence[str], by: float) -> Column:
        found: Column = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.abs(F.col(c) - before(c)) > by, F.col(c).isNull() != before(c).isNull())
        return found

    reason = F.when(F.row_number().over(order) == 1, "first").when(F.col("window_id") != before("window_id"), "new_window").when(changed(values, tolerance), "value_changed").when(changed(scores, least), "score_changed")
    return df.withColumn("update_reason", F.coalesce(reason, F.lit("none")))


def bounds_check(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """reasons: every column that is out of its bounds (nulls pass)."""
    found = [F.when(~F.col(c).between(low, high), F.lit(c)) for c, (low, high) in bounds.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*found)))


def latency(df: DataFrame, start: str, end: str) -> DataFrame:
    ms = F.unix_millis(end) - F.unix_millis(start)
    return df.withColumn("latency_ms", F.greatest(F.lit(0).cast("long"), ms))
