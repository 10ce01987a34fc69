"""Queries that replay tables as streams, to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.plans.decisions import ALERT_SQL, _scores
from icuflow.plans.features import DAY, features_sql, rounded
from icuflow.sources.files import shared_folder
from icuflow.sources.telemetry import VITALS, buckets_for, observations, stays
from icuflow.streaming import streams
from icuflow.streaming.stays import ROCKS

def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Final windows by each stay's own watermark."""
    readings, n = observations(spark, d).join(stays(spark, d).select("stay_id", "intime"), "stay_id").withColumn("at", F.unix_micros(F.col("charttime").cast("timestamp"))), buckets_for(spark, d, "events")
    out = streams.run_in_steps(readings, "at", 3, shared_folder(spark, "windows"), lambda r: streams.final_windows(r, VITALS, DAY, buckets=n), dict([ROCKS]))
    return rounded(out.where("status = 'FINAL'").drop("status"))


def stream_alerts(spark: SparkSession, d: str) -> DataFrame:
    """The alert machine over orders' scores, window by window of arrival."""
    n = buckets_for(spark, d, "lineitem")
    made = lambda scores: streams.alert_stream(scores, n, threshold=0.6, cooldown=3, escalation=0.1, dead_band=0.05)
    return rounded(streams.run_in_steps(_scores(spark, d), "window_id", 2, shared_folder(spark, "alerts"), made, dict([ROCKS])))


QUERIES = {"stream_windows": stream_windows, "stream_alerts": stream_alerts}

_STATS = ", ".join(f"round({v}_{s}, 6) AS {v}_{s}" for v in VITALS for s in ("mean", "min", "max", "last"))
_FLAGS = ", ".join(f"{v}_missing" for v in VITALS)

ORACLE_SQL = {
    "stream_alerts": f"WITH {ALERT_SQL} SELECT stay_id, window_id, round(p, 6) AS p, alert, reason, direction, pending, CAST(cooldown AS INTEGER) AS cooldown FROM m",
    "stream_windows": f"WITH {features_sql(DAY)}, seen AS (SELECT user_id AS stay_id, max(epoch(ts)) AS t FROM events GROUP BY 1) SELECT stay_id, window_id, {_STATS}, {_FLAGS} FROM features JOIN stays USING (stay_id) JOIN seen USING (stay_id) WHERE epoch(intime) + (window_id + 1) * 86400 <= t - 300",
}
