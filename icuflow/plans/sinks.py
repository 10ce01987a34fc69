"""Streams into sinks: messages to topics with counters, and a table merged by key, each with SQL over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.operators import validate
from icuflow.plans.decisions import ALIASES, EVENTS_SQL, MESSAGES_SQL, RANGES, _events
from icuflow.sources.files import shared_folder
from icuflow.sources.telemetry import buckets_for, messages
from icuflow.streaming import sinks, streams
from icuflow.streaming.stays import ROCKS

REASONS = ("missing_field", "schema_version", "unknown_vital", "out_of_range", "mixed_mode", "late", "duplicate")
STEPS = 3


def _steps(spark: SparkSession, d: str) -> DataFrame:
    """Messages as JSON text, in the order in which they came in."""
    x = messages(spark, d)
    at = F.unix_timestamp(F.get_json_object("value", "$.ingestion_time").cast("timestamp"))
    return x.select(F.col("value"), F.col("key").cast("long").alias("seq"), at.alias("at"))


def _judged(raw: DataFrame) -> DataFrame:
    found = validate.judged(validate.parsed(raw), ALIASES, RANGES)
    return found.withColumn("seq", F.col("event_id").cast("long"))


def _routed(spark: SparkSession, d: str, listener: sinks.Counters) -> str:
    folder = shared_folder(spark, "topics")
    n = [F.count("*").alias("all"), F.count_if(F.col("reason").isNull()).alias("accepted"), *(F.count_if(F.col("reason") == r).alias(r) for r in REASONS)]
    buckets = buckets_for(spark, d, "events")
    made = lambda raw: sinks.routed(sinks.clean_and_rejected(_judged(raw), buckets=buckets).observe(listener.name, *n))
    spark.streams.addListener(listener)
    try:
        streams.run_in_steps(_steps(spark, d), "at", STEPS, folder, made, dict([ROCKS]), sinks.for_each(sinks.to_topics(f"{folder}/topics")))
        listener.ended.wait(60)
    finally:
        spark.streams.removeListener(listener)
    return f"{folder}/topics"


def stream_topics(spark: SparkSession, d: str) -> DataFrame:
    """Every message in the topic where it belongs."""
    path = _routed(spark, d, sinks.Counters("routed"))
    return sinks.from_topics(spark, path).select("topic", "key", F.get_json_object("value", "$.event_id").alias("event_id"), F.get_json_object("value", "$.type").alias("type"))


def stream_counters(spark: SparkSession, d: str) -> DataFrame:
    """The same stream's counters, summed over its batches."""
    listener = sinks.Counters("counted")
    _routed(spark, d, listener)
    return spark.createDataFrame(sorted(listener.total().items()), "counter string, n long")


def stream_merge(spark: SparkSession, d: str) -> DataFrame:
    """Risk events merged by stay and pair of windows as they come."""
    x = _events(spark, d).withColumn("window_id", F.floor(F.col("window_id") / 2))
    folder = shared_folder(spark, "merged")
    table = sinks.MergedTable(spark, f"{folder}/table", "stay_id long, window_id long, status string, seq long, p double", ["stay_id", "window_id"], "seq", buckets=8)
    streams.run_in_steps(x, "seq", STEPS, folder, lambda rows: rows, start=sinks.for_each(table.merge))
    return table.read()


QUERIES = {f.__name__: f for f in (stream_topics, stream_counters, stream_merge)}

# the mode of a stay is that of its first valid message; of the rest, the first of each kind and second is taken
_ROUTED = f"""{MESSAGES_SQL},
v AS (SELECT *, row_number() OVER (PARTITION BY reason IS NULL, user_id ORDER BY epoch(charttime) + lag, event_id) AS place FROM m),
w AS (SELECT v.*, f.source_mode AS mode FROM v LEFT JOIN (SELECT user_id, source_mode FROM v WHERE reason IS NULL AND place = 1) f USING (user_id)),
l AS (SELECT *, CASE WHEN reason IS NOT NULL THEN reason WHEN source_mode <> mode THEN 'mixed_mode' WHEN source_mode = 'realtime' AND lag > 60 THEN 'late' END AS type FROM w),
t AS (SELECT *, CASE WHEN type IS NULL AND row_number() OVER (PARTITION BY type IS NULL, user_id, event_type, charttime ORDER BY place) > 1 THEN 'duplicate' ELSE type END AS final_type FROM l)"""

ORACLE_SQL = {
    "stream_topics": f"WITH {_ROUTED} SELECT CASE WHEN final_type IS NULL THEN 'observations' WHEN final_type = 'duplicate' THEN 'duplicates' ELSE 'dead_letters' END AS topic, CASE WHEN final_type IS DISTINCT FROM 'missing_field' THEN CAST(user_id AS VARCHAR) END AS key, CAST(event_id AS VARCHAR) AS event_id, final_type AS type FROM t",
    "stream_counters": f"WITH {_ROUTED} SELECT 'all' AS counter, count(*) AS n FROM t UNION ALL SELECT 'accepted', count(*) FILTER (final_type IS NULL) FROM t UNION ALL SELECT x.r, count(*) FILTER (final_type = x.r) FROM t, (VALUES {', '.join(f"('{r}')" for r in REASONS)}) x(r) GROUP BY x.r",
    "stream_merge": f"WITH {EVENTS_SQL} SELECT stay_id, window_id // 2 AS window_id, status, seq, p FROM ev QUALIFY row_number() OVER (PARTITION BY stay_id, window_id // 2 ORDER BY status = 'FINAL' DESC, seq DESC) = 1",
}
