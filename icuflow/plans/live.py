"""Queries of the live service's decisions."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.operators import live, windows
from icuflow.plans.features import DAY, readings_sql, rounded
from icuflow.sources.telemetry import observations, stays, table


def partial_windows(spark, d):
    s = stays(spark, d).select("stay_id", "intime")
    x = windows.with_windows(observations(spark, d), s, DAY)
    return rounded(live.partial_windows(x, DAY))


def _seconds(spark, d):
    return table(spark, d, "events").select(F.col("user_id").alias("stay_id"), "event_id", F.unix_timestamp("ts").alias("t"))


def pending_release(spark, d):
    """Static rows come up to two hours after a stay's first reading, and for every seventh stay never."""
    e = _seconds(spark, d)
    static = e.groupBy("stay_id").agg(F.min("t").alias("first")).where(F.pmod("stay_id", F.lit(7)) != 0).select("stay_id", (F.col("first") + F.pmod("stay_id", F.lit(5)) * 40_000).alias("static_arrival"))
    return live.pending_release(e.withColumnRenamed("t", "arrival"), static, ttl=90_000)


def idle_and_evicted(spark, d):
    return live.idle_and_evicted(_seconds(spark, d))


def discharge_filter(spark, d):
    """Every third stay is discharged at its reading of the 20th day, or never."""
    e = _seconds(spark, d)
    out = e.where((F.pmod("stay_id", F.lit(3)) == 0) & (F.col("t") >= 1_705_708_800)).groupBy("stay_id").agg(F.min("t").alias("discharged"))
    return live.discharge_filter(e, out, grace=86_400)


def live_order(spark, d):
    """Readings as live updates in order of event, some repeated, some late."""
    e = table(spark, d, "events")
    t = F.unix_timestamp("ts") - F.when(F.pmod("event_id", F.lit(11)) == 0, 200_000).otherwise(0)
    base = e.select(F.col("user_id").alias("stay_id"), (F.col("event_id") * 2).alias("seq"), F.floor(t / 86_400).alias("window_id"), t.alias("time"), (F.pmod("event_id", F.lit(5)) == 0).alias("final"))
    again = base.where(F.pmod("seq", F.lit(26)) == 0).withColumn("seq", F.col("seq") + 1)
    return live.live_order(base.unionByName(again)).select("stay_id", "seq", "reason")


QUERIES = {f.__name__: f for f in (partial_windows, pending_release, idle_and_evicted, discharge_filter, live_order)}

_T = "t AS (SELECT user_id AS stay_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events)"

ORACLE_SQL = {
    "partial_windows": f"WITH {readings_sql(DAY)} SELECT r.stay_id, window_id, event_id, round(avg(value) OVER w, 6) AS mean, round(min(value) OVER w, 6) AS low, round(max(value) OVER w, 6) AS high, count(value) OVER w AS n, floor(epoch(charttime)) - floor(epoch(intime)) - window_id * 86400 >= 120 AS early FROM readings r JOIN stays s ON r.stay_id = s.stay_id WINDOW w AS (PARTITION BY r.stay_id, window_id, vital_sign ORDER BY charttime, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
    # one row of each stay a step, with the open window, its last time and the last closed window
    "live_order": """WITH RECURSIVE b AS (
  SELECT user_id AS stay_id, event_id * 2 AS seq, CAST(floor(epoch(ts)) AS BIGINT) - CASE WHEN event_id % 11 = 0 THEN 200000 ELSE 0 END AS time, event_id % 5 = 0 AS final FROM events),
u AS (SELECT * FROM b UNION ALL SELECT stay_id, seq + 1, time, final FROM b WHERE seq % 26 = 0),
r AS (SELECT *, CAST(floor(time / 86400) AS BIGINT) AS w, row_number() OVER (PARTITION BY stay_id ORDER BY seq) AS k FROM u),
s AS (
  SELECT stay_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS ow, NULL::BIGINT AS ot, NULL::BIGINT AS closed, NULL::VARCHAR AS reason FROM (SELECT DISTINCT stay_id FROM r)
  UNION ALL
  SELECT stay_id, k, seq, CASE WHEN reason <> 'accepted' THEN ow WHEN NOT final THEN w END, CASE WHEN reason <> 'accepted' THEN ot WHEN NOT final THEN time END, CASE WHEN reason = 'accepted' AND final THEN w ELSE closed END, reason
  FROM (SELECT r.stay_id, r.k, r.seq, r.w, r.time, r.final, s.ow, s.ot, s.closed,
               CASE WHEN r.w <= s.closed THEN 'closed' WHEN r.w < s.ow THEN 'stale' WHEN r.w = s.ow AND r.time = s.ot THEN 'duplicate' WHEN r.w = s.ow AND r.time < s.ot THEN 'out_of_order' ELSE 'accepted' END AS reason
        FROM s JOIN r ON r.stay_id = s.stay_id AND r.k = s.k + 1))
SELECT stay_id, seq, reason FROM s WHERE k > 0""",
    "pending_release": f"WITH {_T}, s AS (SELECT stay_id, min(t) + stay_id % 5 * 40000 AS a FROM t WHERE stay_id % 7 <> 0 GROUP BY stay_id), x AS (SELECT t.stay_id, event_id, a, greatest(0, a - t) AS w FROM t LEFT JOIN s ON t.stay_id = s.stay_id) SELECT stay_id, event_id, CASE WHEN a IS NULL OR w > 90000 THEN 'expired' WHEN w > 0 THEN 'released' ELSE 'direct' END AS status, CASE WHEN a IS NOT NULL AND w <= 90000 THEN w END AS waited FROM x",
    "idle_and_evicted": f"WITH {_T}, g AS (SELECT *, t - lag(t) OVER (PARTITION BY stay_id ORDER BY t, event_id) AS gap FROM t) SELECT stay_id, event_id, coalesce(gap > 900, false) AS idle_finalised, coalesce(gap > 21600, false) AS recovered FROM g",
    "discharge_filter": f"WITH {_T}, d AS (SELECT stay_id, min(t) AS x FROM t WHERE stay_id % 3 = 0 AND t >= 1705708800 GROUP BY 1) SELECT t.stay_id, event_id, CASE WHEN t > x + 86400 THEN 'refused' WHEN t > x THEN 'in_grace' ELSE 'open' END AS status FROM t LEFT JOIN d ON t.stay_id = d.stay_id",
}
