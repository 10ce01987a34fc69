"""Chained stateful operators replayed as streams: windows to sequences to alerts, and live updates; with recursive SQL that knows nothing of the machines."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from icuflow.plans.decisions import ALERT_SQL
from icuflow.plans.features import rounded
from icuflow.sources.files import shared_folder
from icuflow.sources.telemetry import VITALS, buckets_for, table
from icuflow.streaming import chains, streams
from icuflow.streaming.stays import ROCKS

ALERT = {"threshold": 0.6, "cooldown": 3, "escalation": 0.1, "dead_band": 0.05}
SPAN, STEP = 345_600, 172_800  # seconds of a live window, and of the times that readings share
NEEDED = VITALS[:2]  # production needs six of ten


def recent_level(kept: np.ndarray) -> float:
    """A stand-in for a sequence model: the mean of the last three windows, in [0, 1]."""
    return min(1.0, float(kept[-3:, 0].mean()) / 100)


def _offers(spark: SparkSession, d: str) -> DataFrame:
    """Readings as windows in order, some of them again, changed, late, at a wrong time, of another patient, or not valid."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("stay_id"), "event_id", F.row_number().over(order).alias("k"), F.unix_timestamp("ts").cast("double").alias("t"), "value")
    h = F.col("event_id") % 11
    n = F.lit(None)
    first = e.select(
        "stay_id",
        (F.col("k") * 10).cast("long").alias("seq"),
        F.when(h == 4, F.col("k") - 3).otherwise(F.col("k")).cast("long").alias("window_id"),
        F.when(h == 3, n).when(h == 6, F.col("t") - 1_000_000).otherwise(F.col("t")).alias("time"),
        F.array(F.when(h == 5, F.lit(float("nan"))).otherwise(F.col("value")), (F.col("k") % 7).cast("double")).alias("values"),
        F.when(h == 7, "t").otherwise("s").alias("static"),
        ((F.col("stay_id") % 5 == 0) & (F.col("k") == 40)).alias("discharged"),
        "event_id",
    )
    again = first.where(F.col("event_id") % 11 == 1).withColumn("seq", F.col("seq") + 1)
    other = first.where(F.col("event_id") % 11 == 2).withColumn("seq", F.col("seq") + 25).withColumn("values", F.transform("values", lambda v: v + 1))
    return first.unionByName(again).unionByName(other).drop("event_id").withColumn("arrived", F.timestamp_seconds(F.col("seq")))


def stream_sequences(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of windows, the sequences of 120 that accepted ones make, and the alerts that their scores raise."""
    n = buckets_for(spark, d, "events")
    out = streams.run_in_steps(_offers(spark, d), "seq", 3, shared_folder(spark, "sequences"), lambda w: chains.processed_windows(w, recent_level, 2, buckets=n, **ALERT), dict([ROCKS]))
    return rounded(out.drop("latency_ms"))


def _readings(spark: SparkSession, d: str) -> DataFrame:
    """Readings at shared times, with three probabilities, and a final of each window: after its last reading, 31 later for odd windows, and early for one in four."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(order)).withColumn("time", (F.floor(F.unix_timestamp("ts") / STEP) - F.when(F.col("event_id") % 13 == 0, 1).otherwise(0)) * STEP)
    base = e.select(F.col("user_id").alias("stay_id"), (F.col("k") * 10).cast("long").alias("seq"), F.col("time").cast("long").alias("time"), F.col("event_type").alias("vital_sign"), (F.floor(F.col("value") / 100) * 100).cast("double").alias("value"), F.round(F.floor(F.col("value") / 40) / 10, 6).alias("p"), F.lit(0.5).alias("p1"), F.when(F.col("event_id") % 3 > 0, F.lit(0.25)).alias("p2"))
    window = F.floor(F.col("time") / SPAN).cast("long")
    finals = base.groupBy("stay_id", window.alias("window_id")).agg(F.min("seq").alias("first"), F.max("seq").alias("last"), F.max("p").alias("p"))
    at = F.when(F.col("window_id") % 4 == 2, F.col("first") + 25).otherwise(F.col("last") + F.when(F.col("window_id") % 2 == 1, 315).otherwise(5))
    finals = finals.select("stay_id", at.alias("seq"), "window_id", "p", F.lit(True).alias("final"))
    repeated = base.withColumn("seq", F.col("seq") + 1).where("seq % 3 = 0")
    return base.unionByName(repeated).withColumn("final", F.lit(False)).unionByName(finals, allowMissingColumns=True)


def stream_live_updates(spark: SparkSession, d: str) -> DataFrame:
    """Complete times as live updates, ordered, judged and compared, with finals between them."""
    n = buckets_for(spark, d, "events")
    out = streams.run_in_steps(_readings(spark, d), "seq", 3, shared_folder(spark, "updates"), lambda r: chains.live_updates(r, NEEDED, SPAN, buckets=n), dict([ROCKS]))
    return rounded(out.withColumn("changed", F.array_join("changed", "+")))


QUERIES = {f.__name__: f for f in (stream_sequences, stream_live_updates)}

_BITS = "CASE x.v " + " ".join(f"WHEN '{v}' THEN {1 << k}" for k, v in enumerate(VITALS)) + " END"
_LATEST = ", ".join(f"CASE WHEN NOT x.final AND x.v = '{v}' AND (l.t_{v} IS NULL OR x.t >= l.t_{v}) THEN x.val ELSE l.v_{v} END AS v_{v}, CASE WHEN NOT x.final AND x.v = '{v}' AND (l.t_{v} IS NULL OR x.t >= l.t_{v}) THEN x.t ELSE l.t_{v} END AS t_{v}" for v in VITALS)
_NO_VITALS = ", ".join(f"NULL::DOUBLE AS v_{v}, NULL::BIGINT AS t_{v}, NULL::DOUBLE AS b_{v}" for v in VITALS)
_CHANGED = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN v_{v} IS NOT NULL AND (b_{v} IS NULL OR abs(v_{v} - b_{v}) > 1e-9) THEN '{v}' END" for v in sorted(VITALS)) + "], lambda c: c IS NOT NULL), '+')"

ORACLE_SQL = {
    # each offer against what was kept before it: a map of the windows, the last time, the static row and whether discharged
    "stream_sequences": f"""WITH RECURSIVE e AS (SELECT user_id AS stay_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n, floor(epoch(ts)) AS t FROM events),
f AS (SELECT stay_id, event_id % 11 AS h, n * 10 AS seq, CASE WHEN event_id % 11 = 4 THEN n - 3 ELSE n END AS w, CASE event_id % 11 WHEN 3 THEN NULL WHEN 6 THEN t - 1000000 ELSE t END AS t,
  CASE WHEN event_id % 11 <> 5 THEN value END AS a, n % 7 AS b, CASE WHEN event_id % 11 = 7 THEN 't' ELSE 's' END AS st, stay_id % 5 = 0 AND n = 40 AS out FROM e),
u AS (SELECT * FROM f UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM f WHERE h = 1 UNION ALL SELECT * REPLACE (seq + 25 AS seq, a + 1 AS a, b + 1 AS b) FROM f WHERE h = 2),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY seq) AS k FROM u),
l AS (SELECT stay_id, 0::BIGINT AS k, 0::BIGINT AS seq, 0::BIGINT AS w, '' AS reason, MAP([]::BIGINT[], []::STRUCT(a DOUBLE, b DOUBLE, t DOUBLE, st VARCHAR)[]) AS kept, NULL::DOUBLE AS last, NULL::VARCHAR AS st, false AS out FROM (SELECT DISTINCT stay_id FROM x)
  UNION ALL
  SELECT stay_id, k, seq, w, reason, CASE WHEN reason = 'accepted' THEN map_concat(kept, MAP([w], [{{'a': a, 'b': b::DOUBLE, 't': t, 'st': nst}}])) ELSE kept END, CASE WHEN reason = 'accepted' THEN t ELSE last END, CASE WHEN reason = 'accepted' THEN nst ELSE st END, out OR (reason = 'accepted' AND nout)
  FROM (SELECT x.stay_id, x.k, x.seq, x.w, x.a, x.b, x.t, x.st AS nst, x.out AS nout, l.kept, l.last, l.st, l.out,
    CASE WHEN x.t IS NULL OR x.a IS NULL OR x.w < 0 THEN 'invalid'
         WHEN map_contains(l.kept, x.w) THEN CASE WHEN l.kept[x.w] = {{'a': x.a, 'b': x.b::DOUBLE, 't': x.t, 'st': x.st}} THEN 'duplicate' ELSE 'conflicting_duplicate' END
         WHEN l.out THEN 'discharged' WHEN x.w < list_max(map_keys(l.kept)) THEN 'stale' WHEN x.t <= l.last THEN 'timestamp_order' WHEN x.st <> l.st THEN 'static_changed' ELSE 'accepted' END AS reason
    FROM l JOIN x ON x.stay_id = l.stay_id AND x.k = l.k + 1)),
r AS MATERIALIZED (SELECT stay_id, seq, w AS window_id, reason, cardinality(kept) AS n_kept, 120 - cardinality(kept) AS n_padded, list_sum([y.a + y.b for y in map_values(kept)]) AS total, least(1.0, list_avg(list_slice([y.a for y in map_values(kept)], greatest(1, cardinality(kept)::BIGINT - 2), cardinality(kept)::BIGINT)) / 100) AS score FROM l WHERE k > 0),
o AS MATERIALIZED (SELECT stay_id, window_id, score AS p, row_number() OVER (PARTITION BY stay_id ORDER BY window_id) AS n FROM r WHERE reason = 'accepted'),
{ALERT_SQL[ALERT_SQL.index("m AS (") :]}
SELECT r.stay_id, r.seq, r.window_id, r.reason, r.n_kept::BIGINT AS n_kept, CASE WHEN r.reason = 'accepted' THEN n_padded END AS n_padded, CASE WHEN r.reason = 'accepted' THEN round(total, 6) END AS total, CASE WHEN r.reason = 'accepted' THEN round(score, 6) END AS score, m.alert, m.reason AS alert_reason
FROM r LEFT JOIN m ON r.reason = 'accepted' AND m.stay_id = r.stay_id AND m.window_id = r.window_id""",
    # l: the live state (lw, lp, lp1, lp2 and vitals b_), order (ow, ot, closed), newest final (fw, fp), latest vitals (v_, t_), vitals seen at each time (a map of bits)
    "stream_live_updates": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 10 AS seq, (CAST(floor(floor(epoch(ts)) / {STEP}) AS BIGINT) - CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END) * {STEP} AS t FROM events),
b AS (SELECT user_id AS s, seq, t, event_type AS v, floor(value / 100) * 100 AS val, round(floor(value / 40) / 10, 6) AS p, 0.5 AS p1, CASE WHEN event_id % 3 > 0 THEN 0.25 END AS p2, false AS final, t // {SPAN} AS w FROM e),
g AS (SELECT s, w, CASE WHEN w % 4 = 2 THEN min(seq) + 25 ELSE max(seq) + CASE WHEN w % 2 = 1 THEN 315 ELSE 5 END END AS seq, max(p) AS p FROM b GROUP BY s, w),
u AS (SELECT * FROM b UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM b WHERE (seq + 1) % 3 = 0 UNION ALL SELECT s, seq, NULL, NULL, NULL, p, NULL, NULL, true, w FROM g),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s ORDER BY seq) AS k FROM u),
l AS (SELECT s, 0::BIGINT AS k, 0::BIGINT AS seq, NULL::BIGINT AS w, NULL::BIGINT AS t, false AS final, NULL::DOUBLE AS p, '' AS reason, NULL::DOUBLE AS before, NULL::VARCHAR AS changed, NULL::BIGINT AS lw, NULL::DOUBLE AS lp, NULL::DOUBLE AS lp1, NULL::DOUBLE AS lp2, NULL::BIGINT AS ow, NULL::BIGINT AS ot, NULL::BIGINT AS closed, NULL::BIGINT AS fw, NULL::DOUBLE AS fp, MAP([]::BIGINT[], []::INTEGER[]) AS bits, {_NO_VITALS} FROM (SELECT DISTINCT s FROM x)
  UNION ALL
  SELECT s, k, seq, w, t, final, p, CASE WHEN state <> 'accepted' THEN state WHEN NOT same THEN 'initial' WHEN {_CHANGED} <> '' THEN 'vital_changed' WHEN p IS DISTINCT FROM lp OR p1 IS DISTINCT FROM lp1 OR p2 IS DISTINCT FROM lp2 THEN 'risk_changed' ELSE 'unchanged' END,
    CASE WHEN state = 'accepted' THEN CASE WHEN same THEN lp ELSE fp END END, CASE WHEN state = 'accepted' THEN CASE WHEN same THEN {_CHANGED} ELSE '' END END,
    CASE WHEN state = 'accepted' THEN w WHEN NOT closes THEN lw END, CASE WHEN state = 'accepted' THEN p WHEN NOT closes THEN lp END, CASE WHEN state = 'accepted' THEN p1 WHEN NOT closes THEN lp1 END, CASE WHEN state = 'accepted' THEN p2 WHEN NOT closes THEN lp2 END,
    CASE WHEN state = 'accepted' THEN w WHEN NOT closes THEN ow END, CASE WHEN state = 'accepted' THEN t WHEN NOT closes THEN ot END, CASE WHEN closes THEN w ELSE closed END,
    CASE WHEN final AND (fw IS NULL OR w >= fw) THEN w ELSE fw END, CASE WHEN final AND (fw IS NULL OR w >= fw) THEN p ELSE fp END,
    CASE WHEN NOT final THEN map_concat(bits, MAP([t], [CASE WHEN full_set THEN 0 ELSE seen END])) WHEN closes THEN map_from_entries(list_filter(map_entries(bits), lambda m: m.key // {SPAN} <> w)) ELSE bits END,
    {", ".join(f"v_{v}, t_{v}, CASE WHEN state = 'accepted' THEN v_{v} WHEN NOT closes THEN b_{v} END" for v in VITALS)}
  FROM (SELECT *, final AND (closed IS NULL OR w > closed) AND (ow IS NULL OR w >= ow) AS closes, coalesce(lw = w, false) AS same,
          CASE WHEN final THEN 'final' WHEN NOT full_set THEN 'incomplete' WHEN w <= closed THEN 'closed' WHEN w < ow THEN 'stale' WHEN w = ow AND t = ot THEN 'duplicate' WHEN w = ow AND t < ot THEN 'out_of_order' ELSE 'accepted' END AS state
        FROM (SELECT *, seen & {(1 << len(NEEDED)) - 1} = {(1 << len(NEEDED)) - 1} AS full_set FROM (SELECT x.s, x.k, x.seq, x.w, x.t, x.final, x.p, x.p1, x.p2, l.lw, l.lp, l.lp1, l.lp2, l.ow, l.ot, l.closed, l.fw, l.fp, l.bits, coalesce(l.bits[x.t], 0) | {_BITS} AS seen, {_LATEST}, {", ".join(f"l.b_{v}" for v in VITALS)}
              FROM l JOIN x ON x.s = l.s AND x.k = l.k + 1))))
SELECT s AS stay_id, seq, w AS window_id, t AS time, final, reason, round(p, 6) AS p, round(before, 6) AS p_previous, round(p - before, 6) AS risk_delta, changed FROM l WHERE k > 0""",
}
