"""Live stays replayed as a stream: timers, discharges and waiting readings, with SQL that finds the same rows from the times alone.

Events' times are compressed thirty-fold, so that production settings meet them, with a pause of eight hours for everyone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from icuflow.sources.files import shared_folder
from icuflow.sources.telemetry import VITALS, buckets_for, table
from icuflow.streaming import streams
from icuflow.streaming.stays import MESSAGES, ROCKS, Settings, live_stays

START, PAUSED, PAUSE, STEPS = 1_704_067_200, 1_705_363_200, 28_800, 3
_STATS = ("mean", "min", "max", "last")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    x = F.unix_timestamp("ts")
    t = F.lit(START) + F.floor((x - START) / 30) + F.when(x >= PAUSED, PAUSE).otherwise(0)
    e = table(spark, d, "events").select(F.col("user_id").alias("stay_id"), "event_id", t.cast("long").alias("at"), F.col("event_type").alias("vital_sign"), "value")
    return e.select("stay_id", F.col("event_id").alias("seq"), "at", F.lit("reading").alias("kind"), F.lit(None).cast("long").alias("intime"), "event_id", F.col("at").alias("charttime"), (F.col("at") + 5).alias("ingested"), F.lit("realtime").alias("source_mode"), "vital_sign", "value")


def _static(readings: DataFrame, at, kept=None) -> DataFrame:
    first = readings.groupBy("stay_id").agg(F.min("at").alias("first")).withColumn("intime", (F.col("first") - F.col("first") % 3600))
    first = first if kept is None else first.where(kept)
    return first.select("stay_id", F.lit(-1).cast("long").alias("seq"), at.alias("at"), F.lit("static").alias("kind"), "intime")


def _replayed(spark: SparkSession, d: str, name: str, settings: Settings, *messages: DataFrame) -> DataFrame:
    """The messages in order of arrival, and at last one that lets all timers run out."""
    all_rows = messages[0]
    for m in messages[1:]:
        all_rows = all_rows.unionByName(m, allowMissingColumns=True)
    last = all_rows.select(F.lit(-1).cast("long").alias("stay_id"), (F.max("at") + 36_000).alias("at"), F.lit("clock").alias("kind"))
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    rows = all_rows.unionByName(last, allowMissingColumns=True).select(*(F.col(f.split()[0]).cast(f.split()[1]) for f in MESSAGES.split(", ")))
    n = buckets_for(spark, d, "events")
    return streams.run_in_steps(rows.select(*names), "at", STEPS, shared_folder(spark, name), lambda m: live_stays(m, VITALS, settings, buckets=n), dict([ROCKS]))


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


def stream_timers(spark: SparkSession, d: str) -> DataFrame:
    """Windows final by watermark or idle time, refreshes, eviction and return."""
    r = _readings(spark, d)
    return _rounded(_replayed(spark, d, "timers", Settings(), r, _static(r, F.col("intime"))))


def stream_discharge(spark: SparkSession, d: str) -> DataFrame:
    """The same with every third stay discharged ten seconds after the middle one of its readings, twice."""
    r = _readings(spark, d)
    middle = r.where("stay_id % 3 = 0").groupBy("stay_id").agg(F.sort_array(F.collect_list("at")).alias("ats"))
    out = middle.select("stay_id", F.expr("ats[size(ats) div 2] + 10").alias("at"))
    gone = [out.select("stay_id", F.lit(10**9 + k).cast("long").alias("seq"), (F.col("at") + 20 * k).alias("at"), F.lit("discharge").alias("kind")) for k in (0, 1)]
    return _rounded(_replayed(spark, d, "discharge", Settings(), r, _static(r, F.col("intime")), *gone))


def stream_waiting(spark: SparkSession, d: str) -> DataFrame:
    """Static rows come up to 4,000 seconds after a stay's first reading, or never; four readings may wait (1,000 in production)."""
    r = _readings(spark, d).withColumn("source_mode", F.lit("replay"))
    static = _static(r, F.col("first") + F.pmod("stay_id", F.lit(5)) * 1000, F.expr("stay_id % 7 <> 0"))
    out = _replayed(spark, d, "waiting", Settings(cap=4), r, static)
    return out.where("kind = 'reading'").select("stay_id", "event_id", "at", F.when(F.col("reason") == "duplicate", "released or accepted").when(F.col("reason").isin("released", "accepted"), "released or accepted").otherwise(F.col("reason")).alias("reason"))


QUERIES = {f.__name__: f for f in (stream_timers, stream_discharge, stream_waiting)}

_T = f"{START} + (CAST(floor(epoch(ts)) AS BIGINT) - {START}) // 30 + CASE WHEN epoch(ts) >= {PAUSED} THEN {PAUSE} ELSE 0 END"


def _stays_sql(discharged: str) -> str:
    """discharged: a query for s and due, the end of the grace after a discharge."""
    stats = {"mean": "avg(value)", "min": "min(value)", "max": "max(value)", "last": "arg_max(value, (t, event_id))"}
    own = ", ".join(f"{f} FILTER (WHERE v = '{v}') AS {v}_{x}" for v in VITALS for x, f in stats.items())
    columns = [f"{v}_{x}" for v in VITALS for x in _STATS]
    carried = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY s, life ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {c}" for c in columns)
    before = ", ".join(f"arg_max(f.{c}, f.w) FILTER (WHERE f.{c} IS NOT NULL) AS {c}" for c in columns)
    flags = ", ".join(f"CAST({v}_last IS NULL AS INTEGER) AS {v}_missing" for v in VITALS)
    out = lambda prefix: ", ".join(f"round({prefix}{c}, 6) AS {c}" for c in columns)
    none = ", ".join(["NULL"] * (len(columns) + len(VITALS)))
    flag_names = ", ".join(f"{v}_missing" for v in VITALS)
    return f"""WITH r AS (SELECT user_id AS s, event_id, event_type AS v, value, {_T} AS t FROM events),
out AS ({discharged}),
i AS (SELECT s, min(t) - min(t) % 3600 AS intime FROM r GROUP BY s),
m AS (SELECT r.*, intime, due, (t - intime) // 300 AS w, row_number() OVER (PARTITION BY r.s, v, t ORDER BY event_id) AS k FROM r JOIN i USING (s) LEFT JOIN out USING (s)),
a AS (SELECT *, lead(t) OVER o AS nt, t - lag(t) OVER o AS gap, lead(t) OVER o IS NULL OR lead(t) OVER o >= t + 900 AS idles FROM m WHERE k = 1 AND (due IS NULL OR t < due) WINDOW o AS (PARTITION BY s ORDER BY t, event_id)),
acc AS (SELECT *, count(*) FILTER (WHERE gap >= 21600) OVER (PARTITION BY s ORDER BY t, event_id) AS life FROM a),
wins AS (SELECT s, life, w, any_value(intime) AS intime, any_value(due) AS due, max(t) AS lt, {own} FROM acc GROUP BY s, life, w),
ends AS (SELECT s, w, min(x.t) FILTER (WHERE x.t > lt AND x.t >= wins.intime + (w + 1) * 300 + 300) AS wm, min(x.t) FILTER (WHERE x.idles AND x.t >= lt) + 900 AS idle FROM wins JOIN (SELECT s, t, idles FROM acc) x USING (s) GROUP BY s, w),
fin AS (SELECT wins.*, least(wm, idle, due) AS ta, CASE WHEN due <= coalesce(least(wm, idle), due) THEN 'discharge' WHEN idle <= coalesce(wm, idle) THEN 'idle' ELSE 'watermark' END AS reason FROM wins JOIN ends USING (s, w)),
full_rows AS (SELECT s, life, w, ta, reason, {carried}, {flags} FROM fin),
ref AS (SELECT a.s, a.life, a.w, a.t + d AS ta, a.t, a.event_id FROM acc a, (VALUES (300), (600)) x(d) WHERE (a.nt IS NULL OR a.nt >= a.t + d) AND (a.due IS NULL OR a.t + d < a.due)),
part AS (SELECT s, w, ta, {own} FROM (SELECT ref.s, ref.w, ref.ta, x.v, x.value, x.t, x.event_id FROM ref JOIN acc x ON x.s = ref.s AND x.w = ref.w AND x.life = ref.life AND (x.t, x.event_id) <= (ref.t, ref.event_id)) GROUP BY s, w, ta),
held AS (SELECT ref.s, ref.w, ref.ta, {before} FROM ref JOIN fin f ON f.s = ref.s AND f.life = ref.life AND f.ta < ref.ta AND f.w < ref.w GROUP BY ref.s, ref.w, ref.ta),
part_rows AS (SELECT p.s, p.w, p.ta, {", ".join(f"round(CASE WHEN p.{c.rsplit('_', 1)[0]}_last IS NULL THEN h.{c} ELSE p.{c} END, 6) AS {c}" for c in columns)}, {", ".join(f"CAST(p.{v}_last IS NULL AS INTEGER) AS {v}_missing" for v in VITALS)} FROM part p LEFT JOIN held h USING (s, w, ta))
SELECT s AS stay_id, t AS "at", 'reading' AS kind, event_id, w AS window_id, 'accepted' AS reason, coalesce(gap >= 21600, false) AS recovered, {", ".join(f"NULL::DOUBLE AS {c}" for c in columns)}, {", ".join(f"NULL::INTEGER AS {v}_missing" for v in VITALS)} FROM acc
UNION ALL SELECT s, t, 'reading', event_id, CASE WHEN due IS NULL OR t < due THEN w END, CASE WHEN due IS NULL OR t < due THEN 'duplicate' ELSE 'discharged' END, NULL, {none} FROM m WHERE k > 1 OR t >= due
UNION ALL SELECT s, ta, 'final', NULL, w, reason, NULL, {out("")}, {flag_names} FROM full_rows
UNION ALL SELECT s, ta, 'refresh', NULL, w, NULL, NULL, {", ".join(columns)}, {flag_names} FROM part_rows
UNION ALL SELECT s, t + 21600, 'evicted', NULL, NULL, NULL, NULL, {none} FROM acc WHERE (nt IS NULL OR nt >= t + 21600) AND (due IS NULL OR t + 21600 < due)
UNION ALL SELECT s, due, 'discharged', NULL, NULL, NULL, NULL, {none} FROM out"""


ORACLE_SQL = {
    "stream_timers": _stays_sql("SELECT NULL::BIGINT AS s, NULL::BIGINT AS due WHERE false"),
    "stream_discharge": _stays_sql("SELECT s, list_sort(list(t))[count(*) // 2 + 1] + 40 AS due FROM r WHERE s % 3 = 0 GROUP BY s"),
    # runs of waiting readings less than the time to live apart
    "stream_waiting": f"""WITH r AS (SELECT user_id AS s, event_id, {_T} AS t FROM events),
f AS (SELECT s, min(t) + s % 5 * 1000 AS static FROM r WHERE s % 7 <> 0 GROUP BY s),
p AS (SELECT r.*, static, t - lag(t) OVER (PARTITION BY r.s ORDER BY t, event_id) AS gap FROM r LEFT JOIN f USING (s) WHERE static IS NULL OR t < static),
q AS (SELECT *, count(*) FILTER (WHERE gap >= 3600) OVER (PARTITION BY s ORDER BY t, event_id) AS run FROM p),
u AS (SELECT *, max(t) OVER (PARTITION BY s, run) + 3600 AS ends, lead(t, 4) OVER (PARTITION BY s, run ORDER BY t, event_id) AS pushed FROM q)
SELECT s AS stay_id, event_id, CASE WHEN pushed IS NOT NULL THEN pushed WHEN static < ends THEN static ELSE ends END AS "at", CASE WHEN pushed IS NOT NULL THEN 'dropped_cap' WHEN static < ends THEN 'released or accepted' ELSE 'expired' END AS reason FROM u
UNION ALL SELECT r.s, event_id, t, 'released or accepted' FROM r JOIN f USING (s) WHERE t >= static""",
}
