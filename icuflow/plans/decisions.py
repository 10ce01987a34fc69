"""Queries of scores and what follows from them: metrics, thresholds, calibration, blending, bootstrap, alerts, message hygiene, serving, parity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from icuflow.functions import scalars
from icuflow.operators import alerts, ensemble, metrics, parity, serving, splits, validate
from icuflow.plans.features import H, _attributed, features, features_sql, rounded
from icuflow.sources.files import shared_folder
from icuflow.sources.telemetry import PREDS_SQL, VITALS, messages, partitions_for, predictions, table, tasks_for

PLATT = {"p1": (-0.4, 0.3), "p2": (0.2, -0.5)}
WEIGHT, REPLICATES, REPEATED = 0.48, 2000, 20
FLOORS = [0.70, 0.75, 0.80, 0.85, 0.90]


def metric_rows(spark, d):
    """Both scores, long."""
    return predictions(spark, d).select("stay_id", "window_id", "label", F.explode(F.create_map(F.lit("p1"), F.col("p1"), F.lit("p2"), F.col("p2"))).alias("model", "score"))


def roc_auc(spark, d):
    return rounded(metrics.ranking_metrics(metric_rows(spark, d), "score", ["model"]).select("model", "roc_auc"))


def avg_precision(spark, d):
    return rounded(metrics.ranking_metrics(metric_rows(spark, d), "score", ["model"]).select("model", "average_precision"))


def brier_logloss(spark, d):
    return rounded(metrics.probability_metrics(metric_rows(spark, d), "score", ["model"]))


def class_weight(spark, d):
    return rounded(metrics.class_weight(predictions(spark, d)))


def score_describe(spark, d):
    return rounded(metrics.describe(metric_rows(spark, d), "score", ["model"]))


def score_correlation(spark, d):
    return rounded(predictions(spark, d).agg(F.count("*").alias("n"), F.corr("p1", "p2").alias("correlation")))


def probability_checks(spark, d):
    x = predictions(spark, d).withColumn("q", F.col("p1") * 1.02)
    return metrics.probability_checks(x, ["p1", "p2", "q"])


def decisions(spark, d):
    """Rows at or above the threshold, by label."""
    x = predictions(spark, d).withColumn("alert", (F.col("p1") >= 0.44).cast("int"))
    return x.groupBy("label", "alert").agg(F.count("*").alias("n"))


def align_indicator(spark, d):
    """Two cuts of the predictions, aligned: where rows come from, and how labels agree."""
    p = predictions(spark, d)
    a = p.where(F.pmod("stay_id", F.lit(5)) != 0).select("stay_id", "window_id", "label", "p1")
    b = p.where(F.pmod("window_id", F.lit(3)) != 0).select("stay_id", "window_id", F.when(F.pmod("stay_id", F.lit(11)) == 0, 1 - F.col("label")).otherwise(F.col("label")).alias("label"), "p2")
    return metrics.aligned(a, b, ["stay_id", "window_id"]).groupBy("indicator", "labels_agree").agg(F.count("*").alias("n"))


def grid(spark, d, low=5, high=95):
    return metrics.threshold_grid(predictions(spark, d), "p1", low, high)


GRID_SQL = f"""{PREDS_SQL},
t AS (SELECT k / 100.0::DOUBLE AS threshold FROM range(5, 96) r(k)),
c AS (SELECT threshold, count(*) FILTER (p1 >= threshold AND label = 1) AS tp, count(*) FILTER (p1 >= threshold AND label = 0) AS fp,
             count(*) FILTER (p1 < threshold AND label = 0) AS tn, count(*) FILTER (p1 < threshold AND label = 1) AS fn FROM preds, t GROUP BY 1),
grid AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
                tn / nullif(tn + fp, 0) AS specificity, tn / nullif(tn + fn, 0) AS npv,
                CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
                CASE WHEN 5 * tp + fp + 4 * fn = 0 THEN 0 ELSE 5 * tp / (5 * tp + fp + 4 * fn) END AS f2,
                (tp + tn) / (tp + tn + fp + fn) AS accuracy, (tp + fp) / (tp + tn + fp + fn) AS alert_rate FROM c),
g AS (SELECT *, recall + specificity - 1 AS youden FROM grid)"""
GRID_COLUMNS = "round(threshold, 6) AS threshold, tp, fp, tn, fn, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("precision", "recall", "specificity", "npv", "f1", "f2", "accuracy", "alert_rate", "youden"))


def threshold_grid(spark, d):
    return rounded(grid(spark, d))


def recall_floor_pick(spark, d):
    return rounded(metrics.recall_floor_pick(grid(spark, d), FLOORS))


def sens85_pick(spark, d):
    return rounded(metrics.sensitivity_pick(grid(spark, d), 0.85))


def criteria_table(spark, d):
    return rounded(metrics.criteria_table(grid(spark, d), 0.85))


def nearest_threshold(spark, d):
    return rounded(metrics.nearest_thresholds(grid(spark, d), [0.10, 0.254, 0.256, 0.5], 0.44).select("threshold", "precision", "recall", "locked"))


def monotone_curve(spark, d):
    return metrics.monotone_violations(grid(spark, d))


def platt_apply(spark, d):
    x = ensemble.platt_apply(predictions(spark, d), PLATT)
    return rounded(x.select("stay_id", "window_id", "p1_calibrated", "p2_calibrated"))


def platt_fit(spark, d):
    return rounded(ensemble.platt_fit(predictions(spark, d), "p1"), 3)


def calibration_invariance(spark, d):
    """An increasing calibration keeps the ranking metrics."""
    x = ensemble.platt_apply(predictions(spark, d), {"p1": (-0.4, 0.3)})
    a = metrics.ranking_metrics(x, "p1").select(F.col("roc_auc").alias("a"), F.col("average_precision").alias("b"))
    b = metrics.ranking_metrics(x, "p1_calibrated").select(F.col("roc_auc").alias("c"), F.col("average_precision").alias("e"))
    return a.join(b, F.lit(True)).select((F.abs(F.col("a") - F.col("c")) < 1e-9).alias("roc_auc_kept"), (F.abs(F.col("b") - F.col("e")) < 1e-9).alias("average_precision_kept"))


def blend_grid(spark, d):
    return rounded(ensemble.blend_grid(predictions(spark, d), "p1", "p2", 100))


def blend_choice(spark, d):
    """Chosen on two thirds of the orders, judged on the others."""
    x = predictions(spark, d)
    return rounded(ensemble.blend_choice(x.where("stay_id % 3 <> 0"), x.where("stay_id % 3 = 0"), "p1", "p2"))


def blend_gain(spark, d):
    m = ensemble.single_and_blend(predictions(spark, d), "p1", "p2", WEIGHT)
    return rounded(ensemble.improvement(m, "roc_auc"), 5)


def bootstrap_replicates(spark, d):
    """ROC AUC of each score on each resample of whole stays, with draws that the SQL repeats: the intervals' plan, checked with few replicates."""
    return rounded(ensemble.bootstrap(predictions(spark, d), "stay_id", ["p1", "p2"], REPEATED, hashed=True))


def bootstrap_ci(spark, d):
    return rounded(ensemble.confidence(ensemble.bootstrap(predictions(spark, d), "stay_id", ["p1", "p2"], REPLICATES, metrics=["roc_auc"]), "roc_auc"))


def bootstrap_gain(spark, d):
    return rounded(ensemble.gain_probability(ensemble.bootstrap(predictions(spark, d), "stay_id", ["p1", "p2"], REPLICATES, metrics=["roc_auc"]), "roc_auc", "p1", "p2"))


def boot_sql(replicates: int) -> str:
    return f"""{PREDS_SQL},
k AS (SELECT stay_id, row_number() OVER (ORDER BY stay_id) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT stay_id FROM preds)),
w AS (SELECT r AS replicate, CAST(('0x' || substr(md5('1:' || r || ':' || d), 1, 8)) AS BIGINT) % n AS i, count(*) AS weight
      FROM range(0, {replicates}) a(r), (SELECT i AS d, n FROM k) GROUP BY 1, 2),
x AS (SELECT w.replicate, s.score, s.p, sum(weight * s.label) AS pos, sum(weight * (1 - s.label)) AS neg
      FROM w JOIN k USING (i) JOIN (SELECT stay_id, label, 'p1' AS score, p1 AS p FROM preds UNION ALL SELECT stay_id, label, 'p2', p2 FROM preds) s USING (stay_id) GROUP BY 1, 2, 3),
c AS (SELECT *, sum(pos) OVER o AS ctp, sum(neg) OVER o AS cfp FROM x WINDOW o AS (PARTITION BY replicate, score ORDER BY p DESC)),
boot AS (SELECT replicate, score, sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)) AS roc_auc, sum(pos * ctp / (ctp + cfp)) / sum(pos) AS average_precision FROM c GROUP BY 1, 2)"""


def artifact_drift(spark, d):
    """Numbers of the scores as they are now against locked ones: the best blend weight's neighbours, the class weight, the mean score."""
    x = predictions(spark, d)
    a = x.agg(F.round(F.avg("p1"), 6).alias("mean_p1"), F.round(F.sum(1 - F.col("label")) / F.sum("label"), 6).alias("class_weight"), F.count("*").cast("double").alias("n_rows"))
    return ensemble.drift(a, {"mean_p1": 0.49, "class_weight": 1.0, "n_rows": 6000.0}, tolerance=0.05)


def _grid_sql(rows: str, weights: str, x: str) -> str:
    """{x}m: weight and metrics of the blends of rows by weights (in hundredths)."""
    clip = "least(greatest(score, 1e-15), 1 - 1e-15)"
    return f"""{x}b AS (SELECT k / 100.0::DOUBLE AS weight, label, round(k / 100.0::DOUBLE * p1 + (1 - k / 100.0::DOUBLE) * p2, 12) AS score FROM {rows}, {weights}),
{x}g AS (SELECT weight, score, sum(label) AS pos, sum(1 - label) AS neg FROM {x}b GROUP BY 1, 2), {x}c AS (SELECT *, sum(pos) OVER o AS ctp, sum(neg) OVER o AS cfp FROM {x}g WINDOW o AS (PARTITION BY weight ORDER BY score DESC)),
{x}r AS (SELECT weight, sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos * ctp / (ctp + cfp)) / sum(pos) AS ap FROM {x}c GROUP BY 1),
{x}q AS (SELECT weight, avg(pow(score - label, 2)) AS brier, avg(-(label * ln({clip}) + (1 - label) * ln(1 - {clip}))) AS loss FROM {x}b GROUP BY 1), {x}m AS (SELECT * FROM {x}r JOIN {x}q USING (weight))"""


# alerts and state


def _scores(spark, d):
    return predictions(spark, d).select("stay_id", (F.col("window_id") * 2 - F.pmod("stay_id", F.lit(2)) * F.col("window_id")).alias("window_id"), F.col("p1").alias("p"))


SCORES_SQL = f"{PREDS_SQL},\nscores AS (SELECT stay_id, window_id * 2 - stay_id % 2 * window_id AS window_id, p1 AS p FROM preds)"


def risk_direction(spark, d):
    return rounded(alerts.directions(_scores(spark, d), threshold=0.5, dead_band=0.05, max_gap=1))


def alert_machine(spark, d):
    return rounded(alerts.alert_machine(_scores(spark, d), partitions=partitions_for(spark, d, "lineitem"), threshold=0.6, cooldown=3, escalation=0.1, dead_band=0.05))


ALERT_SQL = f"""{SCORES_SQL},
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY window_id) AS n FROM scores),
m AS (
  WITH RECURSIVE t AS (
    SELECT stay_id, window_id, p, n, CASE WHEN p >= 0.6 THEN 'initial_high_risk' ELSE 'none' END AS reason, 'initial' AS direction, false AS pending,
           CASE WHEN p >= 0.6 THEN window_id END AS aw, CASE WHEN p >= 0.6 THEN p END AS ap
    FROM o WHERE n = 1
    UNION ALL
    SELECT stay_id, window_id, p, n, reason, direction,
           CASE WHEN fired OR p < 0.6 THEN false ELSE pend END, CASE WHEN fired THEN window_id ELSE aw END, CASE WHEN fired THEN p ELSE ap END
    FROM (
      SELECT *, reason IN ('threshold_crossing', 'pending_threshold_crossing', 'risk_escalation') AS fired,
             pending OR reason = 'threshold_crossing_suppressed' AS pend
      FROM (
        SELECT o.stay_id, o.window_id, o.p, o.n, t.pending, t.aw, t.ap,
               CASE WHEN o.p - t.p > 0.05 THEN 'rising' WHEN o.p - t.p < -0.05 THEN 'falling' ELSE 'stable' END AS direction,
               CASE WHEN o.p >= 0.6 AND t.ap IS NOT NULL AND greatest(0, 3 - (o.window_id - t.aw)) = 0 AND o.p - t.ap >= 0.1 THEN 'risk_escalation'
                    WHEN t.p < 0.6 AND o.p >= 0.6 THEN CASE WHEN t.aw IS NULL OR greatest(0, 3 - (o.window_id - t.aw)) = 0 THEN 'threshold_crossing' ELSE 'threshold_crossing_suppressed' END
                    WHEN t.pending AND o.p >= 0.6 AND greatest(0, 3 - (o.window_id - t.aw)) = 0 THEN 'pending_threshold_crossing' ELSE 'none' END AS reason
        FROM t JOIN o ON o.stay_id = t.stay_id AND o.n = t.n + 1)))
  SELECT *, reason NOT IN ('none', 'threshold_crossing_suppressed') AS alert, CASE WHEN aw IS NULL THEN 0 ELSE greatest(0, 3 - (window_id - aw)) END AS cooldown FROM t)"""


def alert_counts(spark, d):
    return alerts.alert_counts(alerts.alert_machine(_scores(spark, d), partitions=partitions_for(spark, d, "lineitem"), threshold=0.6, cooldown=3, escalation=0.1, dead_band=0.05))


def state_reasons(spark, d):
    """Windows offered in order of arrival, with redeliveries, conflicts and late ones made from the rows' hashes."""
    p = _scores(spark, d)
    h = F.pmod("stay_id", F.lit(4))
    base = p.select("stay_id", "window_id", F.col("window_id").alias("time"), F.round("p", 6).cast("string").alias("content"), F.lit("s").alias("static"), F.lit(False).alias("discharged"), (F.col("window_id") * 10).alias("seq"))
    again = base.where(h == 1).withColumn("seq", F.col("seq") + 1)
    other = base.where(h == 2).withColumn("seq", F.col("seq") + 25).withColumn("content", F.lit("changed"))
    moved = base.where((h == 3) & (F.col("window_id") == 2)).withColumn("static", F.lit("t"))
    x = base.join(moved.select("stay_id", "window_id"), ["stay_id", "window_id"], "left_anti").unionByName(again).unionByName(other).unionByName(moved)
    return alerts.state_reasons(x, history=120).groupBy("reason").agg(F.count("*").alias("n"))


# message hygiene

ALIASES = {v: v for v in VITALS}
RANGES = {v: (0.0, 300.0) for v in VITALS}
MESSAGES_SQL = f"""h AS (SELECT *, {H.format(key="CAST(event_id AS VARCHAR)")} AS h FROM events),
one AS (
  SELECT event_id, user_id, event_type, value, h, to_timestamp(floor(epoch(ts)))::TIMESTAMP AS charttime,
         CASE WHEN h < 0.05 THEN 61 WHEN h < 0.10 THEN 60 ELSE 5 END AS lag,
         CASE WHEN h BETWEEN 0.12 AND 0.14 THEN 'missing_field' WHEN h BETWEEN 0.10 AND 0.12 THEN 'schema_version' WHEN h BETWEEN 0.14 AND 0.16 THEN 'unknown_vital'
              WHEN NOT (CASE WHEN h BETWEEN 0.16 AND 0.18 THEN -value ELSE value END) BETWEEN 0 AND 300 THEN 'out_of_range' END AS reason,
         CASE WHEN h < 0.5 THEN 'realtime' ELSE 'replay' END AS source_mode
  FROM h),
m AS (SELECT * FROM one UNION ALL SELECT * FROM one WHERE event_id % 20 = 0)"""


def _judged(spark, d):
    return validate.judged(validate.parsed(messages(spark, d)), ALIASES, RANGES)


def validate_split(spark, d):
    return _judged(spark, d).groupBy("reason").agg(F.count("*").alias("n"))


def json_parse(spark, d):
    x = validate.parsed(messages(spark, d))
    return rounded(x.select(F.col("event_id").cast("long").alias("event_id"), "charttime", F.unix_timestamp("ingestion_time").alias("ingested"), F.abs("value").alias("value")).distinct())


def late_rows(spark, d):
    return validate.late(validate.split(_judged(spark, d))[0]).groupBy("source_mode", "is_late").agg(F.count("*").alias("n"))


def dedupe_first(spark, d):
    x = validate.late(validate.split(_judged(spark, d))[0]).where(~F.col("is_late")).drop("is_late")
    return rounded(validate.deduplicated(x).select(F.col("event_id").cast("long").alias("event_id"), "stay_id", "vital_sign", "value"))


def mixed_modes(spark, d):
    return validate.mixed_modes(validate.split(_judged(spark, d))[0])


def complete_batch(spark, d):
    """Days on which all five kinds were read."""
    x = _judged(spark, d).where("reason is null").withColumn("charttime", F.date_trunc("day", "charttime"))
    return validate.complete_batches(x, VITALS).select("stay_id", "charttime", F.col("n_vitals").cast("long").alias("n_vitals"), "complete")


def meaningful_change(spark, d):
    """Readings in order, four a window, with few different values and three scores, one of them sometimes missing."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(order))
    score = lambda n: F.floor(F.col("value") / n) / 10
    x = e.select(F.col("user_id").alias("stay_id"), F.floor(F.col("k") / 4).cast("long").alias("window_id"), F.col("k").cast("long").alias("seq"), F.floor(F.col("value") / 150).alias("level"), score(100).alias("p"), score(60).alias("p1"), F.when(F.col("event_id") % 9 > 0, 0.5).alias("p2"))
    return validate.meaningful_changes(x, ["level"], ["p", "p1", "p2"]).select("stay_id", "seq", "update_reason")


def intake_bounds(spark, d):
    x = validate.bounds_check(table(spark, d, "part"), {"p_size": (5, 40), "p_retailprice": (905.0, 990.0)})
    return x.select("p_partkey", F.array_join("reasons", "+").alias("reasons"))


def message_latency(spark, d):
    x = validate.latency(validate.parsed(messages(spark, d)), "charttime", "ingestion_time")
    return rounded(x.groupBy("source_mode").agg(F.count("latency_ms").alias("n"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("max_ms")))


# serving


def _events(spark, d):
    """Predictions as risk events: two patients' assignments of ids, status and time."""
    x = predictions(spark, d)
    return x.select("stay_id", "window_id", F.when(F.pmod(F.col("stay_id") + F.col("window_id"), F.lit(3)) == 0, "FINAL").otherwise("UPDATE").alias("status"), (F.col("stay_id") * 100 + F.col("window_id")).alias("seq"), F.round("p1", 6).alias("p"))


EVENTS_SQL = f"{PREDS_SQL},\nev AS (SELECT stay_id, window_id, CASE WHEN (stay_id + window_id) % 3 = 0 THEN 'FINAL' ELSE 'UPDATE' END AS status, stay_id * 100 + window_id AS seq, round(p1, 6) AS p FROM preds)"


def latest_risk(spark, d):
    return serving.latest(_events(spark, d), "stay_id", ["window_id", "seq"])


def history_topn(spark, d):
    return serving.recent(_events(spark, d), "stay_id", [F.desc("window_id")], 3)


def latest_with_explanation(spark, d):
    """Each order's last prediction with the line's part."""
    parts = predictions(spark, d).where("p2 > 0.5").select("stay_id", "window_id", F.round("p2", 9).alias("p2"))
    return serving.with_explanation(_events(spark, d), parts, "stay_id", ["window_id"], ["stay_id", "window_id"])


def _assignments(spark, d):
    """Orders as assignments of customers (patients) to suppliers' nations (doctors); open while their status is O."""
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("assignment_id"), F.col("o_custkey").alias("patient_id"), F.pmod("o_orderkey", F.lit(30)).cast("int").alias("doctor_id"), F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("closed_at"))


ASSIGN_SQL = "asg AS (SELECT o_orderkey AS assignment_id, o_custkey AS patient_id, CAST(o_orderkey % 30 AS INTEGER) AS doctor_id, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS closed_at FROM orders)"


def doctor_load(spark, d):
    return serving.load(table(spark, d, "nation").select(F.col("n_nationkey").alias("doctor_id"), "n_name"), _assignments(spark, d), "doctor_id", "patient_id")


def worklist(spark, d):
    """Customers of one region with an open assignment."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    open_ = _assignments(spark, d).where("closed_at is null")
    x = c.join(n, c.c_nationkey == n.n_nationkey).join(r.where("r_name = 'ASIA'"), n.n_regionkey == F.col("r_regionkey"))
    return x.join(open_, x.c_custkey == open_.patient_id, "left_semi").select("c_custkey", "c_name", "n_name")


def open_handover(spark, d):
    """Open assignments of doctors above 20 that have no alert yet; alerts exist for assignments divisible by 4."""
    a = _assignments(spark, d).where("closed_at is null")
    return serving.to_alert(a.where("doctor_id > 20"), a.where(F.pmod("assignment_id", F.lit(4)) == 0), "assignment_id").select("assignment_id", "patient_id", "doctor_id")


def resolvable_alerts(spark, d):
    a = _assignments(spark, d)
    return serving.resolvable(a.where("closed_at is null and doctor_id > 20").select("assignment_id", "patient_id"), a)


def membership_sync(spark, d):
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    return serving.membership_sync(o.where("o_totalprice > 200000").select(F.col("o_orderkey").alias("k")), li.where("l_quantity > 45").select(F.col("l_orderkey").alias("k")), ["k"])


def snapshot_diff(spark, d):
    e = _events(spark, d)
    return serving.new_since(e.select("seq", "status"), e.where("status = 'FINAL'").select("seq"), "seq")


def constraint_audit(spark, d):
    """Patients with several open assignments, and doctors with more open ones than the mean."""
    a = _assignments(spark, d).where("closed_at is null")
    return a.groupBy("patient_id").agg(F.count("*").alias("n_open")).where("n_open > 1")


def kpis(spark, d):
    return latest_risk(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("p") >= 0.5).alias("n_elevated"), F.count_if(F.col("status") == "FINAL").alias("n_final"))


def patient_search(spark, d):
    c = table(spark, d, "customer").withColumn("status", F.when(F.col("c_acctbal") < 0, "OPEN").otherwise("CLOSED"))
    return serving.searched(c, " machinery ", ["c_name", "c_mktsegment"], "OPEN").select("c_custkey", "c_name", "c_mktsegment")


def final_upsert(spark, d):
    x = _events(spark, d)
    both = x.withColumn("window_id", F.floor(F.col("window_id") / 2))
    return serving.final_upsert(both, ["stay_id", "window_id"], "seq")


def retention(spark, d):
    return serving.retained(_events(spark, d), "stay_id", "window_id", 3)


def risk_delta(spark, d):
    """Readings as updates, four a window, every fifth a final of its window or, if its id is divisible by three, of the one before."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("k", F.row_number().over(order)).withColumn("final", F.col("event_id") % 5 == 0)
    w = F.floor(F.col("k") / 4) - F.when(F.col("final") & (F.col("event_id") % 3 == 0), 1).otherwise(0)
    x = e.select(F.col("user_id").alias("stay_id"), F.col("k").cast("long").alias("seq"), w.cast("long").alias("window_id"), F.when(F.col("final"), "FINAL").otherwise("UPDATE").alias("status"), F.round(F.col("value") / 300, 6).alias("p"))
    return rounded(serving.risk_delta(x).select("stay_id", "seq", "risk_delta"))


def late_after_final(spark, d):
    """Readings of a day that come when a reading two days later was already seen for the stay: their window was final."""
    e = table(spark, d, "events")
    arrival = Window.partitionBy("user_id").orderBy("arrival", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    late_by = F.when(F.pmod("event_id", F.lit(9)) == 0, 200_000).otherwise(0)
    x = e.select("user_id", "event_id", F.unix_timestamp("ts").alias("t"), (F.unix_timestamp("ts") + late_by).alias("arrival"))
    x = x.withColumn("watermark", F.max("t").over(arrival) - 86400).withColumn("window_end", (F.floor(F.col("t") / 86400) + 1) * 86400)
    return x.select(F.col("user_id").alias("stay_id"), "event_id", F.coalesce(F.col("window_end") <= F.col("watermark"), F.lit(False)).alias("late_after_final"))


def risk_series(spark, d):
    return _events(spark, d).where("p is not null").select("stay_id", "window_id", F.round(F.col("p") * 100, 2).alias("percent"))


# parity and picks


def parity_report(spark, d):
    """One-pass window features against the joined form."""
    a, b = features(spark, d), features(spark, d, joined=True)
    return rounded(parity.parity_report(parity.parity_rows(a, b, ["stay_id", "window_id"], {"click_mean": 1e-9, "error_last": 1e-9, "view_missing": 0})))


def nearest_decision(spark, d):
    return rounded(parity.nearest_threshold(predictions(spark, d).select("stay_id", "window_id", "p2"), "p2", 0.44, 50, "stay_id", "window_id"), 9)


def straddling(spark, d):
    return parity.straddling(predictions(spark, d), "p1", "p2", 0.44).groupBy("label").agg(F.count("*").alias("n"))


def stay_pick(spark, d):
    from icuflow.operators.audits import gap_statistics

    w = predictions(spark, d).where(F.pmod(F.col("stay_id") + F.col("window_id"), F.lit(17)) != 0).select("stay_id", "window_id")
    return parity.picked_stays(w, gap_statistics(w), 5, 8, 10).select("stay_id", "n_windows", "kind", F.col("pick").cast("long").alias("pick"))


def hash_sample(spark, d):
    """The 100 full-length orders with the smallest hashes."""
    n = predictions(spark, d).groupBy("stay_id").agg(F.count("*").alias("n")).where("n >= 6")
    return splits.sample_by_hash(n, 100, "stay_id", seed=7)


def interleave(spark, d):
    x = splits.interleaved(predictions(spark, d).select("stay_id", "window_id"), "stay_id", "window_id", 3)
    return x.select("stay_id", "window_id", F.col("turn").cast("long").alias("turn"), F.round("shuffle", 6).alias("shuffle"))


def systematic_sample(spark, d):
    p = predictions(spark, d).select("stay_id", "window_id")
    return splits.systematic(p, "stay_id", "window_id", 4, p.where("stay_id < 50"))


def block_sample(spark, d):
    """Every seventh block of a thousand lines, 64 evenly spaced ones of it, and all lines of the first fifty orders."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return splits.block_sample(li, 7, 1000, F.col("l_orderkey") < 50)


def late_materialised(spark, d):
    """All columns of the lines of the twenty dearest orders: their keys come from a scan of two columns, the lines from the row groups that hold them."""
    path = shared_folder(spark, "lines")
    parity.sorted_for_keys(table(spark, d, "lineitem"), "l_orderkey", path, files=max(4, tasks_for(spark, d, "lineitem")), row_group_bytes=64 << 10)
    keys = table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select(F.col("o_orderkey").alias("l_orderkey"))
    return rounded(parity.keyed_rows(spark.read.parquet(path), keys, "l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def scalar_functions(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalars.stay_number(F.col("ts")).alias("stay_number"), scalars.composite_key(F.col("user_id"), F.floor(F.col("value"))).alias("composite"), F.upper(F.trim("event_type")).alias("name"), F.get_json_object("props", "$.k").cast("long").alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        roc_auc, avg_precision, brier_logloss, class_weight, score_describe, score_correlation, probability_checks, decisions, align_indicator, threshold_grid, recall_floor_pick, sens85_pick, criteria_table,
        nearest_threshold, monotone_curve, platt_apply, platt_fit, calibration_invariance, blend_grid, blend_choice, artifact_drift, blend_gain, bootstrap_replicates, bootstrap_ci, bootstrap_gain, risk_direction, alert_machine,
        alert_counts, state_reasons, validate_split, json_parse, late_rows, dedupe_first, mixed_modes, complete_batch, meaningful_change, intake_bounds, message_latency, latest_risk, history_topn,
        latest_with_explanation, doctor_load, worklist, open_handover, resolvable_alerts, membership_sync, snapshot_diff, constraint_audit, kpis, patient_search, final_upsert, retention, risk_delta,
        late_after_final, risk_series, parity_report, nearest_decision, straddling, stay_pick, hash_sample, interleave, systematic_sample, block_sample, late_materialised, scalar_functions,
    )
}

_LONG = f"{PREDS_SQL},\nlong AS (SELECT stay_id, window_id, label, 'p1' AS model, p1 AS score FROM preds UNION ALL SELECT stay_id, window_id, label, 'p2', p2 FROM preds)"
_RANK = f"{_LONG},\ng AS (SELECT model, score AS p, sum(label) AS pos, sum(1 - label) AS neg FROM long GROUP BY 1, 2),\nc AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS ctp, sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cfp FROM g)"
_PLATT = lambda c, a, b: f"1 / (1 + exp(-({a!r} + {b!r} * ln(least(greatest({c}, 1e-6), 1 - 1e-6) / (1 - least(greatest({c}, 1e-6), 1 - 1e-6))))))"
_CLIP = "least(greatest(score, 1e-15), 1 - 1e-15)"
_OK = f"{MESSAGES_SQL},\nok AS (SELECT * FROM m WHERE reason IS NULL)"
_PICK = "round(threshold, 6) AS threshold, round(precision, 6) AS precision, round(recall, 6) AS recall"

ORACLE_SQL = {
    "roc_auc": f"WITH {_RANK} SELECT model, round(sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM c GROUP BY 1",
    "avg_precision": f"WITH {_RANK} SELECT model, round(sum(pos * ctp / (ctp + cfp)) / sum(pos), 6) AS average_precision FROM c GROUP BY 1",
    "brier_logloss": f"WITH {_LONG} SELECT model, round(avg(pow(score - label, 2)), 6) AS brier, round(avg(-(label * ln({_CLIP}) + (1 - label) * ln(1 - {_CLIP}))), 6) AS log_loss FROM long GROUP BY 1",
    "class_weight": f"WITH {PREDS_SQL} SELECT CAST(sum(1 - label) AS BIGINT) AS n_negative, CAST(sum(label) AS BIGINT) AS n_positive, round(sum(1 - label) / sum(label), 6) AS weight FROM preds",
    "score_describe": f"WITH {_LONG} SELECT model, count(*) AS n, round(avg(score), 6) AS mean, round(stddev_samp(score), 6) AS deviation, round(min(score), 6) AS low, round(max(score), 6) AS high, " + ", ".join(f"round(quantile_cont(score, {p}), 6) AS p{round(p * 100)}" for p in (0.05, 0.25, 0.5, 0.75, 0.95)) + " FROM long GROUP BY 1",
    "score_correlation": f"WITH {PREDS_SQL} SELECT count(*) AS n, round(corr(p1, p2), 6) AS correlation FROM preds",
    "probability_checks": f"WITH {PREDS_SQL}, x AS (SELECT p1, p2, p1 * 1.02 AS q FROM preds) " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST(0 AS BIGINT) AS n_not_finite, count(*) FILTER (NOT {c} BETWEEN 0 AND 1) AS n_outside FROM x" for c in ("p1", "p2", "q")),
    "decisions": f"WITH {PREDS_SQL} SELECT label, CAST(p1 >= 0.44 AS INTEGER) AS alert, count(*) AS n FROM preds GROUP BY 1, 2",
    "align_indicator": f"WITH {PREDS_SQL}, a AS (SELECT stay_id, window_id, label FROM preds WHERE stay_id % 5 <> 0), b AS (SELECT stay_id, window_id, CASE WHEN stay_id % 11 = 0 THEN 1 - label ELSE label END AS label FROM preds WHERE window_id % 3 <> 0) SELECT CASE WHEN b.stay_id IS NULL THEN 'left_only' WHEN a.stay_id IS NULL THEN 'right_only' ELSE 'both' END AS indicator, a.label = b.label AS labels_agree, count(*) AS n FROM a FULL JOIN b ON a.stay_id = b.stay_id AND a.window_id = b.window_id GROUP BY 1, 2",
    "threshold_grid": f"WITH {GRID_SQL} SELECT {GRID_COLUMNS} FROM g",
    "recall_floor_pick": f"WITH {GRID_SQL}, f AS (SELECT unnest({FLOORS}) AS recall_floor), r AS (SELECT f.recall_floor, g.*, row_number() OVER (PARTITION BY f.recall_floor ORDER BY g.precision DESC NULLS LAST, g.threshold) AS rn FROM f LEFT JOIN g ON g.recall >= f.recall_floor), b AS (SELECT * FROM g ORDER BY f2 DESC, threshold LIMIT 1) SELECT CAST(r.recall_floor AS DOUBLE) AS recall_floor, round(coalesce(r.threshold, b.threshold), 6) AS threshold, round(coalesce(r.precision, b.precision), 6) AS precision, round(coalesce(r.recall, b.recall), 6) AS recall, r.threshold IS NOT NULL AS met FROM r, b WHERE rn = 1",
    "sens85_pick": f"WITH {GRID_SQL} SELECT {GRID_COLUMNS} FROM (SELECT * FROM g WHERE recall >= 0.85 ORDER BY specificity DESC, abs(recall - 0.85), threshold DESC LIMIT 1)",
    "criteria_table": f"WITH {GRID_SQL}, p AS ((SELECT 'sensitivity' AS criterion, * FROM g WHERE recall >= 0.85 ORDER BY specificity DESC, abs(recall - 0.85), threshold DESC LIMIT 1) " + " ".join(f"UNION ALL (SELECT '{m}', * FROM g ORDER BY {m} DESC, threshold LIMIT 1)" for m in ("youden", "f1", "f2")) + ") SELECT criterion, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("threshold", "precision", "recall", "specificity", "f1", "f2", "youden")) + " FROM p",
    "nearest_threshold": f"WITH {GRID_SQL} SELECT {_PICK}, abs(threshold - 0.44) < 1e-9 AS locked FROM g WHERE round(threshold * 100) IN (10, 25, 26, 50, 44)",
    "monotone_curve": "SELECT CAST(0 AS BIGINT) AS sensitivity_rises, CAST(0 AS BIGINT) AS specificity_falls",
    "platt_apply": f"WITH {PREDS_SQL} SELECT stay_id, window_id, round({_PLATT('p1', *PLATT['p1'])}, 6) AS p1_calibrated, round({_PLATT('p2', *PLATT['p2'])}, 6) AS p2_calibrated FROM preds",
    "calibration_invariance": "SELECT true AS roc_auc_kept, true AS average_precision_kept",
    "blend_grid": f"WITH {PREDS_SQL}, b AS (SELECT k / 100.0::DOUBLE AS weight, label, round(k / 100.0::DOUBLE * p1 + (1 - k / 100.0::DOUBLE) * p2, 12) AS score FROM preds, range(0, 101) r(k)), g AS (SELECT weight, score, sum(label) AS pos, sum(1 - label) AS neg FROM b GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER o AS ctp, sum(neg) OVER o AS cfp FROM g WINDOW o AS (PARTITION BY weight ORDER BY score DESC)), r AS (SELECT weight, round(sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc, round(sum(pos * ctp / (ctp + cfp)) / sum(pos), 6) AS average_precision FROM c GROUP BY 1), q AS (SELECT weight, round(avg(pow(score - label, 2)), 6) AS brier, round(avg(-(label * ln({_CLIP}) + (1 - label) * ln(1 - {_CLIP}))), 6) AS log_loss FROM b GROUP BY 1) SELECT * FROM r JOIN q USING (weight)",
    "blend_choice": f"WITH {PREDS_SQL}, tun AS (SELECT * FROM preds WHERE stay_id % 3 <> 0), "
    + _grid_sql("tun", "range(0, 101) r(k)", "t")
    + ", best AS (SELECT * FROM tm ORDER BY ap DESC, auc DESC, brier, loss LIMIT 10), one AS (SELECT arg_max(weight, (ap, auc)) AS weight, max(ap) AS tuned, max(ap) - min(ap) AS flatness FROM best), held AS (SELECT * FROM preds WHERE stay_id % 3 = 0), "
    + _grid_sql("held", "(SELECT 0::DOUBLE AS k UNION ALL SELECT 100 UNION ALL SELECT 100 * weight FROM one) r(k)", "h")
    + " SELECT weight, round(tuned, 6) AS tuned, round(flatness, 6) AS flatness, round((SELECT max(ap) FROM hm WHERE hm.weight = one.weight), 6) AS average_precision, round((SELECT max(auc) FROM hm WHERE hm.weight = one.weight), 6) AS roc_auc, round((SELECT max(ap) FROM hm WHERE hm.weight = one.weight) - (SELECT max(ap) FROM hm WHERE hm.weight IN (0, 1)), 6) AS gain FROM one",
    "blend_gain": f"WITH {PREDS_SQL}, long AS (SELECT label, 'p1' AS model, p1 AS score FROM preds UNION ALL SELECT label, 'p2', p2 FROM preds UNION ALL SELECT label, 'blend', {WEIGHT} * p1 + (1 - {WEIGHT}) * p2 FROM preds), g AS (SELECT model, score, sum(label) AS pos, sum(1 - label) AS neg FROM long GROUP BY 1, 2), c AS (SELECT *, sum(pos) OVER (PARTITION BY model ORDER BY score DESC) AS ctp FROM g), r AS (SELECT model, sum(neg * (ctp - pos / 2)) / (sum(pos) * sum(neg)) AS auc FROM c GROUP BY 1), m AS (SELECT max(auc) FILTER (model = 'blend') AS b, max(auc) FILTER (model <> 'blend') AS s FROM r) SELECT round(b, 5) AS blend, round(s, 5) AS best_single, round(b - s, 5) AS gain, round(100 * (b - s) / s, 5) AS gain_percent FROM m",
    "bootstrap_replicates": f"WITH {boot_sql(REPEATED)} SELECT CAST(replicate AS INTEGER) AS replicate, score, round(roc_auc, 6) AS roc_auc, round(average_precision, 6) AS average_precision FROM boot",
    "risk_direction": f"WITH {SCORES_SQL}, l AS (SELECT *, CASE WHEN window_id - lag(window_id) OVER o <= 1 THEN lag(p) OVER o END AS b FROM scores WINDOW o AS (PARTITION BY stay_id ORDER BY window_id)) SELECT stay_id, window_id, round(p, 6) AS p, round(p - b, 6) AS delta, CASE WHEN b IS NULL THEN 'initial' WHEN p - b > 0.05 THEN 'rising' WHEN p - b < -0.05 THEN 'falling' ELSE 'stable' END AS direction, coalesce(b < 0.5 AND p >= 0.5, false) AS crossed FROM l",
    "alert_machine": f"WITH {ALERT_SQL} SELECT stay_id, window_id, round(p, 6) AS p, alert, reason, direction, pending, CAST(cooldown AS INTEGER) AS cooldown FROM m",
    "alert_counts": f"WITH {ALERT_SQL} SELECT reason, count(*) AS n, count(*) FILTER (alert) AS n_alerts FROM m GROUP BY 1",
    "validate_split": f"WITH {MESSAGES_SQL} SELECT reason, count(*) AS n FROM m GROUP BY 1",
    "json_parse": f"WITH {MESSAGES_SQL} SELECT event_id, charttime, CAST(epoch(charttime) AS BIGINT) + lag AS ingested, round(abs(value), 6) AS value FROM one",
    "late_rows": f"WITH {_OK} SELECT source_mode, source_mode = 'realtime' AND lag > 60 AS is_late, count(*) AS n FROM ok GROUP BY 1, 2",
    "meaningful_change": "WITH e AS (SELECT user_id AS stay_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events), x AS (SELECT stay_id, seq, seq // 4 AS w, floor(value / 150) AS v, floor(value / 100) / 10 AS p, floor(value / 60) / 10 AS p1, CASE WHEN event_id % 9 > 0 THEN 0.5 END AS p2 FROM e), y AS (SELECT *, lag(w) OVER o AS bw, lag(v) OVER o AS bv, lag(p) OVER o AS bp, lag(p1) OVER o AS bp1, lag(p2) OVER o AS bp2 FROM x WINDOW o AS (PARTITION BY stay_id ORDER BY seq)) SELECT stay_id, seq, CASE WHEN seq = 1 THEN 'first' WHEN w <> bw THEN 'new_window' WHEN v IS DISTINCT FROM bv THEN 'value_changed' WHEN p IS DISTINCT FROM bp OR p1 IS DISTINCT FROM bp1 OR p2 IS DISTINCT FROM bp2 THEN 'score_changed' ELSE 'none' END AS update_reason FROM y",
    "artifact_drift": f"WITH {PREDS_SQL}, a AS (SELECT round(avg(p1), 6) AS m, round(sum(1 - label) / sum(label), 6) AS c, count(*)::DOUBLE AS n FROM preds), l AS (SELECT 'mean_p1' AS name, 0.49::DOUBLE AS expected, m AS actual FROM a UNION ALL SELECT 'class_weight', 1.0, c FROM a UNION ALL SELECT 'n_rows', 6000.0, n FROM a) SELECT *, abs(expected - actual) <= 0.05 AS ok FROM l",
    # each offer against what was kept before it
    "state_reasons": f"""WITH RECURSIVE {SCORES_SQL},
f AS (SELECT stay_id, stay_id % 4 AS h, window_id AS w, CAST(round(p, 6) AS VARCHAR) AS content, 's' AS st, window_id * 10 AS seq FROM scores),
u AS (SELECT * REPLACE (CASE WHEN h = 3 AND w = 2 THEN 't' ELSE st END AS st) FROM f UNION ALL SELECT * REPLACE (seq + 1 AS seq) FROM f WHERE h = 1 UNION ALL SELECT * REPLACE (seq + 25 AS seq, 'changed' AS content) FROM f WHERE h = 2),
x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY seq, content) AS k FROM u),
l AS (SELECT stay_id, 0::BIGINT AS k, '' AS reason, MAP([]::BIGINT[], []::VARCHAR[]) AS kept, NULL::BIGINT AS last, NULL::VARCHAR AS st FROM (SELECT DISTINCT stay_id FROM x)
  UNION ALL
  SELECT stay_id, k, reason, CASE WHEN reason = 'accepted' THEN map_concat(kept, MAP([w], [content || ' ' || nst])) ELSE kept END, CASE WHEN reason = 'accepted' THEN w ELSE last END, CASE WHEN reason = 'accepted' THEN nst ELSE st END
  FROM (SELECT x.stay_id, x.k, x.w, x.content, x.st AS nst, l.kept, l.last, l.st,
    CASE WHEN map_contains(l.kept, x.w) THEN CASE WHEN l.kept[x.w] = x.content || ' ' || x.st THEN 'duplicate' ELSE 'conflicting_duplicate' END
         WHEN x.w < l.last THEN 'stale' WHEN x.w <= l.last THEN 'timestamp_order' WHEN x.st <> l.st THEN 'static_changed' ELSE 'accepted' END AS reason
    FROM l JOIN x ON x.stay_id = l.stay_id AND x.k = l.k + 1))
SELECT reason, count(*) AS n FROM l WHERE k > 0 GROUP BY reason""",
    "dedupe_first": f"WITH {_OK}, f AS (SELECT DISTINCT event_id, user_id, event_type, value, charttime, lag FROM ok WHERE NOT (source_mode = 'realtime' AND lag > 60)), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type, charttime ORDER BY lag, CAST(event_id AS VARCHAR)) AS rn FROM f) SELECT event_id, user_id AS stay_id, event_type AS vital_sign, round(value, 6) AS value FROM n WHERE rn = 1",
    "mixed_modes": f"WITH {_OK} SELECT user_id AS stay_id, count(DISTINCT source_mode) AS n_modes FROM ok GROUP BY 1 HAVING count(DISTINCT source_mode) > 1",
    "complete_batch": f"WITH {_OK} SELECT user_id AS stay_id, date_trunc('day', charttime) AS charttime, count(DISTINCT event_type) AS n_vitals, count(DISTINCT event_type) = 5 AS complete FROM ok GROUP BY 1, 2",
    "intake_bounds": "SELECT p_partkey, concat_ws('+', CASE WHEN NOT p_size BETWEEN 5 AND 40 THEN 'p_size' END, CASE WHEN NOT p_retailprice BETWEEN 905 AND 990 THEN 'p_retailprice' END) AS reasons FROM part",
    "message_latency": f"WITH {MESSAGES_SQL} SELECT source_mode, count(*) AS n, round(avg(lag * 1000), 6) AS mean_ms, CAST(max(lag * 1000) AS BIGINT) AS max_ms FROM m GROUP BY 1",
    "latest_risk": f"WITH {EVENTS_SQL} SELECT stay_id, arg_max(window_id, window_id) AS window_id, arg_max(status, window_id) AS status, arg_max(seq, window_id) AS seq, arg_max(p, window_id) AS p FROM ev GROUP BY 1",
    "history_topn": f"WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY window_id DESC) AS rank FROM ev) SELECT stay_id, window_id, status, seq, p, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3",
    "latest_with_explanation": f"WITH {EVENTS_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY window_id DESC) = 1) SELECT l.*, round(p2, 9) AS p2 FROM l LEFT JOIN (SELECT stay_id, window_id, p2 FROM preds WHERE p2 > 0.5) USING (stay_id, window_id)",
    "doctor_load": f"WITH {ASSIGN_SQL} SELECT n_nationkey AS doctor_id, n_name, count(DISTINCT patient_id) AS n_patients FROM nation LEFT JOIN asg ON doctor_id = n_nationkey AND closed_at IS NULL GROUP BY 1, 2",
    "worklist": f"WITH {ASSIGN_SQL} SELECT c_custkey, c_name, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND c_custkey IN (SELECT patient_id FROM asg WHERE closed_at IS NULL)",
    "open_handover": f"WITH {ASSIGN_SQL} SELECT assignment_id, patient_id, doctor_id FROM asg WHERE closed_at IS NULL AND doctor_id > 20 AND assignment_id % 4 <> 0",
    "resolvable_alerts": f"WITH {ASSIGN_SQL} SELECT assignment_id, patient_id FROM asg a WHERE closed_at IS NULL AND doctor_id > 20 AND EXISTS (SELECT 1 FROM asg b WHERE b.patient_id = a.patient_id AND b.closed_at IS NULL AND b.assignment_id <> a.assignment_id)",
    "membership_sync": "WITH w AS (SELECT DISTINCT o_orderkey AS k FROM orders WHERE o_totalprice > 200000), h AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_quantity > 45) SELECT k, 'INSERT' AS action FROM w WHERE k NOT IN (SELECT k FROM h) UNION ALL SELECT k, 'DELETE' FROM h WHERE k NOT IN (SELECT k FROM w)",
    "snapshot_diff": f"WITH {EVENTS_SQL} SELECT seq, status FROM ev WHERE status <> 'FINAL'",
    "constraint_audit": f"WITH {ASSIGN_SQL} SELECT patient_id, count(*) AS n_open FROM asg WHERE closed_at IS NULL GROUP BY 1 HAVING count(*) > 1",
    "kpis": f"WITH {EVENTS_SQL}, l AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY window_id DESC) = 1) SELECT count(*) AS n, count(*) FILTER (p >= 0.5) AS n_elevated, count(*) FILTER (status = 'FINAL') AS n_final FROM l",
    "patient_search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'machinery') AND c_acctbal < 0",
    "final_upsert": f"WITH {EVENTS_SQL} SELECT stay_id, window_id // 2 AS window_id, status, seq, p FROM ev QUALIFY row_number() OVER (PARTITION BY stay_id, window_id // 2 ORDER BY status = 'FINAL' DESC, seq DESC) = 1",
    "retention": f"WITH {EVENTS_SQL} SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY window_id DESC) <= 3",
    # the live state's window and score, the last closed window, and the newest final
    "risk_delta": """WITH RECURSIVE e AS (SELECT user_id AS s, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
x AS MATERIALIZED (SELECT s, k, event_id % 5 = 0 AS fin, k // 4 - CASE WHEN event_id % 15 = 0 THEN 1 ELSE 0 END AS w, round(value / 300, 6) AS p FROM e),
l AS (SELECT s, 0::BIGINT AS k, NULL::DOUBLE AS delta, NULL::BIGINT AS lw, NULL::DOUBLE AS lp, NULL::BIGINT AS closed, NULL::BIGINT AS fw, NULL::DOUBLE AS fp FROM (SELECT DISTINCT s FROM x)
  UNION ALL
  SELECT s, k, CASE WHEN ok AND NOT fin THEN p - CASE WHEN w = lw THEN lp ELSE fp END END, CASE WHEN NOT ok THEN lw WHEN NOT fin THEN w END, CASE WHEN NOT ok THEN lp WHEN NOT fin THEN p END,
         CASE WHEN ok AND fin THEN w ELSE closed END, CASE WHEN fin AND (fw IS NULL OR w >= fw) THEN w ELSE fw END, CASE WHEN fin AND (fw IS NULL OR w >= fw) THEN p ELSE fp END
  FROM (SELECT x.s, x.k, x.fin, x.w, x.p, l.lw, l.lp, l.closed, l.fw, l.fp, (l.closed IS NULL OR x.w > l.closed) AND (l.lw IS NULL OR x.w >= l.lw) AS ok FROM l JOIN x ON x.s = l.s AND x.k = l.k + 1))
SELECT s AS stay_id, k AS seq, round(delta, 6) AS risk_delta FROM l WHERE k > 0""",
    "late_after_final": "WITH x AS (SELECT user_id, event_id, CAST(floor(epoch(ts)) AS BIGINT) AS t, CAST(floor(epoch(ts)) AS BIGINT) + CASE WHEN event_id % 9 = 0 THEN 200000 ELSE 0 END AS arrival FROM events), y AS (SELECT *, max(t) OVER (PARTITION BY user_id ORDER BY arrival, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 86400 AS w FROM x) SELECT user_id AS stay_id, event_id, coalesce((t // 86400 + 1) * 86400 <= w, false) AS late_after_final FROM y",
    "risk_series": f"WITH {EVENTS_SQL} SELECT stay_id, window_id, round(p * 100, 2) AS percent FROM ev",
    "parity_report": f"WITH {features_sql(1440)} " + " UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, CAST(0 AS BIGINT) AS n_failed, 0.0::DOUBLE AS p50, 0.0::DOUBLE AS p95, 0.0::DOUBLE AS p99, 0.0::DOUBLE AS p999, 0.0::DOUBLE AS max FROM features" for c in ("click_mean", "error_last", "view_missing")),
    "nearest_decision": f"WITH {PREDS_SQL} SELECT stay_id, window_id, round(p2, 9) AS p2 FROM (SELECT * FROM preds ORDER BY abs(p2 - 0.44), stay_id, window_id LIMIT 50)",
    "straddling": f"WITH {PREDS_SQL} SELECT label, count(*) AS n FROM preds WHERE (p1 >= 0.44) <> (p2 >= 0.44) GROUP BY 1",
    "stay_pick": f"WITH {PREDS_SQL}, w AS (SELECT stay_id, window_id FROM preds WHERE (stay_id + window_id) % 17 <> 0), g AS (SELECT stay_id, window_id - lag(window_id) OVER (PARTITION BY stay_id ORDER BY window_id) AS gap FROM w), s AS (SELECT stay_id, count(*) AS n_windows, coalesce(max(gap) > 1, false) AS has_gap FROM g GROUP BY 1), k AS (SELECT stay_id, n_windows, CASE WHEN has_gap THEN 'gapped' WHEN n_windows >= 8 THEN 'very_long' WHEN n_windows > 5 THEN 'long' ELSE 'short' END AS kind FROM s) SELECT *, row_number() OVER (PARTITION BY kind ORDER BY stay_id) AS pick FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY stay_id) <= 10",
    "hash_sample": f"WITH {PREDS_SQL}, n AS (SELECT stay_id, count(*) AS n FROM preds GROUP BY 1 HAVING count(*) >= 6) SELECT stay_id, n FROM (SELECT *, {H.format(key=chr(39) + '7:' + chr(39) + ' || stay_id')} AS h FROM n ORDER BY h, stay_id LIMIT 100)",
    "interleave": f"WITH {PREDS_SQL}, t AS (SELECT stay_id, window_id, row_number() OVER (PARTITION BY stay_id ORDER BY window_id) AS turn FROM preds) SELECT *, round({H.format(key=chr(39) + '3:' + chr(39) + ' || stay_id || ' + chr(39) + ':' + chr(39) + ' || turn')}, 6) AS shuffle FROM t",
    "late_materialised": "WITH k AS (SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity, round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM k)",
    "systematic_sample": f"WITH {PREDS_SQL}, t AS (SELECT stay_id, window_id, row_number() OVER (PARTITION BY stay_id ORDER BY window_id) AS n FROM preds) SELECT stay_id, window_id FROM t WHERE n % 4 = 0 OR stay_id < 50",
    "scalar_functions": "SELECT event_id, CAST(strftime(ts, '%Y%m%d%H%M%S') || substr(strftime(ts, '%f'), 1, 3) AS BIGINT) AS stay_number, CASE WHEN floor(value) BETWEEN 0 AND 999999 THEN user_id * 1000000 + CAST(floor(value) AS BIGINT) END AS composite, upper(trim(event_type)) AS name, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
}
