"""Queries of changes between windows, cohorts, data quality, the alert log and hidden alerts."""

from __future__ import annotations

from pyspark.sql import functions as F

from icuflow.operators import alerts, changes, serving
from icuflow.plans.decisions import ALERT_SQL, ASSIGN_SQL, _assignments, _scores
from icuflow.plans.features import ATTRIBUTED_SQL, DAY, MEANS, POSITIONS_SQL, _attributed, features, features_sql, rounded
from icuflow.sources.telemetry import VITALS, partitions_for, stays, table

FULL = 20


def changed_features(spark, d):
    """Windows are days here; after two days without readings nothing is compared."""
    return rounded(changes.changed_features(_attributed(spark, d), MEANS, 3, max_gap=2))


def changed_vitals(spark, d):
    """Days' last values against the day before, or the one before that."""
    last = [f"{v}_last" for v in VITALS]
    x = features(spark, d).select("stay_id", "window_id", *[F.when(F.col(f"{v}_missing") == 0, F.col(c)).alias(c) for v, c in zip(VITALS, last, strict=True)])
    return rounded(changes.changed_vitals(x, last, max_gap=2))


def attribution_series(spark, d):
    return rounded(changes.attribution_series(_attributed(spark, d), MEANS, 5))


def attribution_by_step(spark, d):
    return rounded(changes.attribution_by_step(_attributed(spark, d)))


def attribution_trend(spark, d):
    return rounded(changes.attribution_trend(_attributed(spark, d), MEANS, 2))


def cohort_rates(spark, d):
    """Stays' windows as sequences of all windows so far; full length is FULL windows here."""
    from pyspark.sql import Window

    x = features(spark, d).join(stays(spark, d).select("stay_id", "label"), "stay_id")
    return rounded(changes.cohorts(x.select("label", F.row_number().over(Window.partitionBy("stay_id").orderBy("window_id")).alias("sequence_length")), FULL))


def data_quality(spark, d):
    return changes.data_quality(features(spark, d).select("stay_id", "window_id", *MEANS), FULL, MEANS)


def alert_log(spark, d):
    """The machine's rows with a class from a lower threshold, so that some don't agree with their scores."""
    x = alerts.alert_machine(_scores(spark, d), partitions=partitions_for(spark, d, "lineitem"), threshold=0.6, cooldown=3, escalation=0.1, dead_band=0.05).withColumn("given", (F.col("p") >= 0.55).cast("int"))
    return rounded(changes.alert_log(x, "given", 0.6).select("stay_id", "window_id", "p", "reason", "alert", "mismatch"))


def active_handovers(spark, d):
    """Every assignment as an alert, one in five resolved; customers below zero are no longer active."""
    a = _assignments(spark, d)
    alerts_ = a.select("assignment_id", "patient_id", F.when(F.col("assignment_id") % 5 == 0, "RESOLVED").otherwise("OPEN").alias("status"))
    return serving.active_handovers(alerts_, a, _patients(spark, d)).select("assignment_id", "patient_id")


def _patients(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_nationkey").alias("branch_id"), F.when(F.col("c_acctbal") < 0, "DISCHARGED").otherwise("ACTIVE").alias("status"))


def constraint_guards(spark, d):
    """Orders as stays, two of which share an id; one branch in four is closed, one doctor in six inactive."""
    o, n = table(spark, d, "orders"), table(spark, d, "nation")
    stays = o.select(F.floor(F.col("o_orderkey") / 2).alias("stay_id"), F.col("o_custkey").alias("patient_id"), F.when(~((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 3 == 0)), F.col("o_orderdate")).alias("outtime"))
    branches = n.select(F.col("n_nationkey").alias("branch_id"), (F.col("n_nationkey") % 4 != 0).alias("is_active"))
    doctors = n.select(F.col("n_nationkey").alias("doctor_id"), (F.col("n_nationkey") % 6 != 0).alias("is_active"))
    return serving.guard_violations(stays, _assignments(spark, d), _patients(spark, d), branches, doctors)


def constraint_rules(spark, d):
    """What each assignment and line must satisfy."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    rules = {"has_patient": F.col("o_custkey").isNotNull(), "not_before_order": F.col("l_shipdate") >= F.col("o_orderdate"), "small_quantity": F.col("l_quantity") <= 45, "discount_in_range": F.col("l_discount").between(0, 0.07), "closed_is_final": (F.col("o_orderstatus") != "F") | (F.col("l_quantity") > 2)}
    return changes.constraint_violations(x, rules)


QUERIES = {f.__name__: f for f in (changed_features, changed_vitals, attribution_by_step, attribution_trend, attribution_series, cohort_rates, data_quality, alert_log, active_handovers, constraint_guards, constraint_rules)}

_VALUES = " UNION ALL ".join(f"SELECT stay_id, window_id, {k} AS k, {c} AS value FROM features" for k, c in enumerate(MEANS))

ORACLE_SQL = {
    "changed_features": f"""WITH {ATTRIBUTED_SQL}, vals AS ({_VALUES}),
j AS (SELECT stay_id, window_id, k, feature, value, v, lag(value) OVER w AS pv, lag(v) OVER w AS pa, window_id - lag(window_id) OVER w AS gap FROM long JOIN vals USING (stay_id, window_id, k) WINDOW w AS (PARTITION BY stay_id, k ORDER BY window_id)),
c AS (SELECT *, v - pa AS shift, (pv IS NULL) <> (value IS NULL) OR coalesce(abs(value - pv) > 1e-6, false) AS changed FROM j WHERE gap <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY stay_id, window_id ORDER BY round(abs(shift), 12) DESC, k) AS rank FROM c WHERE changed OR abs(shift) >= 1e-4)
SELECT stay_id, window_id, CAST(rank AS INTEGER) AS rank, feature, round(pv, 6) AS previous_value, round(value, 6) AS current_value, round(value - pv, 6) AS value_delta, round(shift, 6) AS attribution_delta, changed AS value_changed FROM r WHERE rank <= 3""",
    "changed_vitals": f"WITH {features_sql(DAY)}, x AS (" + " UNION ALL ".join(f"SELECT stay_id, window_id, '{v}_last' AS vital, CASE WHEN {v}_missing = 0 THEN {v}_last END AS v FROM features" for v in VITALS) + "), y AS (SELECT *, lag(v) OVER w AS pv, window_id - lag(window_id) OVER w AS gap FROM x WINDOW w AS (PARTITION BY stay_id, vital ORDER BY window_id)) SELECT stay_id, window_id, vital, round(pv, 6) AS previous_value, round(v, 6) AS current_value, round(v - pv, 6) AS delta FROM y WHERE gap <= 2 AND coalesce(abs(v - pv) > 1e-9, (v IS NULL) <> (pv IS NULL))",
    "attribution_series": f"WITH {ATTRIBUTED_SQL}, m AS (SELECT stay_id, k, avg(abs(v)) AS m FROM long GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY m DESC, k) AS rank FROM m), x AS (SELECT stay_id, window_id, rank, feature, v FROM long JOIN b USING (stay_id, k)) SELECT stay_id, window_id, " + ", ".join(f"max(feature) FILTER (rank = {r}) AS feature_{r}, round(max(v) FILTER (rank = {r}), 6) AS attribution_{r}" for r in range(1, 6)) + " FROM x GROUP BY 1, 2",
    "attribution_by_step": f"WITH {ATTRIBUTED_SQL}, p AS (SELECT *, dense_rank() OVER (PARTITION BY stay_id ORDER BY window_id) AS timestep FROM long) SELECT CAST(timestep AS INTEGER) AS timestep, round(avg(abs(v)), 6) AS mean_abs, count(*) AS n FROM p GROUP BY 1",
    "attribution_trend": f"WITH {ATTRIBUTED_SQL}, m AS (SELECT stay_id, k, avg(abs(v)) AS m FROM long GROUP BY 1, 2), b AS (SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY m DESC, k) AS rank FROM m) SELECT stay_id, window_id, CAST(rank AS INTEGER) AS rank, feature, round(v, 6) AS attribution FROM long JOIN b USING (stay_id, k) WHERE rank <= 2",
    "cohort_rates": f"WITH {POSITIONS_SQL}, x AS (SELECT position, label FROM positions JOIN stays USING (stay_id)) SELECT 'overall' AS cohort, count(*) AS n, round(avg(label), 6) AS rate, 100.0::DOUBLE AS coverage FROM x UNION ALL SELECT 'full_length', count(*) FILTER (position >= {FULL}), round(coalesce(avg(label) FILTER (position >= {FULL}), 0), 6), round(100.0::DOUBLE * count(*) FILTER (position >= {FULL}) / count(*), 6) FROM x",
    "data_quality": f"WITH {features_sql(DAY)} SELECT stay_id, window_id, CASE WHEN row_number() OVER (PARTITION BY stay_id ORDER BY window_id) < {FULL} THEN 'INSUFFICIENT_HISTORY' ELSE 'OK' END AS status, CAST({' + '.join(f'CAST({c} IS NULL AS INTEGER)' for c in MEANS)} AS BIGINT) AS n_missing FROM features",
    "alert_log": f"WITH {ALERT_SQL} SELECT stay_id, window_id, round(p, 6) AS p, reason, alert, p >= 0.55 AND p < 0.6 AS mismatch FROM m WHERE alert OR (p >= 0.55 AND p < 0.6) OR reason = 'threshold_crossing_suppressed'",
    "active_handovers": f"WITH {ASSIGN_SQL} SELECT assignment_id, patient_id FROM asg JOIN customer ON c_custkey = patient_id WHERE closed_at IS NULL AND c_acctbal >= 0 AND assignment_id % 5 <> 0",
    "constraint_guards": f"""WITH {ASSIGN_SQL}, st AS (SELECT o_orderkey // 2 AS stay_id, o_custkey AS patient_id, o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS active FROM orders)
SELECT 'several_active_stays' AS rule, patient_id AS id, count(*) AS n FROM st WHERE active GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'repeated_stay_id', stay_id, count(*) FROM st GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'several_open_assignments', patient_id, count(*) FROM asg WHERE closed_at IS NULL GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'active_patient_in_closed_branch', c_nationkey, count(*) FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 4 = 0 GROUP BY 2
UNION ALL SELECT 'open_assignment_of_inactive_doctor', doctor_id, count(*) FROM asg WHERE closed_at IS NULL AND doctor_id < 25 AND doctor_id % 6 = 0 GROUP BY 2""",
    "constraint_rules": "WITH x AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT 'has_patient' AS rule, count(*) FILTER (o_custkey IS NULL) AS n FROM x UNION ALL SELECT 'not_before_order', count(*) FILTER (l_shipdate < o_orderdate) FROM x UNION ALL SELECT 'small_quantity', count(*) FILTER (l_quantity > 45) FROM x UNION ALL SELECT 'discount_in_range', count(*) FILTER (NOT l_discount BETWEEN 0 AND 0.07) FROM x UNION ALL SELECT 'closed_is_final', count(*) FILTER (o_orderstatus = 'F' AND l_quantity <= 2) FROM x",
}
