"""Alert machine, patient state, message hygiene and upserts on hand-made rows."""

import pytest

from icuflow.operators import serving, validate
from icuflow.operators.alerts import AlertState, PatientState, alert_machine
from icuflow.operators.live import LiveOrder


def last(rows, **settings):
    state = AlertState()
    return [state.step(w, p, **settings) for w, p in rows][-1]


@pytest.mark.parametrize(
    ("rows", "settings", "alert", "reason"),
    [
        ([(1, 0.12)], {}, True, "initial_high_risk"),
        ([(1, 0.05), (2, 0.12)], {}, True, "threshold_crossing"),
        ([(1, 0.05), (2, 0.12), (3, 0.15)], {}, False, "none"),
        ([(1, 0.12), (2, 0.05), (3, 0.12)], {}, False, "threshold_crossing_suppressed"),
        ([(1, 0.12), (2, 0.05), (3, 0.12), (4, 0.13)], {}, True, "pending_threshold_crossing"),
        ([(1, 0.12), (2, 0.05), (3, 0.12), (4, 0.05), (5, 0.12)], {}, True, "threshold_crossing"),
        ([(1, 0.12), (2, 0.15), (3, 0.25)], {"cooldown": 2}, True, "risk_escalation"),
        ([(2, 0.12), (2, 0.5)], {}, False, "duplicate_suppressed"),
        ([(2, 0.12), (1, 0.5)], {}, False, "stale_suppressed"),
        ([(1, 0.108)], {}, True, "initial_high_risk"),
    ],
)
def test_alerts(rows, settings, alert, reason):
    got = last(rows, **settings)
    assert (got["alert"], got["reason"]) == (alert, reason)


def test_pending_state():
    assert last([(1, 0.12), (2, 0.05), (3, 0.12)])["pending"] and not last([(1, 0.12), (2, 0.05), (3, 0.12), (4, 0.05)])["pending"]


def test_batch_machine(spark):
    df = spark.createDataFrame([(1, 1, 0.05), (1, 2, 0.12), (2, 1, 0.2)], "stay_id long, window_id long, p double")
    assert sorted((r["stay_id"], r["window_id"], r["reason"]) for r in alert_machine(df).collect()) == [(1, 1, "none"), (1, 2, "threshold_crossing"), (2, 1, "initial_high_risk")]


def test_patient_state():
    s = PatientState(history=3)
    assert [s.offer(w, t, c, "a") for w, t, c in ((1, 1, "x"), (1, 1, "x"), (1, 1, "y"), (3, 3, "x"), (2, 4, "x"), (4, 3, "x"))] == ["accepted", "duplicate", "conflicting_duplicate", "accepted", "stale", "timestamp_order"]
    assert s.offer(5, 9, "x", "b") == "static_changed"
    assert [s.offer(w, 10 + w, "x", "a") for w in (6, 7)] == ["accepted", "accepted"] and sorted(s.windows) == [3, 6, 7]
    assert s.offer(1, 50, "x", "a") == "stale" and s.offer(8, 60, "x", "a", True) == "accepted" and s.offer(9, 70, "x", "a") == "discharged"


def test_hygiene(spark):
    rows = [("1.0", "a", 1, "2024-01-01 00:00:00", "2024-01-01 00:01:00", "realtime", " HR ", 5.0), ("1.0", "b", 1, "2024-01-01 00:00:00", "2024-01-01 00:01:01", "realtime", "hr", 10.0)]
    rows += [(v, i, s, "2024-01-01 00:00:00", "2024-01-01 00:01:00", "realtime", k, x) for v, i, s, k, x in (("2.0", "c", 1, "hr", 5.0), ("1.0", "d", None, "hr", 5.0), ("1.0", "e", 1, "bp", 5.0), ("1.0", "f", 1, "hr", 10.1), ("1.0", " ", 1, "hr", 5.0))]
    rows = [(*r[:6], "monitor", *r[6:]) for r in rows] + [("1.0", "g", 1, "2024-01-01 00:00:00", None, "realtime", "monitor", "hr", 5.0)]
    from pyspark.sql import functions as F

    raw = spark.createDataFrame(rows, validate.MESSAGE).select(F.to_json(F.struct("*")).alias("value")).unionByName(spark.createDataFrame([("not json",)], "value string"))
    j = validate.judged(validate.parsed(raw), {"hr": "hr"}, {"hr": (0.0, 10.0)})
    assert {r["event_id"]: r["reason"] for r in j.collect()} == {"a": None, "b": None, "c": "schema_version", "d": "missing_field", "e": "unknown_vital", "f": "out_of_range", " ": "missing_field", "g": "missing_field", None: "missing_field"}
    valid, rejected = validate.split(j)
    assert valid.count() + rejected.count() == 9
    assert {r["event_id"]: r["is_late"] for r in validate.late(valid).collect()} == {"a": False, "b": True}
    assert [r["event_id"] for r in validate.deduplicated(valid).collect()] == ["a"]


def test_duplicates_leave_no_trace(spark):
    """Ids count within a stay only; a refused row's other key doesn't refuse later rows; old keys are forgotten."""
    rows = [(1, "a", "hr", 1, 1), (2, "a", "hr", 1, 2), (1, "b", "hr", 1, 3), (1, "b", "hr", 2, 4), (1, "a", "bp", 5, 5), (1, "c", "hr", 6, 6)]
    df = spark.createDataFrame(rows, "stay_id long, event_id string, vital_sign string, charttime long, seq long")
    assert sorted(r["seq"] for r in validate.deduplicated(df, ["seq"]).collect()) == [1, 2, 4, 6]
    assert sorted(r["seq"] for r in validate.deduplicated(df, ["seq"], most=1).collect()) == [1, 2, 4, 5, 6]


def test_live_order():
    """Windows come first, times count within a window, a final update closes it."""
    def told(rows, refresh=False):
        state = LiveOrder(refresh)
        return [state.offer(*r) for r in rows]

    assert told([(1, 100), (2, 90), (2, 90), (2, 80), (1, 200), (2, 95)]) == ["accepted", "accepted", "duplicate", "out_of_order", "stale", "accepted"]
    assert told([(1, 100), (1, 100)], refresh=True) == ["accepted", "accepted"]
    assert told([(3, 100, True), (3, 200), (2, 300), (4, 50), (4, 50, True), (4, 60)]) == ["accepted", "closed", "closed", "accepted", "duplicate", "accepted"]


def test_risk_delta_after_finals(spark):
    rows = [(0, "UPDATE", 0.1), (0, "FINAL", 0.3), (1, "UPDATE", 0.6), (1, "UPDATE", None), (1, "UPDATE", 0.7), (0, "FINAL", 0.9), (1, "UPDATE", 0.8), (0, "UPDATE", 0.5), (2, "UPDATE", 0.9), (1, "FINAL", 0.4), (2, "UPDATE", 0.95), (2, "FINAL", 0.2), (3, "UPDATE", 0.1), (None, "UPDATE", 0.1)]
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(rows)], "stay_id long, seq long, window_id long, status string, p double")
    wanted = [None, None, 0.3, None, 0.1, None, 0.1, None, 0.0, None, 0.05, None, -0.1, None]
    assert [None if r["risk_delta"] is None else round(r["risk_delta"], 6) for r in serving.risk_delta(df).orderBy("seq").collect()] == wanted


def test_no_score_changes_nothing():
    assert last([(1, 0.05), (2, None)])["reason"] == "no_score" and last([(1, 0.05), (2, None), (3, 0.2)])["reason"] == "threshold_crossing"


def test_upsert(spark):
    df = spark.createDataFrame([(1, "UPDATE", 1), (1, "FINAL", 2), (1, "UPDATE", 3), (2, "UPDATE", 1), (2, "UPDATE", 2)], "k long, status string, seq long")
    assert {(r["k"], r["status"], r["seq"]) for r in serving.final_upsert(df, ["k"], "seq").collect()} == {(1, "FINAL", 2), (2, "UPDATE", 2)}


def test_latest_puts_nulls_first(spark):
    df = spark.createDataFrame([(1, None, 9), (1, 5, 1)], "k long, t long, id long")
    assert serving.latest(df, "k", ["t", "id"]).first()["t"] == 5
