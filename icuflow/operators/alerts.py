"""Alert state machine and rolling patient state.

Both feed on their own earlier decisions, so they run as a step function over each stay's windows in order: in batch
over partitions that hold whole stays, sorted, with one stay's state at a time in memory; in streams by the same
function in a stateful operator (streaming/state.py).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Production settings.
THRESHOLD, COOLDOWN, ESCALATION, DEAD_BAND, MAX_GAP, HISTORY = 0.108, 3, 0.10, 0.01, 6, 120


def over_stays(df: DataFrame, order: Sequence[str], start: Callable, step: Callable, schema: str, partitions: int | None = None) -> DataFrame:
    """step(state, row) gives the columns that follow df's own; start() makes the state of a stay. Rows stream by in order, in as many partitions as are given, or the session's number."""
    names = [f.strip().split(" ")[0] for f in schema.split(",")]

    def run(batches):
        stay, state = None, None
        for b in batches:
            out = []
            for row in b.to_pylist():
                if state is None or row["stay_id"] != stay:
                    stay, state = row["stay_id"], start()
                out.append(step(state, row))
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[c] for r in out]) for c in names)], names=[*b.schema.names, *names])

    ordered = (df.repartition(partitions, "stay_id") if partitions else df.repartition("stay_id")).sortWithinPartitions("stay_id", *order)
    return ordered.mapInArrow(run, ", ".join([*(f"{c} {t}" for c, t in df.dtypes), schema]))


def directions(df: DataFrame, score: str = "p", threshold: float = THRESHOLD, dead_band: float = DEAD_BAND, max_gap: int = MAX_GAP) -> DataFrame:
    """delta to the previous window (none beyond max_gap windows), direction, and whether the threshold was crossed upwards."""
    order = Window.partitionBy("stay_id").orderBy("window_id")
    near = F.col("window_id") - F.lag("window_id").over(order) <= max_gap
    before = F.when(near, F.lag(score).over(order))
    delta = F.col(score) - before
    direction = F.when(before.isNull(), "initial").when(delta > dead_band, "rising").when(delta < -dead_band, "falling").otherwise("stable")
    crossed = F.coalesce((before < threshold) & (F.col(score) >= threshold), F.lit(False))
    return df.select("*", delta.alias("delta"), direction.alias("direction"), crossed.alias("crossed"))


class AlertState:
    """One stay's alert machine; fields are plain numbers, so that a stream can keep them as a row."""

    FIELDS = ("last_window", "last_p", "pending", "alert_window", "alert_p")

    def __init__(self, last_window=None, last_p=None, pending=False, alert_window=None, alert_p=None):
        self.last_window, self.last_p, self.pending, self.alert_window, self.alert_p = last_window, last_p, pending, alert_window, alert_p

    def step(self, window: int, p: float | None, threshold: float = THRESHOLD, cooldown: int = COOLDOWN, escalation: float = ESCALATION, dead_band: float = DEAD_BAND) -> dict:
        if window is None or window != window:
            return {"alert": False, "reason": "invalid", "direction": "unknown", "pending": self.pending, "cooldown": 0}
        if self.last_window is not None and window <= self.last_window:
            return {"alert": False, "reason": "duplicate_suppressed" if window == self.last_window else "stale_suppressed", "direction": "stale", "pending": self.pending, "cooldown": self._left(self.last_window, cooldown)}
        if p is None or p != p:  # a window without a score changes nothing
            return {"alert": False, "reason": "no_score", "direction": "unknown", "pending": self.pending, "cooldown": self._left(window, cooldown)}
        before, high = self.last_p, p >= threshold
        if before is None:
            direction = "initial"
        else:
            delta = p - before
            direction = "rising" if delta > dead_band else "falling" if delta < -dead_band else "stable"
        cooling = self._left(window, cooldown) > 0
        reason, quiet = None, "none"
        if before is None and high:
            reason = "initial_high_risk"
        elif before is not None and before < threshold and high:
            if cooling:
                self.pending, quiet = True, "threshold_crossing_suppressed"
            else:
                reason = "threshold_crossing"
        elif self.pending and high and not cooling:
            reason = "pending_threshold_crossing"
        if high and self.alert_p is not None and not cooling and p - self.alert_p >= escalation:
            reason = "risk_escalation"
        if reason:
            self.pending, self.alert_window, self.alert_p = False, window, p
        if not high:
            self.pending = False
        self.last_window, self.last_p = window, p
        return {"alert": reason is not None, "reason": reason or quiet, "direction": direction, "pending": self.pending, "cooldown": self._left(window, cooldown)}

    def _left(self, window: int, cooldown: int) -> int:
        return 0 if self.alert_window is None else max(0, cooldown - (window - self.alert_window))


ALERTS = "stay_id long, window_id long, p double, alert boolean, reason string, direction string, pending boolean, cooldown int"


def alert_machine(df: DataFrame, score: str = "p", partitions: int | None = None, **settings) -> DataFrame:
    """The machine over each stay's rows by window (repeats by score)."""
    rows = df.select("stay_id", F.col("window_id").cast("long").alias("window_id"), F.col(score).cast("double").alias("p"))
    step = lambda state, r: state.step(r["window_id"], r["p"], **settings)
    made = over_stays(rows, ["window_id", "p"], AlertState, step, "alert boolean, reason string, direction string, pending boolean, cooldown long", partitions)
    return made.withColumn("cooldown", F.col("cooldown").cast("int"))


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("reason").agg(F.count("*").alias("n"), F.count_if("alert").alias("n_alerts"))


class PatientState:
    """Accepts or rejects a stay's windows, and keeps the newest HISTORY of them. The order of checks matters; a window, time, content or static row that is missing or not finite is invalid before all of them."""

    def __init__(self, history: int = HISTORY):
        self.history, self.windows, self.last_time, self.static, self.discharged = history, {}, None, None, False

    def offer(self, window: int, time, content: str, static: str | None, discharged: bool = False) -> str:
        if None in (window, time, content, static) or window < 0 or not math.isfinite(time):
            return "invalid"
        content = (content, time, static)  # what a repeated window must agree in
        if window in self.windows:
            return "duplicate" if self.windows[window] == content else "conflicting_duplicate"
        if self.discharged:
            return "discharged"
        if self.windows and window < max(self.windows):
            return "stale"
        if self.last_time is not None and time <= self.last_time:
            return "timestamp_order"
        if self.static is not None and static != self.static:
            return "static_changed"
        self.windows[window] = content
        if len(self.windows) > self.history:
            del self.windows[min(self.windows)]
        self.last_time, self.static, self.discharged = time, static, self.discharged or discharged
        return "accepted"


def state_reasons(df: DataFrame, history: int = HISTORY) -> DataFrame:
    """df: stay_id, seq (order of arrival), window_id, time, content, static, discharged. Adds what became of each offer, and how many windows are kept."""

    def step(state: PatientState, r: dict) -> dict:
        reason = state.offer(r["window_id"], r["time"], r["content"], r["static"], bool(r["discharged"]))
        return {"reason": reason, "n_kept": len(state.windows)}

    return over_stays(df.select("stay_id", "seq", "window_id", "time", "content", "static", "discharged"), ["seq", "content"], lambda: PatientState(history), step, "reason string, n_kept long")
