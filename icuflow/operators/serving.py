"""Tables that a front end reads: latest rows, worklists, loads, alerts and changes since the last look."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.operators.alerts import over_stays
from icuflow.operators.live import LiveOrder


def latest(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The row of each key that comes last by order (nulls before all values)."""
    rest = [c for c in df.columns if c != key]
    rank = F.struct(*[F.struct(F.col(c).isNotNull().alias("known"), F.col(c).alias("value")) for c in order])
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(key, *[F.col(f"r.{c}").alias(c) for c in rest])


def recent(df: DataFrame, key: str, order: Sequence[Column], n: int) -> DataFrame:
    """The n (1 to 500) newest rows of each key, with their rank."""
    n = min(500, max(1, n))
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= n)


def with_explanation(events: DataFrame, explanations: DataFrame, key: str, order: Sequence[str], on: Sequence[str]) -> DataFrame:
    return latest(events, key, order).join(explanations, list(on), "left")


def load(people: DataFrame, assignments: DataFrame, person: str, patient: str) -> DataFrame:
    """Distinct patients of each person's open assignments; 0 for those without."""
    n = assignments.where("closed_at is null").groupBy(person).agg(F.count_distinct(patient).alias("n_patients"))
    return people.join(n, person, "left").withColumn("n_patients", F.coalesce("n_patients", F.lit(0).cast("long")))


def to_alert(candidates: DataFrame, open_alerts: DataFrame, key: str) -> DataFrame:
    """Candidates without an open alert."""
    return candidates.join(open_alerts.select(key).distinct(), key, "left_anti")


def resolvable(alerts: DataFrame, assignments: DataFrame) -> DataFrame:
    """Alerts whose patient has another open assignment than the alert's own."""
    a = assignments.where("closed_at is null").select(F.col("patient_id").alias("p"), F.col("assignment_id").alias("other"))
    return alerts.join(a, (F.col("patient_id") == F.col("p")) & (F.col("assignment_id") != F.col("other")), "left_semi")


def membership_sync(wanted: DataFrame, present: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What to insert and what to delete."""
    a, b = wanted.select(*keys).distinct(), present.select(*keys).distinct()
    return a.join(b, list(keys), "left_anti").withColumn("action", F.lit("INSERT")).unionByName(b.join(a, list(keys), "left_anti").withColumn("action", F.lit("DELETE")))


def new_since(current: DataFrame, previous: DataFrame, key: str) -> DataFrame:
    return current.join(previous.select(key), key, "left_anti")


def searched(df: DataFrame, text: str, columns: Sequence[str], status: str | None = None) -> DataFrame:
    x = df.where(F.contains(F.lower(F.concat_ws(" ", *columns)), F.lit(text.strip().lower())))
    return x.where(F.col("status") == status) if status else x


def final_upsert(rows: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    """One row a key: a FINAL row is never replaced by an UPDATE; among equals the latest wins."""
    order = Window.partitionBy(*keys).orderBy(F.desc(F.col("status") == "FINAL"), F.desc(sequence))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def merged_into(existing: DataFrame, batch: DataFrame, keys: Sequence[str], sequence: str) -> DataFrame:
    return final_upsert(existing.unionByName(batch), keys, sequence)


def retained(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The newest n windows of each stay."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where(F.col("_n") <= n).drop("_n")


class RiskDelta:
    """One stay's live state and last final. An update is compared with the live state of its window, else with the final of the newest window."""

    def __init__(self):
        self.order, self.live, self.final, self.final_window = LiveOrder(), None, None, None

    def step(self, row: dict) -> dict:
        window, p = row["window_id"], row["p"]
        if row["status"] == "FINAL":
            if self.order.close(window):
                self.live = None
            if window is not None and (self.final_window is None or window >= self.final_window):
                self.final, self.final_window = p, window
            return {"risk_delta": None}
        if p is None:  # without a score an update changes nothing
            return {"risk_delta": None}
        same = self.order.window is not None and self.order.window == window
        if self.order.offer(window, row["seq"]) != "accepted":
            return {"risk_delta": None}
        before, self.live = (self.live if same else self.final), p
        return {"risk_delta": None if before is None else p - before}


def risk_delta(df: DataFrame) -> DataFrame:
    """df: stay_id, seq, window_id, status, p. Adds an accepted update's difference; finals and refused updates have none, and a final of an older window leaves a newer live state alone."""
    return over_stays(df.select("stay_id", "seq", "window_id", "status", "p"), ["seq"], RiskDelta, lambda s, r: s.step(r), "risk_delta double")


def active_handovers(alerts: DataFrame, assignments: DataFrame, patients: DataFrame) -> DataFrame:
    """Open alerts whose assignment is open and whose patient is active; the others are stale and hidden.

    alerts: assignment_id, patient_id, status; assignments: assignment_id, closed_at; patients: patient_id, status."""
    open_ = assignments.where("closed_at is null").select("assignment_id")
    active = patients.where("status = 'ACTIVE'").select("patient_id")
    return alerts.where("status = 'OPEN'").join(open_, "assignment_id", "left_semi").join(active, "patient_id", "left_semi")


def guard_violations(stays: DataFrame, assignments: DataFrame, patients: DataFrame, branches: DataFrame, doctors: DataFrame) -> DataFrame:
    """rule, id, n: whatever breaks a guard of the writes, and by how many rows.

    stays: stay_id, patient_id, outtime; assignments: patient_id, doctor_id, closed_at; patients: patient_id, branch_id,
    status; branches: branch_id, is_active; doctors: doctor_id, is_active. All are grouped with partial sums first."""
    open_ = assignments.where("closed_at is null")
    counted = lambda df, key: df.groupBy(F.col(key).cast("long").alias("id")).agg(F.count("*").alias("n"))
    several = lambda df, key: counted(df, key).where("n > 1")
    off = lambda df, key: df.where("NOT is_active").select(F.col(key).cast("long").alias("id"))
    found = {
        "several_active_stays": several(stays.where("outtime is null"), "patient_id"),
        "repeated_stay_id": several(stays, "stay_id"),
        "several_open_assignments": several(open_, "patient_id"),
        "active_patient_in_closed_branch": counted(patients.where("status = 'ACTIVE'"), "branch_id").join(off(branches, "branch_id"), "id", "left_semi"),
        "open_assignment_of_inactive_doctor": counted(open_, "doctor_id").join(off(doctors, "doctor_id"), "id", "left_semi"),
    }
    tables = [df.select(F.lit(rule).alias("rule"), "id", "n") for rule, df in found.items()]
    return functools.reduce(DataFrame.unionByName, tables)
