"""What the live service decides between final windows, as batch operators over arrival order.

A stream of the same rows gives the same decisions: all of them look only at earlier rows of the stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icuflow.operators.alerts import over_stays

# Production settings, in seconds.
EARLY, PENDING_TTL, IDLE, EVICT, GRACE = 120, 3600, 900, 6 * 3600, 30


def partial_windows(readings: DataFrame, minutes: int) -> DataFrame:
    """Each reading's running mean, minimum, maximum and count of its vital in its window, and whether the window is old enough for an early result.

    readings: stay_id, window_id, vital_sign, charttime, intime, event_id, value."""
    so_far = Window.partitionBy("stay_id", "window_id", "vital_sign").orderBy("charttime", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    into = F.unix_timestamp("charttime") - F.unix_timestamp("intime") - F.col("window_id") * 60 * minutes
    return readings.select(
        "stay_id", "window_id", "event_id", F.avg("value").over(so_far).alias("mean"), F.min("value").over(so_far).alias("low"), F.max("value").over(so_far).alias("high"), F.count("value").over(so_far).alias("n"), (into >= EARLY).alias("early")
    )


def pending_release(observations: DataFrame, static: DataFrame, ttl: int = PENDING_TTL) -> DataFrame:
    """Observations wait for their stay's static row: when each is released, how long it waited, or that it expired.

    observations: stay_id, event_id, arrival (seconds); static: stay_id, static_arrival. Stays without a static row never release."""
    x = observations.join(static, "stay_id", "left")
    waited = F.greatest(F.lit(0).cast("long"), F.col("static_arrival") - F.col("arrival"))
    status = F.when(F.col("static_arrival").isNull() | (waited > ttl), "expired").when(waited > 0, "released").otherwise("direct")
    return x.select("stay_id", "event_id", status.alias("status"), F.when(status != "expired", waited).alias("waited"))


def idle_and_evicted(events: DataFrame, idle: int = IDLE, evict: int = EVICT) -> DataFrame:
    """Per event: whether the time since the stay's last one had its windows finalised, had its state evicted (strictly longer), and so came back anew.

    events: stay_id, event_id, t (seconds)."""
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("stay_id").orderBy("t", "event_id"))
    return events.select("stay_id", "event_id", F.coalesce(gap > idle, F.lit(False)).alias("idle_finalised"), F.coalesce(gap > evict, F.lit(False)).alias("recovered"))


def discharge_filter(events: DataFrame, discharges: DataFrame, grace: int = GRACE) -> DataFrame:
    """Events of a discharged stay count until the grace ends; after it they are refused.

    events: stay_id, event_id, t; discharges: stay_id, discharged (seconds)."""
    x = events.join(discharges, "stay_id", "left")
    status = F.when(F.col("t") > F.col("discharged") + grace, "refused").when(F.col("t") > F.col("discharged"), "in_grace").otherwise("open")
    return x.select("stay_id", "event_id", status.alias("status"))


class LiveOrder:
    """Of one stay: the open window's last update, and the last closed window.

    A newer window is always news; times are compared within a window only. A final update closes its window."""

    def __init__(self, refresh: bool = False):
        self.window, self.time, self.closed, self.refresh = None, None, None, refresh

    def offer(self, window: int, time: int, final: bool = False) -> str:
        if window is None or time is None or window != window or time != time:
            return "invalid"
        if self.closed is not None and window <= self.closed:
            return "closed"
        if self.window is not None and window < self.window:
            return "stale"
        if self.window == window and time == self.time and not self.refresh:
            return "duplicate"
        if self.window == window and time < self.time:
            return "out_of_order"
        self.window, self.time = window, time
        if final:
            self.close(window)
        return "accepted"

    def close(self, window: int | None) -> bool:
        """A final closes its window, and ends a live update of it or an older one; while one of a newer window stands, it changes nothing. Whether it did."""
        if window is None or window != window or (self.closed is not None and window <= self.closed) or (self.window is not None and window < self.window):
            return False
        self.window, self.time, self.closed = None, None, window
        return True


def live_order(updates: DataFrame, refresh: bool = False) -> DataFrame:
    """updates: stay_id, seq, window_id, time, final. Adds what became of each. refresh: whether an update with the time of the last one counts."""
    step = lambda s, r: {"reason": s.offer(r["window_id"], r["time"], bool(r["final"]))}
    return over_stays(updates.select("stay_id", "seq", "window_id", "time", "final"), ["seq"], lambda: LiveOrder(refresh), step, "reason string")
