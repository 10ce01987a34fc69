"""Stateful operators in a chain: windows into sequences into alerts, and readings into live updates.

Each keeps one stay's state. Rows of a batch are taken in the order of seq, whatever the frames they come in; earlier
batches come first. An operator feeds the next within the same batch.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessorHandle

from icuflow.operators.alerts import HISTORY, AlertState, PatientState
from icuflow.operators.live import LiveOrder
from icuflow.streaming.buckets import OfStays, over_messages


SEQUENCES = "stay_id long, seq long, window_id long, time double, reason string, n_kept long, sequence array<array<double>>, padding array<int>, score double, arrived timestamp"


class SequenceProcessor(OfStays):
    """A ring of a stay's newest windows: each offer's reason, and for an accepted one the padded sequence and its score."""

    schema = SEQUENCES

    def __init__(self, score: Callable[[np.ndarray], float], width: int, history: int = HISTORY):
        self.score, self.width, self.history = score, width, history

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring, self.meta = handle.getMapState("ring", "window long", "json string"), handle.getValueState("meta", "json string")

    def step(self, messages: list[dict]) -> list[dict]:
        state, values, out = PatientState(self.history), {}, []
        if self.meta.exists():
            state.last_time, state.static, state.discharged = json.loads(self.meta.get()[0])
        for (w,), (kept,) in self.ring.iterator():
            content, time, static, values[w] = json.loads(kept)
            state.windows[w] = (content, time, static)
        before = set(state.windows)
        for m in messages:
            own = None if m["values"] is None or len(m["values"]) != self.width else [float("nan") if v is None else float(v) for v in m["values"]]
            content = json.dumps(own) if own is not None and all(map(math.isfinite, own)) else None
            reason = state.offer(None if m["window_id"] is None else int(m["window_id"]), m["time"], content, m["static"], bool(m["discharged"]))
            row = {"reason": reason, **{c: m[c] for c in ("seq", "window_id", "time", "arrived")}}
            if reason == "accepted":
                values[int(m["window_id"])] = own
                kept = np.array([values[w] for w in sorted(state.windows)])
                row["sequence"] = kept.tolist() + [[0.0] * self.width] * (self.history - len(kept))
                row["padding"] = [0] * len(kept) + [1] * (self.history - len(kept))
                row["score"] = float(self.score(kept))
            out.append(row | {"n_kept": len(state.windows)})
        for w in before - set(state.windows):
            self.ring.removeKey((w,))
        for w in set(state.windows) - before:
            self.ring.updateValue((w,), (json.dumps([*state.windows[w], values[w]]),))
        self.meta.update((json.dumps([state.last_time, state.static, state.discharged]),))
        return out


PROCESSED = "stay_id long, seq long, window_id long, reason string, n_kept long, n_padded long, total double, score double, alert boolean, alert_reason string, latency_ms long"


class AlertProcessor(OfStays):
    """The alert machine over scored windows; others pass with their reason. latency_ms: from the window's arrival to now."""

    schema = PROCESSED

    def __init__(self, settings: Mapping[str, float]):
        self.settings = dict(settings)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.machine = handle.getValueState("machine", "json string")

    def step(self, messages: list[dict]) -> list[dict]:
        machine, out = AlertState(*json.loads(self.machine.get()[0])) if self.machine.exists() else AlertState(), []
        for m in messages:
            row = {c: m[c] for c in ("seq", "window_id", "reason", "n_kept", "score")}
            if m["reason"] == "accepted":
                step = machine.step(int(m["window_id"]), m["score"], **self.settings)
                row |= {"alert": step["alert"], "alert_reason": step["reason"], "n_padded": int(sum(m["padding"])), "total": float(sum(sum(r) for r in m["sequence"]))}
            out.append(row | {"latency_ms": max(0, int((pd.Timestamp.now() - m["arrived"]).total_seconds() * 1000))})
        self.machine.update((json.dumps([getattr(machine, f) for f in AlertState.FIELDS]),))
        return out


def processed_windows(windows: DataFrame, score: Callable[[np.ndarray], float], width: int, history: int = HISTORY, buckets: int | None = None, **settings: float) -> DataFrame:
    """windows: stay_id, seq, window_id, time, values, static, discharged, arrived (timestamp), as a stream. What became of each, its sequence's size and score, and the alert it raised."""
    return over_messages(windows.withWatermark("arrived", "1 minute"), [SequenceProcessor(score, width, history), AlertProcessor(settings)], buckets)


UPDATES = "stay_id long, seq long, window_id long, time long, final boolean, reason string, p double, p_previous double, risk_delta double, changed array<string>"
PROBABILITIES = ("p", "p1", "p2")


class LiveUpdates(OfStays):
    """Readings to live updates. A time is complete once all needed vitals were read at it; then the update is ordered, judged and compared.

    reason: incomplete; or why the order refused it (closed, stale, duplicate, out_of_order, invalid); initial, if its window
    has no live state; vital_changed or risk_changed (any of three probabilities) against that state, else unchanged; or
    final. A final closes its window, but leaves a live state of a newer window alone. risk_delta is against the window's
    live state, without one against the final of the newest window; a final has none."""

    schema = UPDATES

    def __init__(self, needed: Sequence[str], window: int, tolerance: float = 1e-9, least: float = 1e-6):
        self.needed, self.window, self.tolerance, self.least = sorted(needed), window, tolerance, least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.batches, self.state = handle.getMapState("batches", "time long", "vitals string"), handle.getValueState("state", "json string")

    def _differs(self, a: float | None, b: float | None, least: float) -> bool:
        return (a is None) != (b is None) or (a is not None and abs(a - b) > least)

    def _update(self, s: dict, window: int, scores: dict) -> dict:
        live = s["live"] if s["live"] and s["live"]["window"] == window else None
        changed = sorted(v for v in s["vitals"] if self._differs(live["vitals"].get(v), s["vitals"][v], self.tolerance)) if live else []
        moved = live and any(self._differs(live[c], scores[c], self.least) for c in PROBABILITIES)
        before = live["p"] if live else s["final"] and s["final"]["p"]
        s["live"] = {"window": window, "vitals": dict(s["vitals"]), **scores}
        reason = "initial" if not live else "vital_changed" if changed else "risk_changed" if moved else "unchanged"
        return {"reason": reason, "changed": changed, "p_previous": before, "risk_delta": None if None in (before, scores["p"]) else scores["p"] - before}

    def _complete(self, t: int, vital: str) -> bool:
        got = {vital, *(json.loads(self.batches.getValue((t,))[0]) if self.batches.containsKey((t,)) else ())}
        if got >= set(self.needed):
            self.batches.removeKey((t,))
            return True
        self.batches.updateValue((t,), (json.dumps(sorted(got)),))
        return False

    def step(self, messages: list[dict]) -> list[dict]:
        s = json.loads(self.state.get()[0]) if self.state.exists() else {"order": [None, None, None], "live": None, "final": None, "vitals": {}, "times": {}}
        order = LiveOrder()
        order.window, order.time, order.closed = s["order"]
        out = []
        for m in messages:
            row = {"seq": m["seq"], "time": m["time"], "window_id": m["window_id"], "final": bool(m["final"]), "p": m["p"]}
            if m["final"]:
                w = m["window_id"]
                row["reason"] = "final" if w is not None else "invalid"
                if order.close(w):
                    s["live"] = None
                    for (t,) in [t for t in self.batches.keys() if t[0] // self.window == w]:
                        self.batches.removeKey((t,))
                if w is not None and (s["final"] is None or w >= s["final"]["window"]):
                    s["final"] = {"window": w, "p": m["p"]}
            elif None in (m["time"], m["vital_sign"], m["value"]):
                row["reason"] = "invalid"
            else:
                t, vital = int(m["time"]), m["vital_sign"]
                row["window_id"] = window = t // self.window
                if s["times"].get(vital) is None or t >= s["times"][vital]:
                    s["vitals"][vital], s["times"][vital] = m["value"], t
                row["reason"] = order.offer(window, t) if self._complete(t, vital) else "incomplete"
                if row["reason"] == "accepted":
                    row |= self._update(s, window, {c: m[c] for c in PROBABILITIES})
            out.append(row)
        s["order"] = [order.window, order.time, order.closed]
        self.state.update((json.dumps(s),))
        return out


def live_updates(readings: DataFrame, needed: Sequence[str], window: int, buckets: int | None = None) -> DataFrame:
    """readings: stay_id, seq, time (seconds), vital_sign, value, p, p1, p2, final, window_id (of finals), as a stream."""
    return over_messages(readings, [LiveUpdates(needed, window)], buckets)
