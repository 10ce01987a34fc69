"""Live stays: one stateful operator with timers for what a stay's messages do between admission and discharge.

Messages of three kinds share a stream keyed by stay: static rows, readings and discharges. at is their time of arrival,
in seconds, and the watermark follows it. What is due at some time (idle windows, refreshes, eviction, the end of the
wait for a static row, a discharge) is done before any message that arrives at or after that time, and by a timer if none
does, so the rows don't depend on how the stream is cut into batches.

State, a variable for each concern: static (intime), waiting (a bounded queue), seen and order (bounded keys), core
(open windows, carried values, times). Eviction and discharge clear all but the last final window and the tombstone.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle

from icuflow.streaming.buckets import OfStays, over_messages, typed  # noqa: F401  (typed is used from here, too)

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass(frozen=True)
class Settings:
    """Production settings, in seconds and numbers of rows."""

    window: int = 300
    watermark: int = 300
    lateness: int = 60
    refresh: int = 300
    idle: int = 900
    evict: int = 6 * 3600
    ttl: int = 3600
    cap: int = 1000
    grace: int = 30
    remembered: int = 5000


MESSAGES = "stay_id long, seq long, at long, kind string, intime long, event_id long, charttime long, ingested long, source_mode string, vital_sign string, value double"
EMPTY = {"open": {}, "carried": {}, "final": None, "mode": None, "newest": None, "seen_at": None, "refresh_at": None, "waiting_at": None, "discharge_at": None, "discharged": False, "evicted": False, "live": None, "first": 0, "next": 0, "timer": None}


class Keys:
    """The last keys taken, in a pair of maps: key to number, and number to key."""

    def __init__(self, seen, order, core: dict, most: int):
        self.seen, self.order, self.core, self.most = seen, order, core, most

    def known(self, *keys: str) -> bool:
        return any(self.seen.containsKey((k,)) for k in keys)

    def take(self, *keys: str) -> None:
        for k in keys:
            self.seen.updateValue((k,), (self.core["next"],))
            self.order.updateValue((self.core["next"],), (k,))
            self.core["next"] += 1
        while self.core["next"] - self.core["first"] > self.most * len(keys):
            old = self.order.getValue((self.core["first"],))[0]
            self.seen.removeKey((old,))
            self.order.removeKey((self.core["first"],))
            self.core["first"] += 1


class Stay:
    """One stay between loading and storing its state. Every step returns rows as dictionaries."""

    def __init__(self, core: dict, intime: int | None, waiting: list[dict], keys: Keys, settings: Settings, vitals: Sequence[str]):
        self.core, self.intime, self.waiting, self.keys, self.s, self.vitals = core, intime, waiting, keys, settings, vitals

    def due(self) -> tuple[int, str] | None:
        """The earliest thing to do, and when. At the same time a discharge comes first, and eviction last."""
        c, s = self.core, self.s
        times = [(c["discharge_at"], "discharge"), (None if c["waiting_at"] is None else c["waiting_at"] + s.ttl, "expire")]
        if c["seen_at"] is not None:
            if c["open"]:
                times.append((c["seen_at"] + s.idle, "idle"))
                if c["live"] is not None and str(c["live"]) in c["open"] and c["mode"] == "realtime":
                    times.append((c["refresh_at"] + s.refresh, "refresh"))
            else:
                times.append((c["seen_at"] + s.evict, "evict"))
        return min(((t, k) for t, k in times if t is not None), key=lambda x: (x[0], ("discharge", "expire", "idle", "refresh", "evict").index(x[1])), default=None)

    def advance(self, now: int) -> Iterator[dict]:
        while (found := self.due()) and found[0] <= now:
            yield from getattr(self, f"on_{found[1]}")(found[0])

    def on_discharge(self, at: int) -> Iterator[dict]:
        yield from self.finals(at, "discharge", everything=True)
        yield from ({"kind": "reading", "at": at, "event_id": r["event_id"], "reason": "dropped_discharge"} for r in self.waiting)
        yield {"kind": "discharged", "at": at}
        self.clear()
        self.core["discharged"], self.core["discharge_at"], self.intime = True, None, None

    def on_expire(self, at: int) -> Iterator[dict]:
        yield from ({"kind": "reading", "at": at, "event_id": r["event_id"], "reason": "expired"} for r in self.waiting)
        self.waiting, self.core["waiting_at"] = [], None

    def on_idle(self, at: int) -> Iterator[dict]:
        yield from self.finals(at, "idle", everything=True)

    def on_refresh(self, at: int) -> Iterator[dict]:
        self.core["refresh_at"] = at
        yield {"kind": "refresh", "at": at, "window_id": self.core["live"], **self.values(self.core["open"][str(self.core["live"])])}

    def on_evict(self, at: int) -> Iterator[dict]:
        yield {"kind": "evicted", "at": at}
        self.clear()
        self.core["evicted"] = True

    def clear(self) -> None:
        kept = {k: self.core[k] for k in ("final", "discharge_at", "discharged", "timer", "waiting_at")}
        self.core.clear()
        self.core.update(json.loads(json.dumps(EMPTY)) | kept)
        self.keys.seen.clear()
        self.keys.order.clear()
        if self.core["discharge_at"] is not None or self.core["discharged"]:
            self.waiting, self.core["waiting_at"] = [], None

    def values(self, window: dict) -> dict:
        """Statistics of a window; of vitals that it lacks, those of the last final window that had them."""
        row = {}
        for v in self.vitals:
            row[f"{v}_missing"] = int(v not in window)
            total, n, low, high, _, _, last = window.get(v, [0.0, 1, None, None, 0, 0, None])
            row.update(zip((f"{v}_{x}" for x in ("mean", "min", "max", "last")), [total / n, low, high, last] if v in window else self.core["carried"].get(v, [None] * 4), strict=True))
        return row

    def finals(self, at: int, reason: str, everything: bool = False) -> Iterator[dict]:
        c, s = self.core, self.s
        for w in sorted(map(int, c["open"])):
            if not everything and self.intime + (w + 1) * s.window > c["newest"] - s.watermark:
                break
            row = self.values(own := c["open"].pop(str(w)))
            c["carried"].update({v: [row[f"{v}_{x}"] for x in ("mean", "min", "max", "last")] for v in own})
            c["final"] = w if c["final"] is None else max(w, c["final"])
            yield {"kind": "final", "at": at, "window_id": w, "reason": reason, **row}

    def offer(self, m: dict) -> Iterator[dict]:
        yield from self.advance(m["at"])
        if m["kind"] == "static":
            if self.intime is None and not self.core["discharged"]:
                self.intime = m["intime"]
            ready, self.waiting, self.core["waiting_at"] = self.waiting, [], None
            for r in ready:
                yield from self.read(r, m["at"], released=True)
        elif m["kind"] == "discharge":
            if not self.core["discharged"] and self.core["discharge_at"] is None:
                self.core["discharge_at"] = m["at"] + self.s.grace
        elif m["kind"] == "reading":
            if self.core["discharged"]:
                yield {"kind": "reading", "at": m["at"], "event_id": m["event_id"], "reason": "discharged"}
            elif self.intime is None:
                if len(self.waiting) >= self.s.cap:
                    yield {"kind": "reading", "at": m["at"], "event_id": self.waiting.pop(0)["event_id"], "reason": "dropped_cap"}
                self.waiting.append(m)
                self.core["waiting_at"] = m["at"]
            else:
                yield from self.read(m, m["at"])

    def refusal(self, m: dict) -> str | None:
        c = self.core
        if None in (m["charttime"], m["ingested"], m["vital_sign"], m["value"], m["event_id"]):
            return "invalid"
        if c["mode"] is not None and c["mode"] != m["source_mode"]:
            return "mixed_mode"
        c["mode"] = m["source_mode"]
        if m["charttime"] < self.intime:
            return "before_admission"
        if m["source_mode"] == "realtime" and m["ingested"] - m["charttime"] > self.s.lateness:
            return "late"
        if c["final"] is not None and (m["charttime"] - self.intime) // self.s.window <= c["final"]:
            return "late_after_final"
        if self.keys.known(f"i:{m['event_id']}", f"p:{m['vital_sign']}:{m['charttime']}"):
            return "duplicate"
        return None

    def read(self, m: dict, at: int, released: bool = False) -> Iterator[dict]:
        c, why = self.core, self.refusal(m)
        window = None if m["charttime"] is None else (m["charttime"] - self.intime) // self.s.window
        if why:
            yield {"kind": "reading", "at": at, "event_id": m["event_id"], "window_id": window, "reason": why}
            return
        self.keys.take(f"i:{m['event_id']}", f"p:{m['vital_sign']}:{m['charttime']}")
        v, t = m["value"], [m["charttime"], m["event_id"]]
        own = c["open"].setdefault(str(window), {}).setdefault(m["vital_sign"], [0.0, 0, v, v, *t, v])
        own[0], own[1], own[2], own[3] = own[0] + v, own[1] + 1, min(own[2], v), max(own[3], v)
        if t >= own[4:6]:
            own[4:7] = [*t, v]
        yield {"kind": "reading", "at": at, "event_id": m["event_id"], "window_id": window, "reason": "released" if released else "accepted", "recovered": c["evicted"]}
        c["evicted"], c["seen_at"], c["refresh_at"], c["live"] = False, at, at, window
        c["newest"] = m["charttime"] if c["newest"] is None else max(c["newest"], m["charttime"])
        yield from self.finals(at, "watermark")


def stay_schema(vitals: Sequence[str]) -> str:
    stats = ", ".join(f"{v}_{s} double" for v in vitals for s in ("mean", "min", "max", "last"))
    return f"stay_id long, at long, kind string, event_id long, window_id long, reason string, recovered boolean, {stats}, " + ", ".join(f"{v}_missing int" for v in vitals)


class StayProcessor(OfStays):
    """Loads a stay's state, feeds it with what has come or become due, and stores it with a timer for what is due next."""

    def __init__(self, settings: Settings, vitals: Sequence[str]):
        self.settings, self.vitals = settings, list(vitals)
        self.schema, self.order = stay_schema(vitals), ("at", "seq")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.static, self.core = handle.getValueState("static", "intime long"), handle.getValueState("core", "json string")
        self.waiting = handle.getListState("waiting", "json string")
        self.seen, self.places = handle.getMapState("seen", "key string", "n long"), handle.getMapState("order", "n long", "key string")

    def _load(self) -> Stay:
        core = json.loads(json.dumps(EMPTY)) | (json.loads(self.core.get()[0]) if self.core.exists() else {})
        waiting = [json.loads(r[0]) for r in self.waiting.get()] if self.waiting.exists() else []
        return Stay(core, self.static.get()[0] if self.static.exists() else None, waiting, Keys(self.seen, self.places, core, self.settings.remembered), self.settings, self.vitals)

    def _store(self, stay: Stay) -> None:
        due, before = stay.due(), stay.core["timer"]
        after = due and due[0]
        if before != after:
            if before is not None:
                self.handle.deleteTimer(before * 1000)
            if after is not None:
                self.handle.registerTimer(after * 1000)
        stay.core["timer"] = after
        self.core.update((json.dumps(stay.core),))
        self.static.update((stay.intime,)) if stay.intime is not None else self.static.clear()
        self.waiting.put([(json.dumps(r),) for r in stay.waiting]) if stay.waiting else self.waiting.clear()

    def step(self, messages: list[dict]) -> list[dict]:
        stay, made = self._load(), []
        for m in messages:
            made += stay.offer({k: int(v) if k in ("at", "seq", "intime", "event_id", "charttime", "ingested") and v is not None else v for k, v in m.items() if k not in ("stay_id", "arrived", "bucket")})
        self._store(stay)
        return made

    def expired(self, rang: int, watermark: int) -> list[dict]:
        stay = self._load()
        if stay.core["timer"] == rang // 1000:
            stay.core["timer"] = None  # the timer that rang is gone by itself
        made = list(stay.advance(watermark // 1000))  # and what this makes due before the watermark, as no message can come before it
        self._store(stay)
        return made


def live_stays(messages: DataFrame, vitals: Sequence[str], settings: Settings = Settings(), delay: str = "60 seconds", buckets: int | None = None) -> DataFrame:  # noqa: B008
    """messages: the columns of MESSAGES, as a stream. Rows of what became of readings, windows and stays. Needs RocksDB as the session's state store (ROCKS)."""
    x = messages.withColumn("arrived", F.timestamp_seconds("at")).withWatermark("arrived", delay)
    return over_messages(x, [StayProcessor(settings, vitals)], buckets, "EventTime")
