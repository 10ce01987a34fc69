"""Structured Streaming forms of the window features, alerts and upserts.

Windows are anchored at each stay's intime and each stay has a watermark of its own, so both live in a stateful
operator keyed by stay: applyInPandasWithState, with a stay's open windows, carried values and watermark as its state.
The batch operators give the same rows; tests replay tables as files and compare.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from icuflow.operators.alerts import ALERTS, AlertState
from icuflow.operators.validate import MESSAGE, parsed
from icuflow.streaming.buckets import in_buckets


def file_messages(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """JSON messages from text files, as a stream; from Kafka the same columns come as value (from_json of it cast to string)."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).schema("value string").text(path)
    return parsed(raw, MESSAGE)


def kafka_messages(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """The same from Kafka; needs Spark's Kafka connector on the cluster."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load()
    return parsed(raw, MESSAGE)


def keyed_json(df: DataFrame, key: str) -> DataFrame:
    """key and value as a sink for messages wants them; a column topic, which chooses the stream, stays a column."""
    rest = [c for c in df.columns if c != "topic"]
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*rest)).alias("value"), *(["topic"] if "topic" in df.columns else []))


def append_parquet(df: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    writer = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="5 seconds")).start()


class StayWindows:
    """One stay's open windows. Readings come in any order; a window is final once its end is at or before the watermark."""

    def __init__(self, state: dict | None, vitals: Sequence[str], minutes: int, delay: int):
        s = state or {"open": {}, "carried": {}, "seen": None, "final": -1}
        self.open, self.carried, self.seen, self.final = s["open"], s["carried"], s["seen"], s["final"]
        self.vitals, self.seconds, self.delay = vitals, minutes * 60, delay

    def add(self, start: int, t: float, event: int, vital: str, value: float) -> str | None:
        """A reading at t seconds. Returns why it was refused, if it was."""
        if t < start:
            return "before_admission"
        window = (math.floor(t) - start) // self.seconds
        if window <= self.final:
            return "after_final"
        self.seen = t if self.seen is None else max(self.seen, t)
        if value is not None and value == value:
            own = self.open.setdefault(str(window), {}).setdefault(vital, [0.0, 0, value, value, t, event, value])
            own[0], own[1], own[2], own[3] = own[0] + value, own[1] + 1, min(own[2], value), max(own[3], value)
            if (t, event) >= (own[4], own[5]):
                own[4], own[5], own[6] = t, event, value
        return None

    def closed(self, start: int, everything: bool = False) -> Iterator[dict]:
        """Final windows, in order, with values carried forward."""
        for window in sorted(map(int, self.open)):
            if not everything and start + (window + 1) * self.seconds > self.seen - self.delay:
                break
            own, row = self.open.pop(str(window)), {"window_id": window}
            for v in self.vitals:
                row[f"{v}_missing"] = int(v not in own)
                if v in own:
                    total, n, low, high, _, _, last = own[v]
                    self.carried[v] = [total / n, low, high, last]
                row.update(zip((f"{v}_mean", f"{v}_min", f"{v}_max", f"{v}_last"), self.carried.get(v, [None] * 4), strict=True))
            self.final = window
            yield row

    def state(self) -> dict:
        return {"open": self.open, "carried": self.carried, "seen": self.seen, "final": self.final}


def window_schema(vitals: Sequence[str]) -> str:
    stats = ", ".join(f"{v}_{s} double" for v in vitals for s in ("mean", "min", "max", "last"))
    return f"stay_id long, window_id long, status string, {stats}, " + ", ".join(f"{v}_missing int" for v in vitals)


def final_windows(readings: DataFrame, vitals: Sequence[str], minutes: int, delay_seconds: int = 300, buckets: int | None = None) -> DataFrame:
    """readings: stay_id, intime, charttime, event_id, vital_sign, value. Emits FINAL rows, and a LATE row for each refused reading. State is kept by stay, or for all stays of a bucket together."""
    names = [f.split()[0] for f in window_schema(vitals).split(", ")]

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stays, rows = dict(json.loads(state.get[0])) if state.exists else {}, []
        ordered = pd.concat(list(frames)).sort_values(["stay_id", "t", "event_id"])  # all of the batch: a stay's rows may come in several frames
        for stay_id, own in groupby(ordered.itertuples(index=False), key=lambda r: int(r.stay_id)):
            stay, start = StayWindows(stays.get(stay_id), vitals, minutes, delay_seconds), 0
            for r in own:
                start = int(r.start)
                if stay.add(start, float(r.t), int(r.event_id), r.vital_sign, None if pd.isna(r.value) else float(r.value)):
                    rows.append({"stay_id": stay_id, "window_id": (math.floor(r.t) - start) // (minutes * 60), "status": "LATE"})
            if stay.seen is not None:
                rows += [{"stay_id": stay_id, "status": "FINAL", **row} for row in stay.closed(start)]
            stays[stay_id] = stay.state()
        state.update((json.dumps(list(stays.items())),))
        out = pd.DataFrame(rows, columns=names)
        yield out.astype({c: "Int32" for c in names if c.endswith("_missing")})

    x = readings.select("stay_id", F.unix_timestamp("intime").alias("start"), (F.unix_micros(F.col("charttime").cast("timestamp")) / 1_000_000).alias("t"), "event_id", "vital_sign", "value")
    grouped = in_buckets(x, buckets) if buckets else x.groupBy("stay_id")
    return grouped.applyInPandasWithState(run, window_schema(vitals), "state string", "append", GroupStateTimeout.NoTimeout)


def alert_stream(scores: DataFrame, buckets: int | None = None, **settings) -> DataFrame:
    """scores: stay_id, window_id, p. The machine of operators/alerts.py, its state kept for each stay, or for all stays of a bucket together."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stays, rows = dict(json.loads(state.get[0])) if state.exists else {}, []
        number = lambda x, kind: None if pd.isna(x) else kind(x)
        ordered = pd.concat(list(frames)).sort_values(["stay_id", "window_id", "p"])  # all of the batch: a stay's rows may come in several frames
        for stay, own in groupby(zip(*(ordered[c].tolist() for c in ("stay_id", "window_id", "p")), strict=True), key=lambda r: number(r[0], int)):
            machine = AlertState(*stays.get(stay, ()))
            for _, w, p in own:
                w, p = number(w, int), number(p, float)
                rows.append({"stay_id": stay, "window_id": w, "p": p, **machine.step(w, p, **settings)})
            stays[stay] = [getattr(machine, f) for f in AlertState.FIELDS]
        out = pd.DataFrame(rows, columns=[f.split()[0] for f in ALERTS.split(", ")])
        yield out.astype({"window_id": "Int64", "p": "Float64"})
        state.update((json.dumps(list(stays.items())),))

    x = scores.select("stay_id", "window_id", "p")
    grouped = in_buckets(x, buckets) if buckets else x.groupBy("stay_id")
    return grouped.applyInPandasWithState(run, ALERTS, "state string", "append", GroupStateTimeout.NoTimeout)


def in_slices(df: DataFrame, order: str, path: str, n: int) -> None:
    """The rows as n files in order of time, each written by one task, for the replay of small tables; run_in_steps takes any."""
    t = F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.select(F.percentile_approx(t, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = df.where((F.lit(True) if low is None else t > low) & (F.lit(True) if high is None else t <= high))
        part.coalesce(1).write.mode("append").parquet(path)


def run_in_steps(messages: DataFrame, at: str, n: int, folder: str, made: Callable[[DataFrame], DataFrame], settings: dict[str, str] | None = None, start: Callable[[DataFrame, str], StreamingQuery] | None = None) -> DataFrame | None:
    """The rows in n steps by the number at (about equal ones, ties together), each written in parallel and followed by a run of the stream to its end, from the checkpoint of the step before.

    made: the stream of what to do with the messages; start: how to start it, by default into Parquet, which is returned."""
    spark = messages.sparkSession
    messages.write.parquet(f"{folder}/all")  # made once: the cuts and all steps read it
    messages = spark.read.schema(messages.schema).parquet(f"{folder}/all")
    cuts = messages.select(F.percentile_approx(at, [k / n for k in range(1, n)], 10_000)).first()[0] or [] if n > 1 else []
    before = {k: spark.conf.get(k, None) for k in settings or {}}
    for k, v in (settings or {}).items():
        spark.conf.set(k, v)
    try:
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            part = messages.where((F.lit(True) if low is None else F.col(at) > low) & (F.lit(True) if high is None else F.col(at) <= high))
            part.write.mode("append").parquet(f"{folder}/in")
            stream = made(spark.readStream.schema(messages.schema).parquet(f"{folder}/in"))
            query = start(stream, f"{folder}/checkpoint") if start else append_parquet(stream, f"{folder}/out", f"{folder}/checkpoint", once=True)
            query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return None if start else spark.read.schema(stream.schema).parquet(f"{folder}/out")


def replayed(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)
