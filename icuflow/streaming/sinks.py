"""Sinks of micro-batches that a repeated batch leaves as they were: several topics at once, tables merged by key, counts.

Paths may be in any store that Spark writes to; listing, renaming and deleting go through its file systems.
"""

from __future__ import annotations

import json
import threading
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from icuflow.operators.serving import merged_into
from icuflow.operators.validate import REMEMBERED
from icuflow.streaming.buckets import OfStays, over_messages
from icuflow.streaming.stays import Keys
from icuflow.streaming.streams import keyed_json


class Store:
    """The few file operations that the sinks need."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, jvm = root.rstrip("/"), spark._jvm
        self.path = lambda p: jvm.org.apache.hadoop.fs.Path(f"{self.root}/{p}")
        self.fs = self.path("x").getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        at = self.path(folder)
        return [f.getPath().getName() for f in self.fs.listStatus(at)] if self.fs.exists(at) else []

    def put(self, name: str, text: str) -> None:
        """All of it or nothing: written aside, then renamed."""
        out = self.fs.create(self.path(f"{name}.tmp"), True)
        out.write(bytearray(text.encode()))
        out.close()
        if not self.fs.rename(self.path(f"{name}.tmp"), self.path(name)):
            raise OSError(f"{self.root}/{name} can't be put in place")

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        return self.fs.getContentSummary(self.path(name)).getLength()


def to_topics(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: rows of (key, value, topic) under path/batch=n/topic=..., all topics in one write. A repeated batch overwrites its own folder only."""

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").partitionBy("topic").parquet(f"{path}/batch={n}")

    return write


def from_topics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("key string, value string, batch int, topic string").option("basePath", path).parquet(path)


class MergedTable:
    """A table with one row a key, FINAL rows never replaced by UPDATE ones, dealt to buckets by key.

    A batch reads and writes only the buckets that it touches, as data/v=n/bucket=b; manifests/n says which version of
    each bucket is valid after batch n, and is put in place last. A batch up to the last manifest isn't done again, so
    repeats change nothing. What neither of the last two manifests names is deleted: a reader of the former one goes on."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], sequence: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.keys, self.sequence, self.buckets = spark, path.rstrip("/"), schema, list(keys), sequence, buckets
        self.store = Store(spark, path)

    def manifests(self) -> list[int]:
        return sorted(int(n) for n in self.store.names("manifests") if n.isdigit())

    def manifest(self, n: int) -> dict[int, int]:
        text = "".join(r[0] for r in self.spark.read.text(f"{self.path}/manifests/{n}").collect())
        return {int(b): v for b, v in json.loads(text).items()}

    def _read(self, versions: dict[int, int]) -> DataFrame:
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(versions.items())]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def read(self) -> DataFrame:
        known = self.manifests()
        return self._read(self.manifest(known[-1]) if known else {})

    def merge(self, batch: DataFrame, n: int) -> None:
        """For foreachBatch."""
        known = self.manifests()
        if known and n <= known[-1]:
            return
        bucket = F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")
        names = self._read({}).columns
        rows = batch.select(*names).persist()
        try:
            touched = [r[0] for r in rows.select(bucket).distinct().collect()]  # at most so many as there are buckets
            now = self.manifest(known[-1]) if known else {}
            merged = merged_into(self._read({b: v for b, v in now.items() if b in touched}), rows, self.keys, self.sequence)
            merged.withColumn("bucket", bucket).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={n}")
        finally:
            rows.unpersist()
        now |= dict.fromkeys(touched, n)
        self.store.put(f"manifests/{n}", json.dumps(now))
        self._clean([*known, n][-2:])

    def _clean(self, kept: list[int]) -> None:
        needed = {(v, b) for m in kept for b, v in self.manifest(m).items()}
        for version in self.store.names("data"):
            own = [b for b in self.store.names(f"data/{version}") if b.startswith("bucket=")]
            old = [b for b in own if (int(version[2:]), int(b[7:])) not in needed]
            for name in [f"data/{version}"] if len(old) == len(own) else [f"data/{version}/{b}" for b in old]:
                self.store.delete(name)
        for m in self.manifests():
            if m not in kept:
                self.store.delete(f"manifests/{m}")


class Counters(StreamingQueryListener):
    """Counts that observe() takes of every batch, by batch: a repeated batch replaces its own."""

    def __init__(self, name: str):
        super().__init__()
        self.name, self.batches, self.ended = name, {}, threading.Event()

    def onQueryStarted(self, event) -> None:
        self.ended.clear()

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get(self.name)
        if found is not None:
            self.batches[event.progress.batchId] = found.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.set()

    def total(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for counts in self.batches.values():
            for k, v in counts.items():
                out[k] = out.get(k, 0) + (v or 0)
        return out


JUDGED = "stay_id long, seq long, event_id string, vital_sign string, value double, reason string"


class Hygiene(OfStays):
    """Of valid messages of a stay: its source mode must not change, realtime ones must not be late, and neither an event id nor a (vital, time) comes twice."""

    schema, order = JUDGED, ("ingested", "seq")

    def __init__(self, lateness: int, remembered: int):
        self.lateness, self.remembered = lateness, remembered

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.core = handle.getValueState("core", "json string")
        self.seen, self.places = handle.getMapState("seen", "key string", "n long"), handle.getMapState("order", "n long", "key string")

    def step(self, messages: list[dict]) -> list[dict]:
        core = json.loads(self.core.get()[0]) if self.core.exists() else {"mode": None, "first": 0, "next": 0}
        keys, out = Keys(self.seen, self.places, core, self.remembered), []
        for m in messages:
            names = (f"i:{m['event_id']}", f"p:{m['vital_sign']}:{m['charted']}")
            reason = None
            if core["mode"] not in (None, m["source_mode"]):
                reason = "mixed_mode"
            else:
                core["mode"] = m["source_mode"]
                if m["source_mode"] == "realtime" and m["ingested"] - m["charted"] > self.lateness:
                    reason = "late"
                elif keys.known(*names):
                    reason = "duplicate"
                else:
                    keys.take(*names)
            out.append({"reason": reason, **{c: m[c] for c in ("seq", "event_id", "vital_sign", "value")}})
        self.core.update((json.dumps(core),))
        return out


def clean_and_rejected(judged: DataFrame, lateness: int = 60, remembered: int = REMEMBERED, buckets: int | None = None) -> DataFrame:
    """judged: messages with the reason of operators/validate.py, and seq, as a stream. Every message once, with the reason that refused it, or null."""
    names = [f.split()[0] for f in JUDGED.split(", ")]
    valid = judged.where("reason is null").withColumns({"charted": F.unix_timestamp("charttime"), "ingested": F.unix_timestamp("ingestion_time")})
    kept = over_messages(valid.select("stay_id", "seq", "event_id", "vital_sign", "value", "source_mode", "charted", "ingested"), [Hygiene(lateness, remembered)], buckets)
    return kept.unionByName(judged.where("reason is not null").select(*names))


def routed(messages: DataFrame) -> DataFrame:
    """Messages with a reason as keyed JSON for topics: observations, duplicates, and dead letters with their reason as type."""
    topic = F.when(F.col("type").isNull(), "observations").when(F.col("type") == "duplicate", "duplicates").otherwise("dead_letters")
    return keyed_json(messages.withColumnRenamed("reason", "type").withColumn("topic", topic), "stay_id")


def for_each(write: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, str], StreamingQuery]:
    """How to start a stream into write, to the end of what is there."""
    return lambda stream, checkpoint: stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
