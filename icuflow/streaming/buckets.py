"""Stateful operators over one stay's messages, and the same over buckets of stays.

Spark calls an operator once a key and batch, and each look at a state variable is a message to the JVM. With few messages
a stay that costs far more than the work. Bucketed groups by a hash of the stay instead: it reads and writes the states of
a bucket's stays at once and gives each operator the variables it asks for from memory. Stays stay apart, so the rows are
the same. A bucket is written whole by every batch that touches it: choose as many as keep a bucket to some 100 stays.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def typed(rows: list[dict], schema: str) -> pd.DataFrame:
    """Rows as a frame whose columns keep their nulls; columns that a row lacks are null."""
    kinds = {"long": "Int64", "int": "Int32", "double": "Float64", "boolean": "boolean", "timestamp": "datetime64[ns]"}
    fields = [f.split() for f in schema.split(", ")]
    return pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=kinds.get(k, "object")) for c, k in fields})


def ordered(rows: Iterator[pd.DataFrame], *order: str) -> list[dict]:
    frame = pd.concat(list(rows)).sort_values(list(order), kind="stable")
    return frame.astype(object).where(frame.notna(), None).to_dict("records")


class OfStays(StatefulProcessor):
    """An operator whose step takes a stay's messages, in order, and gives rows; expired gives those that a timer makes due."""

    order: tuple[str, ...] = ("seq",)
    schema: str

    def step(self, messages: list[dict]) -> list[dict]:
        raise NotImplementedError

    def expired(self, rang: int, watermark: int) -> list[dict]:
        raise NotImplementedError

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield typed([{"stay_id": key[0], **r} for r in self.step(ordered(rows, *self.order))], self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = self.expired(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        yield typed([{"stay_id": key[0], **r} for r in rows], self.schema)

    def close(self) -> None:
        pass


class _Variable:
    def __init__(self, held: Held, name: str):
        self.held, self.name = held, name

    def exists(self) -> bool:
        return bool(self.held.own.get(self.name))

    def get(self):
        return self.held.own.get(self.name)

    def put(self, value) -> None:
        self.held.own[self.name] = value

    update = put

    def clear(self) -> None:
        self.held.own.pop(self.name, None)


class _Map(_Variable):
    def _all(self) -> dict:
        own = self.held.own.setdefault(self.name, {})
        if isinstance(own, list):  # as it was written
            own = self.held.own[self.name] = dict(own)
        return own

    def containsKey(self, key: tuple) -> bool:
        return key[0] in self._all()

    def getValue(self, key: tuple) -> tuple | None:
        return (self._all()[key[0]],) if key[0] in self._all() else None

    def updateValue(self, key: tuple, value: tuple) -> None:
        self._all()[key[0]] = value[0]

    def removeKey(self, key: tuple) -> None:
        self._all().pop(key[0], None)

    def keys(self) -> Iterator[tuple]:
        return ((k,) for k in list(self._all()))

    def iterator(self) -> Iterator[tuple]:
        return (((k,), (v,)) for k, v in list(self._all().items()))


class Held:
    """What an operator needs of Spark's handle, for one stay's variables in memory. Map keys and values are of one field."""

    def __init__(self):
        self.own: dict = {}

    def getValueState(self, name: str, schema: str) -> _Variable:
        return _Variable(self, name)

    getListState = getValueState

    def getMapState(self, name: str, key_schema: str, value_schema: str) -> _Map:
        return _Map(self, name)

    def registerTimer(self, at: int) -> None:
        self.own["timer"] = at

    def deleteTimer(self, at: int) -> None:
        if self.own.get("timer") == at:
            del self.own["timer"]


class Bucketed(StatefulProcessor):
    """One operator, or several that feed one another, for all stays of a bucket. A bucket's timer is the earliest of its stays'; only the first may set any."""

    def __init__(self, *chain: OfStays):
        self.chain, self.schema = chain, chain[-1].schema

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("stays", "json string")
        self.held = [Held() for _ in self.chain]
        for operator, held in zip(self.chain, self.held, strict=True):
            operator.init(held)

    def _load(self) -> tuple[dict, int | None]:
        found = self.state.get()
        due, stays = json.loads(found[0]) if found else (None, [])
        return dict(stays), due

    def _store(self, stays: dict, before: int | None) -> None:
        due = min((own[0]["timer"] for own in stays.values() if "timer" in own[0]), default=None)
        if due != before:
            if before is not None:
                self.handle.deleteTimer(before)
            if due is not None:
                self.handle.registerTimer(due)
        plain = [(stay, [{k: list(v.items()) if isinstance(v, dict) else v for k, v in own.items()} for own in states]) for stay, states in stays.items()]
        self.state.update((json.dumps([due, plain]),))

    def _onwards(self, stays: dict, stay: int | None, first) -> Iterator[dict]:
        """The rows that first() makes with the stay's variables in place, through all operators."""
        states = stays.setdefault(stay, [{} for _ in self.chain])
        for held, own in zip(self.held, states, strict=True):
            held.own = own
        rows = first()
        for before, operator in zip(self.chain, self.chain[1:]):  # noqa: B905
            rows = operator.step([dict.fromkeys(f.split()[0] for f in before.schema.split(", ")) | r for r in rows]) if rows else []
        return ({"stay_id": stay, **r} for r in rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        (stays, due), made = self._load(), []
        for stay, own in groupby(ordered(rows, "stay_id", *self.chain[0].order), key=lambda m: m["stay_id"]):
            made += self._onwards(stays, None if stay is None else int(stay), lambda own=own: self.chain[0].step(list(own)))
        self._store(stays, due)
        yield typed(made, self.schema)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (stays, due), made, now = self._load(), [], timerValues.getCurrentWatermarkInMs()
        if due == expiredTimerInfo.getExpiryTimeInMs():
            due = None  # the timer that rang is gone by itself
        for stay, own in stays.items():
            if own[0].get("timer", now + 1) <= now:
                made += self._onwards(stays, stay, lambda rang=own[0].pop("timer"): self.chain[0].expired(rang, now))
        self._store(stays, due)
        yield typed(made, self.schema)

    def close(self) -> None:
        pass


def in_buckets(df: DataFrame, buckets: int):
    """Grouped for Bucketed, and for other operators that keep apart the stays of a bucket."""
    return df.withColumn("bucket", F.pmod(F.xxhash64("stay_id"), F.lit(buckets))).groupBy("bucket")


def over_messages(messages: DataFrame, chain: Sequence[OfStays], buckets: int | None, time: str = "None") -> DataFrame:
    """The operators, one after another, over a stream of messages: with a state for each stay, or one for each bucket of them."""
    if buckets:
        return in_buckets(messages, buckets).transformWithStateInPandas(Bucketed(*chain), chain[-1].schema, "Append", time)
    for operator in chain:
        messages = messages.groupBy("stay_id").transformWithStateInPandas(operator, operator.schema, "Append", time)
    return messages
