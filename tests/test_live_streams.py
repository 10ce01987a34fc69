"""Live stays, chains and sinks: bounded state, batches that are cut anywhere or repeated, and rows that are no rows."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from icuflow.operators import parity, splits
from icuflow.operators.alerts import AlertState, PatientState
from icuflow.operators.live import LiveOrder
from icuflow.plans import stays as plans
from icuflow.streaming import chains, sinks, streams
from icuflow.streaming.stays import EMPTY, MESSAGES, ROCKS, Keys, Settings, Stay, live_stays


class Map(dict):
    """The part of a state map that Keys needs."""

    containsKey = dict.__contains__
    updateValue = dict.__setitem__
    getValue = dict.__getitem__
    removeKey = dict.__delitem__


def one_stay(settings=Settings(), intime=0):  # noqa: B008
    core = {**EMPTY, "open": {}, "carried": {}}
    return Stay(core, intime, [], Keys(Map(), Map(), core, settings.remembered), settings, ["hr"])


def reading(at, event, **changes):
    return {"kind": "reading", "at": at, "event_id": event, "charttime": at, "ingested": at, "source_mode": "realtime", "vital_sign": "hr", "value": 1.0, **changes}


def reasons(rows):
    return [(r["kind"], r.get("reason"), r["at"]) for r in rows]


def test_reasons_of_a_reading():
    stay = one_stay()
    offer = lambda m: reasons(stay.offer(m))[-1][1]
    assert offer(reading(10, 1)) == "accepted"
    assert offer(reading(11, 1, charttime=11)) == "duplicate" and offer(reading(12, 2, charttime=10)) == "duplicate"
    assert offer(reading(71, 3, charttime=11)) == "accepted" and offer(reading(75, 4, charttime=14)) == "late"
    assert offer(reading(80, 5, charttime=-1)) == "before_admission" and offer(reading(80, 6, source_mode="replay")) == "mixed_mode"
    assert offer(reading(80, 7, value=None)) == "invalid" and offer(reading(80, 8, charttime=None)) == "invalid"


def test_what_is_due_comes_first_and_in_order():
    stay = one_stay()
    list(stay.offer(reading(10, 1)))
    assert reasons(stay.advance(909)) == [("refresh", None, 310), ("refresh", None, 610)]
    assert reasons(stay.offer(reading(910, 2))) == [("final", "idle", 910), ("reading", "accepted", 910)]
    assert reasons(stay.advance(10**6))[-2:] == [("final", "idle", 1810), ("evicted", None, 910 + 21600)]
    again = list(stay.offer(reading(10**6, 3)))
    assert again[-1]["recovered"] and stay.core["final"] == 3


def test_late_after_final_survives_eviction():
    stay = one_stay()
    list(stay.offer(reading(10, 1, source_mode="replay")))
    list(stay.advance(10**6))
    assert reasons(stay.offer(reading(10**6, 2, charttime=20, source_mode="replay"))) == [("reading", "late_after_final", 10**6)]


def test_discharge_flushes_in_order_and_blocks():
    stay = one_stay()
    for k, t in enumerate((10, 310, 320)):
        list(stay.offer(reading(t, k)))
    list(stay.offer({"kind": "discharge", "at": 330}))
    assert reasons(stay.offer(reading(359, 9)))[-1][1] == "accepted"
    list(stay.offer({"kind": "discharge", "at": 350}))  # doesn't extend the grace
    made = list(stay.offer(reading(360, 10)))
    assert [(r["kind"], r.get("window_id")) for r in made] == [("final", 0), ("final", 1), ("discharged", None), ("reading", None)] and made[-1]["reason"] == "discharged"
    assert stay.due() is None and not stay.keys.seen


def test_waiting_is_bounded_and_expires():
    stay = one_stay(Settings(cap=2), intime=None)
    made = [r for k in range(4) for r in stay.offer(reading(k, k))]
    assert [(r["event_id"], r["reason"]) for r in made] == [(0, "dropped_cap"), (1, "dropped_cap")]
    assert [(r["event_id"], r["reason"]) for r in stay.offer({"kind": "static", "at": 100, "intime": 0})] == [(2, "released"), (3, "released")]
    other = one_stay(intime=None)
    list(other.offer(reading(5, 1)))
    assert reasons(other.offer({"kind": "static", "at": 3605, "intime": 0})) == [("reading", "expired", 3605)]


def test_remembered_keys_are_bounded():
    core = {"first": 0, "next": 0}
    keys = Keys(Map(), Map(), core, 3)
    for k in range(10):
        keys.take(f"i:{k}", f"p:{k}")
    assert len(keys.seen) == len(keys.order) == 6 and keys.known("i:7") and not keys.known("i:6", "p:6")


def replay(spark, tmp_path, rows, steps):
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], MESSAGES)
    folder = str(tmp_path / f"s{steps}")
    out = streams.run_in_steps(df, "at", steps, folder, lambda m: live_stays(m, ["hr"]), dict([ROCKS]))
    return sorted(map(str, out.collect())), folder


def test_any_cut_gives_the_same_rows_and_state_ends(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = [{"stay_id": s, "seq": -1, "at": 1, "kind": "static", "intime": 0} for s in range(3)]
    rows += [{"stay_id": int(s), "seq": k, **reading(int(t), k)} for k, (s, t) in enumerate(zip(rng.integers(0, 3, 60), np.sort(rng.integers(1, 9000, 60)), strict=True))]
    rows.append({"stay_id": -1, "seq": 0, "at": 60_000, "kind": "clock"})
    one, folder = replay(spark, tmp_path, rows, 1)
    four, _ = replay(spark, tmp_path, rows, 4)
    assert one == four
    assert sum("evicted" in r for r in one) == 3, one
    spark.conf.set(*ROCKS)
    try:
        state = spark.read.format("statestore").option("stateVarName", "seen").load(f"{folder}/checkpoint")
        assert state.where("key.stay_id >= 0").count() == 0
    finally:
        spark.conf.unset(ROCKS[0])


def test_machines_refuse_what_is_missing():
    for window, time, content, static in ((None, 1, "a", "s"), (1, None, "a", "s"), (1, math.nan, "a", "s"), (1, math.inf, "a", "s"), (1, 1, None, "s"), (1, 1, "a", None), (-1, 1, "a", "s")):
        state = PatientState()
        assert state.offer(window, time, content, static) == "invalid" and not state.windows
    assert AlertState().step(None, 0.5)["reason"] == "invalid"
    assert LiveOrder().offer(None, 1) == LiveOrder().offer(1, None) == "invalid"


def test_final_of_an_older_window_leaves_the_live_one():
    order = LiveOrder()
    assert order.offer(5, 1) == "accepted" and not order.close(4) and order.offer(5, 2) == "accepted"
    assert order.close(5) and order.offer(5, 3) == "closed" and not order.close(5) and not order.close(None)


def test_ring_forgets_the_oldest(spark, tmp_path):
    rows = [(1, k, k, float(k), [float(k)], "s", False) for k in range(6)] + [(1, 6, 0, 99.0, [0.0], "s", False), (1, 7, 6, None, [1.0], "s", False), (1, 8, 6, 6.0, [math.nan], "s", False), (1, 9, 6, 6.0, [1.0, 2.0], "s", False)]
    df = spark.createDataFrame(rows, "stay_id long, seq long, window_id long, time double, values array<double>, static string, discharged boolean").withColumn("arrived", F.timestamp_seconds("seq"))
    out = streams.run_in_steps(df, "seq", 2, str(tmp_path / "r"), lambda w: chains.processed_windows(w, lambda kept: float(kept.mean()), 1, history=3), dict([ROCKS])).orderBy("seq").collect()
    assert [r.reason for r in out] == ["accepted"] * 6 + ["stale"] + ["invalid"] * 3
    assert [r.n_kept for r in out[:6]] == [1, 2, 3, 3, 3, 3] and out[5].score == 4.0 and out[0].n_padded == 2 and out[5].latency_ms >= 0


def test_topics_of_a_repeated_batch(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", None), (1, "b", "duplicate"), (None, "c", "late")], "stay_id long, event_id string, reason string")
    write = sinks.to_topics(str(tmp_path / "t"))
    for n in (0, 1, 1):
        write(sinks.routed(rows), n)
    got = sinks.from_topics(spark, str(tmp_path / "t"))
    assert got.count() == 6 and {r.topic: r["count"] for r in got.groupBy("topic").count().collect()} == {"observations": 2, "duplicates": 2, "dead_letters": 2}


def test_merged_table_writes_what_it_touches(spark, tmp_path):
    schema = "k long, status string, seq long"
    table = sinks.MergedTable(spark, str(tmp_path / "m"), schema, ["k"], "seq", buckets=16)
    one = lambda *rows: spark.createDataFrame(rows, schema)
    table.merge(spark.range(5000).select(F.col("id").alias("k"), F.lit("UPDATE").alias("status"), F.col("id").alias("seq")), 0)
    whole = table.store.size("data")
    table.merge(one((1, "FINAL", 9), (1, "UPDATE", 10)), 1)
    assert table.store.size("data") - whole < whole / 4
    table.merge(one((1, "UPDATE", 11), (7000, "UPDATE", 1)), 2)
    before = sorted(map(tuple, table.read().collect()))
    table.merge(one((1, "FINAL", 99)), 2)  # a repeated batch
    assert sorted(map(tuple, table.read().collect())) == before and len(before) == 5001 and (1, "FINAL", 9) in before
    for n in range(3, 6):
        table.merge(one((1, "FINAL", 10 + n)), n)
    bucket = [b for v in table.store.names("data") for b in table.store.names(f"data/{v}") if b.startswith("bucket=")]
    assert len(table.manifests()) == 2 and max(bucket.count(b) for b in bucket) <= 2


def test_block_sample(spark, tmp_path):
    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "a/x"))
    spark.range(1000, 1130).coalesce(1).write.parquet(str(tmp_path / "a/y"))
    got = sorted(r.id for r in splits.block_sample(spark.read.parquet(str(tmp_path / "a/x"), str(tmp_path / "a/y")), 3, 200, F.col("id") == 777, most=8).collect())
    blocks = [range(k, k + 200) for k in range(0, 1000, 200)] + [range(1000, 1130)]
    wanted = {777}
    for b in blocks[::3]:
        wanted |= {b[k * (len(b) - 1) // 7] for k in range(8)}
    assert got == sorted(wanted)


def rows_scanned(df):
    plan = df._jdf.queryExecution().executedPlan()
    found, todo = 0, [plan]
    while todo:
        p = todo.pop()
        if p.nodeName().startswith("Scan parquet"):
            found += p.metrics().apply("numOutputRows").value()
        todo += [p.children().apply(k) for k in range(p.children().size())]
    return found


def test_late_materialisation_reads_few_rows(spark, tmp_path):
    df = spark.range(200_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("heavy"))
    parity.sorted_for_keys(df, "id", str(tmp_path / "s"), 4, row_group_bytes=1 << 20)
    keys = spark.createDataFrame([(k,) for k in (5, 7, 150_000)], "id long")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = parity.keyed_rows(spark.read.parquet(str(tmp_path / "s")), keys, "id")
        assert sorted(r.id for r in out.collect()) == [5, 7, 150_000]
        assert rows_scanned(out) < 100_000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert parity.keyed_rows(df, keys.limit(0), "id").count() == 0
    assert parity.keyed_rows(df, df.where("id % 3 = 0").select("id"), "id").count() == 66_667


def test_counters_are_by_batch():
    c = sinks.Counters("x")
    c.batches = {0: {"n": 2, "late": None}, 1: {"n": 3, "late": 1}}
    c.batches[1] = {"n": 3, "late": 1}
    assert c.total() == {"n": 5, "late": 1}


@pytest.mark.parametrize("name", ["stream_timers"])
def test_settings_of_production(name):
    assert Settings() == Settings(300, 300, 60, 300, 900, 21_600, 3600, 1000, 30, 5000) and plans.QUERIES[name]


def test_typed_frames_keep_nulls():
    from icuflow.streaming.stays import typed

    frame = typed([{"a": 1}, {"b": None}], "a long, b double, c boolean")
    assert frame.a.tolist()[0] == 1 and frame.isna().sum().tolist() == [1, 2, 2] and isinstance(frame, pd.DataFrame)
