"""Streams whose state is kept by bucket give the rows of a state for each stay, and call the operator once a bucket."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from icuflow.operators.alerts import alert_machine
from icuflow.streaming import chains, sinks, streams
from icuflow.streaming.stays import MESSAGES, ROCKS, live_stays


def keys_of(spark, folder, name):
    spark.conf.set(*ROCKS)
    try:
        return spark.read.format("statestore").option("stateVarName", name).load(f"{folder}/checkpoint").count()
    finally:
        spark.conf.unset(ROCKS[0])


def both(tmp_path, df, at, made, steps=3):
    """Rows with a state a stay, rows with two buckets, and the latter's folder."""
    out = [streams.run_in_steps(df, at, steps, str(tmp_path / f"b{n}"), lambda m, n=n: made(m, n), dict([ROCKS])).drop("latency_ms") for n in (None, 2)]
    return *(sorted(map(str, o.collect())) for o in out), str(tmp_path / "b2")


def test_live_stays_by_bucket(spark, tmp_path):
    rng = np.random.default_rng(5)
    names = [f.split()[0] for f in MESSAGES.split(", ")]
    rows = [{"stay_id": s, "seq": -1, "at": 300 * s + 1, "kind": "static", "intime": 0} for s in range(6)]
    rows += [{"stay_id": int(s), "seq": k, "kind": "reading", "at": int(t), "event_id": k // 2, "charttime": int(t), "ingested": int(t), "source_mode": "realtime", "vital_sign": "hr", "value": float(k)} for k, (s, t) in enumerate(zip(rng.integers(0, 7, 150), np.sort(rng.integers(1, 40_000, 150)), strict=True))]
    rows += [{"stay_id": 2, "seq": 999, "at": 9000, "kind": "discharge"}, {"stay_id": -1, "seq": 0, "at": 90_000, "kind": "clock"}]
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], MESSAGES)
    by_stay, by_bucket, folder = both(tmp_path, df, "at", lambda m, n: live_stays(m, ["hr"], buckets=n))
    assert by_stay == by_bucket and any("evicted" in r for r in by_stay) and any("expired" in r for r in by_stay) and any("discharged" in r for r in by_stay)
    assert keys_of(spark, folder, "stays") == 2  # not one for each of eight stays


def test_chains_by_bucket(spark, tmp_path):
    w = spark.range(200).select((F.col("id") % 9).alias("stay_id"), F.col("id").alias("seq"), F.floor(F.col("id") / 10).alias("window_id"), F.when(F.col("id") % 17 > 0, F.col("id").cast("double")).alias("time"), F.array((F.col("id") % 7).cast("double")).alias("values"), F.lit("s").alias("static"), (F.col("id") == 120).alias("discharged"))
    made = lambda x, n: chains.processed_windows(x.withColumn("arrived", F.timestamp_seconds("seq")), lambda kept: float(kept[-1, 0]) / 7, 1, history=3, buckets=n)
    by_stay, by_bucket, _ = both(tmp_path, w, "seq", made, 2)
    assert by_stay == by_bucket and len(by_stay) == 200 and any("discharged" in r for r in by_stay)
    r = spark.range(200).select((F.col("id") % 9).alias("stay_id"), F.col("id").alias("seq"), (F.floor(F.col("id") / 20) * 10).alias("time"), F.when(F.col("id") % 4 < 2, "a").otherwise("b").alias("vital_sign"), F.col("id").cast("double").alias("value"), F.lit(0.5).alias("p"), F.lit(0.1).alias("p1"), F.lit(None).cast("double").alias("p2"), (F.col("id") % 31 == 0).alias("final"), F.floor(F.col("id") / 60).alias("window_id"))
    by_stay, by_bucket, _ = both(tmp_path / "u", r, "seq", lambda x, n: chains.live_updates(x, ["a", "b"], 30, n), 2)
    assert by_stay == by_bucket and len(by_stay) == 200 and any("initial" in x for x in by_stay)


def test_hygiene_by_bucket(spark, tmp_path):
    x = spark.range(120).select((F.col("id") % 7).alias("stay_id"), F.col("id").alias("seq"), (F.col("id") % 35).cast("string").alias("event_id"), F.lit("hr").alias("vital_sign"), F.lit(1.0).alias("value"), F.when(F.col("id") % 11 == 10, "replay").otherwise("realtime").alias("source_mode"), F.timestamp_seconds(F.col("id")).alias("charttime"), F.timestamp_seconds(F.col("id") + F.when(F.col("id") % 13 == 0, 90).otherwise(1)).alias("ingestion_time"), F.lit(None).cast("string").alias("reason"))
    by_stay, by_bucket, _ = both(tmp_path, x, "seq", lambda m, n: sinks.clean_and_rejected(m, buckets=n))
    assert by_stay == by_bucket and {k for k in ("duplicate", "late", "mixed_mode") if any(k in r for r in by_stay)} == {"duplicate", "late", "mixed_mode"}


@pytest.mark.parametrize("n", [None, 2])
def test_alerts_and_windows_by_bucket(spark, tmp_path, n):
    df = spark.range(300).select((F.col("id") % 11).alias("stay_id"), F.floor(F.col("id") / 11).alias("window_id"), F.round((F.sin(F.col("id") * 1.7) + 1) / 4, 6).alias("p"))
    got = streams.run_in_steps(df, "window_id", 3, str(tmp_path / "a"), lambda s: streams.alert_stream(s, n), dict([ROCKS]))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, alert_machine(df).select(*got.columns).collect()))
    r = df.select("stay_id", F.timestamp_seconds(F.lit(0)).alias("intime"), F.timestamp_seconds(F.col("window_id") * 200).alias("charttime"), F.col("window_id").alias("event_id"), F.lit("hr").alias("vital_sign"), F.col("p").alias("value"), (F.col("window_id") * 200).alias("at"))
    got = streams.run_in_steps(r, "at", 3, str(tmp_path / "w"), lambda x: streams.final_windows(x, ["hr"], 5, 300, n), dict([ROCKS]))
    assert {(x.stay_id, x.window_id) for x in got.collect()} == {(s, w) for s in range(11) for w in range(17 if s < 3 else 16)} and {x.status for x in got.collect()} == {"FINAL"}


def test_no_task_writes_a_whole_step(spark, tmp_path):
    df = spark.range(0, 1000, 1, 4).select((F.col("id") % 11).alias("stay_id"), F.col("id").alias("window_id"), F.lit(0.1).alias("p"))
    streams.run_in_steps(df, "window_id", 1, str(tmp_path / "s"), lambda s: streams.alert_stream(s, 4), dict([ROCKS]))
    assert len(list((tmp_path / "s/all").glob("*.parquet"))) == 4 and len(list((tmp_path / "s/out").glob("*.parquet"))) > 1
