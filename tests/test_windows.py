"""Windows, carried values and checkpoints on hand-made rows."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from icuflow.operators import sequences, windows

START = datetime(2024, 1, 1)


def frames(spark, readings):
    obs = spark.createDataFrame([(1, START + timedelta(seconds=s), v, x, k) for k, (s, v, x) in enumerate(readings)], "stay_id long, charttime timestamp, vital_sign string, value double, event_id long")
    return obs, spark.createDataFrame([(1, START)], "stay_id long, intime timestamp")


def made(spark, readings):
    obs, stays = frames(spark, readings)
    return {r["window_id"]: r for r in windows.window_features(obs, stays, ["hr", "map", "rr"], 5).collect()}


def test_boundary_gap_ties_and_missing(spark):
    got = made(spark, [(0, "hr", 80.0), (0, "hr", 82.0), (300, "hr", 90.0), (1500, "map", 70.0), (-1, "hr", 1.0), (310, "rr", float("nan"))])
    assert sorted(got) == [0, 1, 5]
    assert got[0]["hr_last"] == 82.0 and got[0]["hr_mean"] == 81.0 and got[0]["map_missing"] == 1
    assert got[1]["hr_trend"] == 0.0 and got[1]["rr_missing"] == 1 and got[1]["rr_last"] is None
    assert got[5]["hr_last"] == 90.0 and got[5]["hr_missing"] == 1 and got[5]["total_last"] == 160.0


def test_joined_form_is_equal(spark):
    obs, stays = frames(spark, [(0, "hr", 1.0), (10, "map", 2.0), (400, "rr", 3.0), (401, "hr", 4.0)])
    a, b = (windows.window_features(obs, stays, ["hr", "map", "rr"], 5, joined=j) for j in (False, True))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_adaptive_checkpoints(spark):
    for n in (1, 11, 12, 13, 24, 25, 120):
        df = spark.range(1, n + 1).select(F.col("id").alias("p"), F.lit(n).alias("n"))
        kept = [r[0] for r in df.where(windows.adaptive_checkpoint("p", "n", 12)).orderBy("p").collect()]
        k = min(n, 12)
        assert kept == [p for p in range(1, n + 1) if -(-p * k // n) != -(-(p - 1) * k // n) or p == n]
        assert kept[-1] == n


def test_padding_and_truncation(spark):
    df = spark.range(10).select(F.lit(1).alias("stay_id"), F.col("id").alias("window_id"), F.array(F.col("id").cast("double")).alias("temporal_row"), F.array(F.lit(0)).alias("mask_row"))
    rows = {r["terminal_window_id"]: r for r in sequences.tensors(sequences.histories(df, 8), 8, 1).withColumn("ok", sequences.integrity(8, 1)).collect()}
    assert all(r["ok"] for r in rows.values())
    assert rows[2]["padding_mask"] == [0, 0, 0, 1, 1, 1, 1, 1] and rows[7]["padding_mask"] == [0] * 8
    assert rows[9]["temporal"][0] == [2.0] and rows[9]["temporal"][-1] == [9.0]
