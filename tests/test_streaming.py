"""Replayed streams give what batch gives, upserts keep FINAL rows, files read back."""

import pytest
from pyspark.sql import functions as F

from icuflow.operators.alerts import alert_machine
from icuflow.sources import files
from icuflow.streaming import streams


def test_alert_stream_is_batch(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 3).alias("stay_id"), F.floor(F.col("id") / 3).alias("window_id"), F.round((F.sin(F.col("id") * 1.7) + 1) / 4, 6).alias("p"), F.timestamp_seconds("id").alias("at"))
    streams.in_slices(df, "at", str(tmp_path / "in"), 3)
    made = streams.alert_stream(streams.replayed(df, str(tmp_path / "in")).select("stay_id", "window_id", "p"))
    streams.append_parquet(made, str(tmp_path / "out"), str(tmp_path / "cp"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    wanted = alert_machine(df.select("stay_id", "window_id", "p")).select(*got.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, wanted.collect()))


def test_windows_refuse_what_is_final():
    s = streams.StayWindows(None, ["hr"], 5, 300)
    assert s.add(0, 10, 1, "hr", 1.0) is None and s.add(0, -1, 2, "hr", 1.0) == "before_admission"
    assert s.add(0, 599, 3, "hr", 2.0) is None and not [*s.closed(0)]
    assert s.add(0, 600, 4, "hr", 3.0) is None and [r["window_id"] for r in s.closed(0)] == [0]
    assert s.add(0, 20, 5, "hr", 9.0) == "after_final"
    assert [r["window_id"] for r in s.closed(0, everything=True)] == [1, 2]


def test_sinks(spark, tmp_path):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"))
    assert files.write_parquet(df, str(tmp_path / "p"), rows_per_file=100) == 1000
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        files.write_parquet(df, str(tmp_path / "p"), mode="errorifexists")
    files.save_artifact(spark, {"weight": 0.48, "names": ["a"]}, str(tmp_path / "a"))
    assert files.load_artifact(spark, str(tmp_path / "a")) == {"weight": 0.48, "names": ["a"]}
    ok = spark.createDataFrame([("a", True), ("b", False)], "c string, ok boolean")
    assert not files.gated_write(df, ok, str(tmp_path / "g")) and files.gated_write(df, ok.where("ok"), str(tmp_path / "g"))
    files.write_metrics(df.limit(3), str(tmp_path / "m"))
    assert files.read_csv(spark, str(tmp_path / "m"), "id long, x long").count() == 3
