"""What shows only on larger tables: last bits of means, and how much a job writes."""

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from icuflow.operators import changes, ensemble, metrics, parity, resampling
from icuflow.plans import catalog, exchange, features
from icuflow.sources import telemetry


def test_changes_that_differ_in_the_last_bit_stand_in_the_order_of_names(spark):
    rows = [(1, 0, 1.0, 1.0, [0.0, 0.0]), (1, 1, 2.0, 2.0, [0.3, 0.1 + 0.2])]
    df = spark.createDataFrame(rows, "stay_id long, window_id long, a double, b double, attributions array<double>")
    assert [r["feature"] for r in changes.changed_features(df, ["a", "b"], 2).orderBy("rank").collect()] == ["a", "b"]


def test_causal_parity_reads_windows_that_were_made_once(spark, monkeypatch):
    made = features.features

    def trembling(*args, **kwargs):
        return made(*args, **kwargs).withColumns({c: F.col(c) + F.rand() * 1e-9 for c in features.MEANS})

    monkeypatch.setattr(features, "features", trembling)
    monkeypatch.setattr(exchange, "features", trembling)
    got = catalog.QUERIES["causal_parity"](spark, DATA)
    assert got.where(F.col("same") != (F.col("terminal_window_id") % 4 != 0)).isEmpty()


def test_draws_travel_as_hashes_and_few_fixes(spark):
    g = spark.range(3000).select(F.col("id").alias("stay_id"))
    r = resampling.draws(g, "stay_id", 200).agg(F.count("*").alias("n"), F.sum(F.size("fixes")).alias("fixes")).first()
    # one count a group and replicate would be 600,000 numbers
    assert r["n"] == 3000 and r["fixes"] < 20_000


@pytest.mark.parametrize("at_once", [1 << 27, 1])
def test_blends_in_one_pass_and_in_many_count_repeated_pairs(spark, monkeypatch, at_once):
    monkeypatch.setattr(ensemble, "PASS_SCORES", at_once)
    rows = [(i % 7 / 7, i * i % 11 / 11, int(i * 5 % 17 < 6)) for i in range(300)] + [(None, 0.5, 1), (0.5, None, 0), (0.2, 0.3, None)]
    df = spark.createDataFrame(rows, "p1 double, p2 double, label int")
    got = {round(r["weight"] * 4): r for r in ensemble.blend_grid(df, "p1", "p2", 4).collect()}
    for k in range(5):
        x = df.dropna().select("label", F.round(k / 4 * F.col("p1") + (1 - k / 4) * F.col("p2"), 12).alias("p"))
        a, b = metrics.ranking_metrics(x, "p").first(), metrics.probability_metrics(x, "p").first()
        for c, r in (("roc_auc", a), ("average_precision", a), ("brier", b), ("log_loss", b)):
            assert got[k][c] == pytest.approx(r[c], abs=1e-9)


def test_blends_of_no_rows(spark):
    assert ensemble.blend_grid(spark.createDataFrame([], "p1 double, p2 double, label int"), "p1", "p2", 4).count() == 0


@pytest.mark.parametrize("name", ["alert_machine", "history_topn"])
def test_partitions_grow_with_the_table(spark, monkeypatch, name):
    rows = lambda: sorted(map(str, catalog.QUERIES[name](spark, DATA).collect()))
    before = rows()
    monkeypatch.setattr(telemetry, "ROWS_A_TASK", 300)
    assert rows() == before
    assert catalog.QUERIES[name](spark, DATA).groupBy(F.spark_partition_id()).count().count() > 12  # the session has 4


def test_block_sample_leaves_rows_where_they_are_read(spark, monkeypatch):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog.QUERIES["block_sample"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_sorted_files_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(telemetry, "ROWS_A_TASK", 500)
    asked, made = [], parity.sorted_for_keys
    monkeypatch.setattr(parity, "sorted_for_keys", lambda *args, **kwargs: (asked.append(kwargs["files"]), made(*args, **kwargs)))
    assert catalog.QUERIES["late_materialised"](spark, DATA).count() > 0 and asked[0] > 10
