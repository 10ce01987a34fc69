"""Exact quantiles against numpy, with brackets so small that several rounds are needed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from icuflow.operators import quantiles


@pytest.mark.parametrize("most", [3, 1 << 15])
def test_against_numpy(spark, monkeypatch, most):
    monkeypatch.setattr(quantiles, "MOST", most)
    monkeypatch.setattr(quantiles, "CUTS", 8)
    rng = np.random.default_rng(1)
    rows = []
    for g, n in (("a", 700), (None, 90), ("c", 1)):
        skewed = np.exp(rng.normal(0, 8, n)) * rng.choice([-1, 1], n)
        for k in range(n):
            rows.append((g, float(skewed[k]), float(k % 3), None if k % 2 else float(k)))
    df = spark.createDataFrame(rows, "g string, x double, y double, z double").repartition(5)
    points = (0.0, 0.05, 0.5, 0.75, 0.999, 1.0)
    got = {(r.g, r.column_name): (r.n, r.q) for r in quantiles.exact_quantiles(df, ["x", "y", "z"], points, ["g"]).collect()}
    assert len(got) == 9
    for g in ("a", None, "c"):
        for k, c in enumerate("xyz"):
            own = [r[k + 1] for r in rows if r[0] == g and r[k + 1] is not None]
            n, q = got[g, c]
            assert n == len(own) and np.allclose(q, np.quantile(own, points), rtol=1e-12)


def test_no_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5]).collect() == [] == quantiles.exact_quantiles(df.limit(0), ["x"], [0.5]).collect()


def test_rows_of_few_brackets_are_not_dealt_by_bracket(spark):
    from icuflow.operators.quantiles import _narrowed

    values = spark.range(1000).select(F.struct(F.lit("x").alias("column_name")).alias("g"), F.col("id").cast("double").alias("v"))
    targets = values.groupBy("g").agg(F.lit(500).cast("long").alias("rank"), F.min("v").alias("low"), F.max("v").alias("high"), F.lit(0).cast("long").alias("below"), F.count("*").alias("m"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if cuts were thought large
    try:
        out = _narrowed(values, targets, True)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        (row,) = out.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert row.low <= 500 <= row.high and row.m < 1000 and row.below <= 500 < row.below + row.m
