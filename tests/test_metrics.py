"""Metrics with ties, weights and empty classes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from icuflow.operators import ensemble, metrics, resampling

ROWS = [(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.7), (1, 0.2), (0, 0.1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "label int, p double")


def test_ties(spark):
    r = metrics.ranking_metrics(frame(spark, ROWS), "p").first()
    assert r["roc_auc"] == pytest.approx(0.611111, abs=1e-6) and r["average_precision"] == pytest.approx(0.7, abs=1e-9)


def test_all_tied_and_one_class(spark):
    assert metrics.ranking_metrics(frame(spark, [(1, 0.5), (0, 0.5)]), "p").first()["roc_auc"] == 0.5
    assert metrics.ranking_metrics(frame(spark, [(0, 0.5), (0, 0.4)]), "p").first()["roc_auc"] is None


def test_weights_are_repeats(spark):
    a = metrics.ranking_metrics(frame(spark, ROWS).withColumn("w", F.lit(3.0)), "p", (), F.col("w")).first()
    b = metrics.ranking_metrics(frame(spark, ROWS * 3), "p").first()
    assert a["roc_auc"] == pytest.approx(b["roc_auc"]) and a["average_precision"] == pytest.approx(b["average_precision"])


def test_no_positive_predicted(spark):
    top = metrics.threshold_grid(frame(spark, ROWS), "p", 5, 95).orderBy(F.desc("threshold")).first()
    assert (top["tp"], top["fp"], top["precision"], top["f1"]) == (0, 0, 0.0, 0.0)


def test_bounds_are_clipped(spark):
    r = metrics.probability_metrics(frame(spark, [(1, 0.0), (0, 1.0)]), "p").first()
    assert r["brier"] == 1.0 and r["log_loss"] < 50


def counts(weights):
    return np.frombuffer(weights, resampling.COUNT).astype(int)


def test_group_weights_draw_with_replacement(spark, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET", 50)
    g = spark.range(700).select(F.col("id").alias("stay_id"))
    w = np.array([counts(r["weights"]) for r in resampling.group_weights(g, "stay_id", 300).orderBy("stay_id").collect()])
    assert w.shape == (700, 300) and (w.sum(0) == 700).all()
    # draws of one group are binomial: mean 1, variance 1 - 1 / 700, and replicates differ
    assert abs(w.var() - (1 - 1 / 700)) < 0.02 and abs(w.sum(1) / 300 - 1).max() < 0.3
    assert len({tuple(c) for c in w.T}) == 300
    again = resampling.group_weights(g.repartition(5), "stay_id", 300).orderBy("stay_id").collect()
    assert (np.array([counts(r["weights"]) for r in again]) == w).all()


def brute(rows, w):
    """ROC AUC over all pairs and average precision over all thresholds, of rows (p, label) that count w times."""
    p, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    pos, neg = w * y, w * (1 - y)
    if not pos.sum() or not neg.sum():
        return None
    auc = (pos[:, None] * neg[None] * ((p[:, None] > p[None]) + 0.5 * (p[:, None] == p[None]))).sum() / (pos.sum() * neg.sum())
    ap = sum(pos[p == t].sum() * pos[p >= t].sum() / max(w[p >= t].sum(), 1) for t in set(p)) / pos.sum()
    return round(auc, 9), round(ap, 9)


@pytest.mark.parametrize("hashed", [False, True])
def test_bootstrap_against_brute_force(spark, hashed, monkeypatch):
    monkeypatch.setattr(resampling, "BUCKET", 5)
    rows = [(i % 13, (i * 7 % 19) / 19, (i * i % 11) / 11, int(i * 5 % 17 < 6)) for i in range(120)] + [(3, None, 0.5, 1), (4, 0.5, None, 0), (5, 0.2, 0.3, None)]
    df = spark.createDataFrame(rows, "stay_id long, p1 double, p2 double, label int")
    weights = (resampling.hashed_weights if hashed else resampling.group_weights)(df, "stay_id", 40)
    by_stay = {r["stay_id"]: counts(r["weights"]) for r in weights.collect()}
    got = {(r["replicate"], r["score"]): (round(r["roc_auc"], 9), round(r["average_precision"], 9)) for r in ensemble.bootstrap(df, "stay_id", ["p1", "p2"], 40, hashed=hashed).collect()}
    for r in range(40):
        for i, name in ((1, "p1"), (2, "p2")):
            kept = [x for x in rows if x[i] is not None and x[3] is not None]
            w = np.array([by_stay[x[0]][r] if x[0] in by_stay else 0 for x in kept])
            assert got.pop((r, name), None) == brute([(x[i], x[3]) for x in kept], w)
    assert not got


def test_bootstrap_of_no_rows_and_of_one_class(spark):
    none = spark.createDataFrame([], "stay_id long, p1 double, label int")
    assert ensemble.bootstrap(none, "stay_id", ["p1"], 3).count() == 0
    one = spark.createDataFrame([(1, 0.5, 1), (2, 0.6, 1)], "stay_id long, p1 double, label int")
    assert ensemble.bootstrap(one, "stay_id", ["p1"], 3).count() == 0
