"""The bootstrap's steps on small rows that are cut as large ones are."""

import numpy as np
import pytest
from helpers import DATA
from pyspark.sql import functions as F
from test_metrics import brute, counts

from icuflow.operators import ensemble, resampling
from icuflow.plans import decisions


def frame(spark):
    # many ties, one score of few values, one of many, missing ones; a label that changes within a stay
    rows = [(i % 13, (i * 7 % 10) / 10, (i * i % 101) / 101, int(i * 5 % 17 < 6)) for i in range(200)] + [(3, None, 0.5, 1), (4, 0.5, None, 0), (5, 0.2, 0.3, None), (None, 0.2, 0.3, 1)]
    return rows, spark.createDataFrame(rows, "stay_id long, p1 double, p2 double, label int")


@pytest.mark.parametrize("metrics", [["roc_auc"], ["roc_auc", "average_precision"]])
@pytest.mark.parametrize("hashed", [False, True])
def test_frequent_scores_and_ranges_in_steps(spark, monkeypatch, hashed, metrics):
    for name, value in (("BUCKET", 5), ("PLACE_ROWS", 9), ("STEP", 4), ("PACKED_ROWS", 30), ("COLUMN_CELLS", 100), ("SUMMED_CELLS", 200)):
        monkeypatch.setattr(resampling, name, value)
    rows, df = frame(spark)
    weights = (resampling.hashed_weights if hashed else resampling.group_weights)(df, "stay_id", 21)
    by_stay = {r["stay_id"]: counts(r["weights"]) for r in weights.collect()}
    got = {(r["replicate"], r["score"]): tuple(round(r[m], 9) for m in metrics) for r in ensemble.bootstrap(df, "stay_id", ["p1", "p2"], 21, hashed=hashed, metrics=metrics).collect()}
    for r in range(21):
        for i, name in ((1, "p1"), (2, "p2")):
            known = [x for x in rows if None not in (x[0], x[i], x[3])]
            w = np.array([by_stay[x[0]][r] if x[0] in by_stay else 0 for x in known])
            expected = brute([(x[i], x[3]) for x in known], w)
            assert got.pop((r, name), None) == (expected and expected[: len(metrics)])
    assert not got


def test_rows_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def seen(x):
        made.add(1)
        return x

    rows, df = frame(spark)
    assert ensemble.bootstrap(df.withColumn("p1", seen("p1")), "stay_id", ["p1"], 8, metrics=["roc_auc"]).count() == 8
    assert made.value == len(rows)


def test_counts_of_one_replicate_are_those_of_all():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 5000).astype(np.uint64)
    all_counts = resampling.poisson_counts(hashes, 0, 40, 3)
    assert all_counts.dtype == np.uint8 and (resampling.poisson_counts(hashes, 16, 40, 3) == all_counts[:, 16:]).all()
    for k in (0, 7, 8, 39):
        assert (resampling.poisson_count(hashes, np.full(len(hashes), k), 3) == all_counts[:, k]).all()
    share = np.bincount(all_counts.ravel(), minlength=18)[:7] / all_counts.size
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6, 24, 120, 720])).max() < 0.005


def test_draws_by_md5_travel_packed(spark):
    plan = resampling.hashed_weights(frame(spark)[1], "stay_id", 20)._jdf.queryExecution().executedPlan().toString()
    # a draw was a row that was shuffled by group and replicate
    assert "map_from_entries" not in plan and "FlatMapCoGroupsInArrow" in plan


def test_gain_is_of_paired_replicates_and_works_out_only_what_it_reads(spark, monkeypatch):
    asked, made = [], ensemble.bootstrap
    monkeypatch.setattr(decisions, "REPLICATES", 16)
    monkeypatch.setattr(ensemble, "bootstrap", lambda *args, **kwargs: (asked.append(made(*args, **kwargs)), asked[0])[1])
    r = decisions.bootstrap_gain(spark, DATA).first()
    assert asked[0].columns == ["replicate", "score", "roc_auc"]
    d = {}
    for x in asked[0].collect():
        d.setdefault(x["replicate"], {})[x["score"]] = x["roc_auc"]
    assert r["n"] == 16 == len(d) and r["p_better"] == pytest.approx(np.mean([v["p1"] > v["p2"] for v in d.values()]), abs=1e-6)
