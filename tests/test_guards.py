"""Checks whose SQL is a constant, as nothing breaks them in the tables: violations planted here must show. And fits against numpy."""

import math

import numpy as np

from icuflow.operators import ensemble, metrics, parity, serving, splits


def test_monotone_violations_show(spark):
    grid = spark.createDataFrame([(0.1, 0.9, 0.1), (0.2, 0.95, 0.2), (0.3, 0.5, 0.15), (0.4, 0.5, 0.3)], "threshold double, recall double, specificity double")
    r = metrics.monotone_violations(grid).first()
    assert (r.sensitivity_rises, r.specificity_falls) == (1, 1)


def test_probabilities_that_are_none_show(spark):
    df = spark.createDataFrame([(0.5, 0.1), (math.nan, 2.0), (math.inf, -0.1), (None, 0.0), (1.0, 1.0)], "a double, b double")
    assert {r.column_name: (r.n_not_finite, r.n_outside) for r in metrics.probability_checks(df, ["a", "b"]).collect()} == {"a": (3, 0), "b": (0, 2)}


def test_parity_failures_show(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, None), (4, 1.0)], "k long, x double")
    b = spark.createDataFrame([(1, 0.5), (2, 0.6), (3, 0.1), (5, 1.0)], "k long, x double")
    r = parity.parity_report(parity.parity_rows(a, b, ["k"], {"x": 1e-6})).first()
    assert (r.n, r.n_failed) == (5, 4) and abs(r.max - 0.1) < 1e-12 and abs(r.p50 - 0.05) < 1e-12


def test_rows_without_a_split_show(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "subject_id long")
    split = spark.createDataFrame([(1, "train"), (2, "test")], "subject_id long, split string")
    made = splits.assigned(rows, split, "subject_id")
    assert made.where("split is null").count() + (3 - made.count()) == 1


def test_platt_fit_is_the_maximum(spark):
    rng = np.random.default_rng(5)
    p = rng.uniform(0.02, 0.98, 400)
    y = (rng.uniform(size=400) < 1 / (1 + np.exp(-(0.4 + 1.7 * np.log(p / (1 - p)))))).astype(float)
    z, w = np.log(p / (1 - p)), np.zeros(2)
    for _ in range(50):
        m = 1 / (1 + np.exp(-(w[0] + w[1] * z)))
        x = np.stack([np.ones_like(z), z])
        w += np.linalg.solve((x * (m * (1 - m))) @ x.T, x @ (y - m))
    r = ensemble.platt_fit(spark.createDataFrame([(float(a), float(b)) for a, b in zip(p, y, strict=True)], "s double, label double"), "s").first()
    assert np.allclose([r.intercept, r.slope], w, atol=1e-4)


def test_blend_grid_with_ties_and_missing_scores(spark):
    rng = np.random.default_rng(6)
    a, b, y = rng.integers(0, 5, 300) / 4, rng.integers(0, 3, 300) / 2, rng.integers(0, 2, 300)
    rows = [(float(i), float(j), int(k)) for i, j, k in zip(a, b, y, strict=True)] + [(None, 0.5, 1), (0.5, None, 0)]
    got = {round(r.weight, 2): r for r in ensemble.blend_grid(spark.createDataFrame(rows, "a double, b double, label int").repartition(4), "a", "b", 10).collect()}
    assert len(got) == 11
    for k in range(11):
        s = np.round(k / 10 * a + (1 - k / 10) * b, 12)
        wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2
        gain = sum((y[s == v].sum()) * y[s >= v].sum() / (s >= v).sum() for v in np.unique(s)) / y.sum()
        r = got[round(k / 10, 2)]
        assert np.isclose(r.roc_auc, wins) and np.isclose(r.average_precision, gain) and np.isclose(r.brier, ((s - y) ** 2).mean())


def test_stale_handovers_are_hidden(spark):
    alerts = spark.createDataFrame([(1, 1, "OPEN"), (2, 1, "OPEN"), (3, 2, "OPEN"), (4, 1, "RESOLVED"), (5, 9, "OPEN"), (6, 1, "OPEN")], "assignment_id long, patient_id long, status string")
    assignments = spark.createDataFrame([(1, None), (2, "2020-01-01"), (3, None), (4, None), (5, None)], "assignment_id long, closed_at string")
    patients = spark.createDataFrame([(1, "ACTIVE"), (2, "DISCHARGED")], "patient_id long, status string")
    assert [r.assignment_id for r in serving.active_handovers(alerts, assignments, patients).collect()] == [1]
