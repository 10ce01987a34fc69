"""The blend grid's passes and ranges on small rows that are cut as large ones are."""

import numpy as np
import pytest

from icuflow.operators import ensemble, metrics


def freed_passes(monkeypatch):
    """An entry for each time that shuffles are freed."""
    seen, made = [], ensemble.freed
    monkeypatch.setattr(ensemble, "freed", lambda spark: (seen.append(1), made(spark)))
    return seen


@pytest.mark.parametrize("settings", [{}, {"PACKED_ROWS": 40, "CACHED_ROWS": 7, "PASS_WEIGHTS": 3, "COUNT_BITS": 2, "BIN_BITS": 30}, {"PART_PAIRS": 1, "PASS_WEIGHTS": 4}])
def test_ranges_and_repeated_counts(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(ensemble, name, value)
    # pairs that stand 1 to 14 times with one label or both, scores at both ends, and scores that are equal at one weight only
    rng = np.random.default_rng(4)
    pairs = [(0.0, 1.0), (1.0, 0.0), (0.0, 0.0), (1.0, 1.0), (0.3, 0.3), *[(float(a), float(b)) for a, b in zip(rng.random(60).round(2), rng.random(60).round(1), strict=True)]]
    rows = [(*p, int(rng.random() < 0.4)) for i, p in enumerate(pairs) for _ in range(1 + i % 14)]
    df = spark.createDataFrame(rows, "a double, b double, label int")
    got = {round(r["weight"] * 8): r for r in ensemble.blend_grid(df, "a", "b", 8).collect()}
    assert sorted(got) == list(range(9))
    a, b, y = (np.array(v, float) for v in zip(*rows, strict=True))
    for k in range(9):
        s = np.round(k / 8 * a + (1 - k / 8) * b, 12)
        wins = (s[y == 1][:, None] > s[y == 0][None]).mean() + (s[y == 1][:, None] == s[y == 0][None]).mean() / 2
        gain = sum((y[s == v].sum()) * y[s >= v].sum() / (s >= v).sum() for v in np.unique(s)) / y.sum()
        p = np.clip(s, 1e-15, 1 - 1e-15)
        wanted = wins, gain, ((s - y) ** 2).mean(), -(y * np.log(p) + (1 - y) * np.log(1 - p)).mean()
        assert np.allclose([got[k][c] for c in ("roc_auc", "average_precision", "brier", "log_loss")], wanted, rtol=0, atol=1e-9)


def test_a_pass_holds_many_weights(spark, monkeypatch):
    seen = freed_passes(monkeypatch)
    # 2^15 pairs: a pass of one weight each, as it was with so many pairs and the same bound, would free 101 times
    monkeypatch.setattr(ensemble, "PASS_SCORES", 1 << 19)
    df = spark.range(1 << 15).selectExpr("pmod(xxhash64(id), 9973) / 9973 AS a", "pmod(xxhash64(id, 1), 9967) / 9967 AS b", "cast(id % 3 = 0 as int) AS label")
    best = ensemble.blend_grid(df, "a", "b", 100).first()
    assert len(seen) <= 1 + -(-101 // 16)
    x = df.selectExpr("label", f"round({best['weight']} * a + (1 - {best['weight']}) * b, 12) AS p")
    assert best["average_precision"] == pytest.approx(metrics.ranking_metrics(x, "p").first()["average_precision"], abs=1e-9)


def test_choice_takes_few_passes(spark, monkeypatch):
    seen = freed_passes(monkeypatch)
    monkeypatch.setattr(ensemble, "PASS_SCORES", 1 << 19)
    df = spark.range(1 << 15).selectExpr("id", "pmod(xxhash64(id), 9973) / 9973 AS a", "pmod(xxhash64(id, 1), 9967) / 9967 AS b", "cast(id % 3 = 0 as int) AS label")
    r = ensemble.blend_choice(df.where("id % 4 <> 0"), df.where("id % 4 = 0"), "a", "b").first()
    assert len(seen) <= 1 + -(-101 // 16)
    x = lambda part: df.where(f"id % 4 {part} 0").selectExpr("label", f"round({r['weight']} * a + (1 - {r['weight']}) * b, 12) AS p")
    assert r["tuned"] == pytest.approx(metrics.ranking_metrics(x("<>"), "p").first()["average_precision"], abs=1e-9)
    assert r["average_precision"] == pytest.approx(metrics.ranking_metrics(x("="), "p").first()["average_precision"], abs=1e-9)
