"""Calibration, blending and cluster bootstrap of two score columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from icuflow.functions.scalars import blend, clipped_logit, platt
from icuflow.operators.metrics import RANGES, probability_metrics, ranking_metrics
from icuflow.operators.resampling import METRICS, draws, freed, hashed_weights, resampled_metrics
from icuflow.sources.files import kept, removed

#: Pairs that are packed together, and that are worked on at a time.
PACKED_ROWS, CACHED_ROWS = 1 << 17, 1 << 14
#: Scores of a pass, and its weights, at most; pairs of a range, about.
PASS_SCORES, PASS_WEIGHTS, PART_PAIRS = 1 << 31, 26, 3 << 20
#: Scores are whole numbers of 1 / SCALE; bits of a positive or negative count beside them, and of a score within a bin of the histograms.
SCALE, COUNT_BITS, BIN_BITS = 1e12, 11, 26
#: Pairs of scores: values if they are few and their places, or the values; how many are a single positive, a single negative; counts of the others.
_PACKED = {"part": pa.int32(), "n": pa.int32(), "positives": pa.int32(), "negatives": pa.int32(), "xs": pa.binary(), "x": pa.binary(), "ys": pa.binary(), "y": pa.binary(), "counts": pa.binary()}


def platt_fit(df: DataFrame, score: str) -> DataFrame:
    """One row: intercept and slope of a logistic regression on the clipped logit."""
    x = df.select(array_to_vector(F.array(clipped_logit(F.col(score)))).alias("features"), F.col("label").cast("double").alias("label"))
    m = LogisticRegression(regParam=1e-9, standardization=False, tol=1e-9, maxIter=200).fit(x)
    return df.sparkSession.createDataFrame([(score, float(m.intercept), float(m.coefficients[0]))], "score string, intercept double, slope double")


def platt_apply(df: DataFrame, scores: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.select("*", *[platt(F.col(s), a, b).alias(f"{s}_calibrated") for s, (a, b) in scores.items()])


def _written(records: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in records], t) for n, t in _PACKED.items()], names=list(_PACKED))


def _coded(v: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Different values, if they are few, and their places; else none, and the values."""
    values, places = np.unique(v, return_inverse=True)
    return (values.tobytes(), places.astype(np.uint8)) if len(values) <= 256 else (b"", v)


def _logs(q: np.ndarray) -> float:
    """Sum of logarithms of numbers from 1e-16 to 1: of products of 16."""
    n = len(q) // 16 * 16
    return float(np.log(np.multiply.reduce(q[:n].reshape(16, -1), axis=0)).sum() + np.log(q[n:]).sum())


def blend_grid(df: DataFrame, first: str, second: str, steps: int = 100) -> DataFrame:
    """Metrics of w * first + (1 - w) * second for each w in steps, the best first; exact, with ties (scores to 12 places).

    Rows are counted by distinct pair of scores once, and packed. One pass over the pairs gives each weight's sums by range
    of blended scores: what stands above a range, Brier score and log loss. Ranges hold about as many pairs each, by a
    histogram of a weight amid those of a pass. A pass deals a pair to the ranges that its score goes through from the
    first to the last weight of the pass, not once for each weight; there each weight's scores are sorted, as whole
    numbers that hold the counts, too. What a pass shuffled is freed before the next one, so disk doesn't grow with the
    number of weights. The driver holds sums of each range and weight. Both scores must be in [0, 1]; rows with a missing
    score or label don't count."""
    spark = df.sparkSession
    most = (1 << COUNT_BITS) - 1
    bins = (int(SCALE) >> BIN_BITS) + 1

    def whole(k: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        score = k / steps * x
        score += (1 - k / steps) * y
        score *= SCALE
        return np.rint(score, out=score)

    def sides_of(record: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Both scores and the counts of a record, positives 2^COUNT_BITS each and negatives 1: single positives first, then single negatives."""
        x, y = (np.frombuffer(record[d])[np.frombuffer(record[c], np.uint8)] if record[d] else np.frombuffer(record[c]) for d, c in (("xs", "x"), ("ys", "y")))
        counts = np.concatenate([np.full(record["positives"], 1 << COUNT_BITS, np.uint32), np.ones(record["negatives"], np.uint32), np.frombuffer(record["counts"], np.uint32)])
        return x, y, counts

    def records(batches):
        return (r for b in batches for r in b.to_pylist())

    def bin_of(score: np.ndarray) -> np.ndarray:
        return score.astype(np.int64) >> BIN_BITS

    def packed(batches):
        held, n = [], 0

        def made(x, y, pos, neg):
            single = [np.flatnonzero((pos == 1) & (neg == 0)), np.flatnonzero((pos == 0) & (neg == 1))]
            other = np.flatnonzero(pos + neg > 1)
            times = np.maximum(-(-pos[other] // most), -(-neg[other] // most)).astype(np.int64)  # counts that don't fit stand more than once
            turn = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            other = np.repeat(other, times)
            counts = [np.clip(c[other] - turn * most, 0, most).astype(np.uint32) for c in (pos, neg)]
            order = np.concatenate([*single, other])
            (xs, x), (ys, y) = _coded(x[order]), _coded(y[order])
            return {"part": 0, "n": len(order), "positives": len(single[0]), "negatives": len(single[1]), "xs": xs, "x": x.tobytes(), "ys": ys, "y": y.tobytes(), "counts": (counts[0] << COUNT_BITS | counts[1]).tobytes()}

        for b in batches:
            held.append([b.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in range(4)])
            n += b.num_rows
            if n >= PACKED_ROWS:
                yield _written([made(*map(np.concatenate, zip(*held, strict=True)))])
                held, n = [], 0
        if n:
            yield _written([made(*map(np.concatenate, zip(*held, strict=True)))])

    def counted(batches):
        found = np.zeros((len(passes), bins), np.int64)
        for record in records(batches):
            x, y, _ = sides_of(record)
            for i, (low, high) in enumerate(passes):
                found[i] += np.bincount(bin_of(whole((low + high) // 2, x, y)), minlength=bins)
        yield pa.RecordBatch.from_arrays([pa.array(range(len(passes)), pa.int32()), pa.array(list(found))], names=["pass", "counts"])

    def added(table: pa.Table) -> pa.Table:
        counts = table.column("counts").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).sum(0)
        return pa.table({"pass": table.column("pass").slice(0, 1), "counts": pa.array([counts])})

    def summed(batches):
        found = np.zeros((4, steps + 1, parts))
        for record in records(batches):
            sides, one, two = sides_of(record), record["positives"], record["positives"] + record["negatives"]
            for begin, end, kind in ((0, one, 1), (one, two, 0), (two, record["n"], None)):
                for at in range(begin, end, CACHED_ROWS):
                    x, y, counts = (v[at : min(at + CACHED_ROWS, end)] for v in sides)
                    pos, neg = counts >> COUNT_BITS, counts & most
                    for i, (low, high) in enumerate(passes):
                        for k in range(low, high + 1):
                            score = whole(k, x, y)
                            part = part_of.value[i][bin_of(score)]
                            score /= SCALE
                            p = np.clip(score, 1e-15, 1 - 1e-15)
                            if kind is None:
                                found[0, k] += np.bincount(part, pos, parts)
                                found[1, k] += np.bincount(part, neg, parts)
                                found[2, k, 0] += (pos * np.square(score - 1) + neg * np.square(score)).sum()
                                found[3, k, 0] -= (pos * np.log(p) + neg * np.log(1 - p)).sum()
                            else:
                                found[1 - kind, k] += np.bincount(part, minlength=parts)
                                off = score - kind
                                found[2, k, 0] += off @ off
                                found[3, k, 0] -= _logs(p if kind else 1 - p)
        k, part = np.nonzero(found.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array(part, pa.int32()), *(pa.array(v[k, part]) for v in found)], names=["k", "part", "pos", "neg", "square", "loss"])

    def dealt(i: int):
        def run(batches):
            for record in records(batches):
                x, y, counts = sides_of(record)
                ends = [whole(k, x, y) for k in passes[i]]
                low, high = (part_of.value[i][bin_of(np.clip(v, 0, SCALE))].astype(np.int64) for v in (np.minimum(*ends) - 2, np.maximum(*ends) + 2))  # 2: the last place may be rounded otherwise in between
                times = high - low + 1
                row = np.repeat(np.arange(len(x)), times)
                part = (np.arange(len(row)) - np.repeat(np.cumsum(times) - times - low, times)).astype(np.uint16)
                row = row[np.argsort(part, kind="stable")]
                cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
                places = [np.frombuffer(record[c], np.uint8 if record[d] else np.float64) for d, c in (("xs", "x"), ("ys", "y"))]
                made = []
                for r in np.flatnonzero(np.diff(cuts)).tolist():
                    own = row[cuts[r] : cuts[r + 1]]
                    one, two = np.searchsorted(own, [record["positives"], record["positives"] + record["negatives"]]).tolist()
                    made.append({"part": r, "n": len(own), "positives": one, "negatives": two - one, "xs": record["xs"], "x": places[0][own].tobytes(), "ys": record["ys"], "y": places[1][own].tobytes(), "counts": counts[own[two:]].tobytes()})
                yield _written(made)

        return run

    def ranked(i: int):
        def run(table: pa.Table) -> pa.Table:
            r = table.column("part")[0].as_py()
            own = np.flatnonzero(part_of.value[i] == r)
            begin, end = float(own[0] << BIN_BITS), float((own[-1] + 1) << BIN_BITS)
            found = {}

            n = sum(table.column("n").to_pylist())
            x, y, counts = np.empty(n), np.empty(n), np.empty(n, np.uint32)
            at = 0
            for record in records(table.to_batches(max_chunksize=1)):
                x[at : at + record["n"]], y[at : at + record["n"]], counts[at : at + record["n"]] = sides_of(record)
                at += record["n"]
            for k in range(passes[i][0], passes[i][1] + 1):
                keys = []
                for at in range(0, len(x), CACHED_ROWS):
                    score = whole(k, x[at : at + CACHED_ROWS], y[at : at + CACHED_ROWS])
                    inside = np.flatnonzero((score >= begin) & (score < end))
                    keys.append((int(SCALE) - score.take(inside).astype(np.int64) << 2 * COUNT_BITS) | counts[at : at + CACHED_ROWS].take(inside))
                key = np.concatenate(keys)
                if not len(key):
                    continue
                key.sort()  # from the highest score down
                score = key >> 2 * COUNT_BITS
                last = np.flatnonzero(np.concatenate([score[1:] != score[:-1], [True]]))
                tp, fp = np.cumsum(key >> COUNT_BITS & most), np.cumsum(key & most)
                if len(last) < len(key):
                    tp, fp = tp[last], fp[last]
                pos, neg = np.diff(tp, prepend=0), np.diff(fp, prepend=0)
                ctp = tp + above.value[0][k, r]
                found[k] = float(neg @ (ctp - pos / 2)), float((pos * ctp / (ctp + fp + above.value[1][k, r])).sum())
            k = sorted(found)
            return pa.table({"k": pa.array(k, pa.int32()), "pairs": pa.array([found[j][0] for j in k], pa.float64()), "gains": pa.array([found[j][1] for j in k], pa.float64())})

        return run

    label = F.col("label").cast("double")
    rows = df.select(F.col(first).cast("double").alias("x"), F.col(second).cast("double").alias("y"), label.alias("label")).dropna()
    schema = ", ".join(f"{n} {'binary' if t == pa.binary() else 'int'}" for n, t in _PACKED.items())
    pairs, path = kept(rows.groupBy("x", "y").agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).mapInArrow(packed, schema), "blends")
    freed(spark)
    n = pairs.agg(F.sum("n")).first()[0] or 0
    at_once, parts = max(1, min(PASS_WEIGHTS, PASS_SCORES // max(1, n))), min(4 * RANGES, max(RANGES * 3 // 4, n // PART_PAIRS))
    passes = [(low, min(low + at_once - 1, steps)) for low in range(0, steps + 1, at_once)]
    part_of = np.zeros((len(passes), bins), np.uint16)
    for r in pairs.mapInArrow(counted, "pass int, counts array<long>").groupBy("pass").applyInArrow(added, "pass int, counts array<long>").toArrow().to_pylist():
        upto = np.cumsum(r["counts"]) - r["counts"]
        part_of[r["pass"]] = np.unique(np.minimum(upto * parts // n, parts - 1), return_inverse=True)[1]  # without empty ones
    part_of = spark.sparkContext.broadcast(part_of)
    sums = np.zeros((4, steps + 1, parts))
    for s in pairs.mapInArrow(summed, "k int, part int, pos double, neg double, square double, loss double").groupBy("k", "part").agg(*[F.sum(c).alias(c) for c in ("pos", "neg", "square", "loss")]).collect():
        sums[:, s["k"], s["part"]] = s["pos"], s["neg"], s["square"], s["loss"]
    above = spark.sparkContext.broadcast(np.cumsum(sums[:2, :, ::-1], axis=2)[:, :, ::-1] - sums[:2])
    ranks = {}
    for i in range(len(passes) if n else 0):
        each = pairs.mapInArrow(dealt(i), schema).repartition(parts, "part").groupBy("part").applyInArrow(ranked(i), "k int, pairs double, gains double")
        ranks |= {r["k"]: (r["pairs"], r["gains"]) for r in each.groupBy("k").agg(F.sum("pairs").alias("pairs"), F.sum("gains").alias("gains")).collect()}
        del each
        if i + 1 < len(passes):
            freed(spark)
    removed(spark, path)
    found = [(k, *ranks[k], *map(float, sums[:, k].sum(1))) for k in sorted(ranks)]
    x = spark.createDataFrame(found, "k int, pairs double, gains double, pos double, neg double, square double, loss double")
    n = F.col("pos") + F.col("neg")
    out = x.select((F.col("k") / steps).alias("weight"), F.try_divide("pairs", F.col("pos") * F.col("neg")).alias("roc_auc"), F.try_divide("gains", "pos").alias("average_precision"), (F.col("square") / n).alias("brier"), (F.col("loss") / n).alias("log_loss"))
    return out.orderBy(F.desc("average_precision"), F.desc("roc_auc"), "brier", "log_loss")


def blend_choice(tuning: DataFrame, held: DataFrame, first: str, second: str, steps: int = 100, top: int = 10) -> DataFrame:
    """The weight that is best on tuning, its metrics there and on the rows held out, the gain there over the better single score, and how flat the best are.

    One row: weight, tuned (average precision on tuning), flatness (difference to the top-th best weight there), and on the rows held out: average_precision, roc_auc, gain."""
    grid = blend_grid(tuning, first, second, steps).limit(top).collect()  # as many rows as top
    weight, tuned, last = grid[0]["weight"], grid[0]["average_precision"], grid[-1]["average_precision"]
    x = single_and_blend(held, first, second, weight)
    best, own = F.max(F.when(F.col("model") != "blend", F.col("average_precision"))), lambda c: F.max(F.when(F.col("model") == "blend", F.col(c)))
    return x.agg(F.lit(weight).alias("weight"), F.lit(tuned).alias("tuned"), F.lit(tuned - last).alias("flatness"), own("average_precision").alias("average_precision"), own("roc_auc").alias("roc_auc"), (own("average_precision") - best).alias("gain"))


def single_and_blend(df: DataFrame, first: str, second: str, weight: float) -> DataFrame:
    """model, roc_auc, average_precision, brier, log_loss for both scores and their blend."""
    long = df.select("label", F.explode(F.create_map(F.lit(first), F.col(first), F.lit(second), F.col(second), F.lit("blend"), blend(F.col(first), F.col(second), weight))).alias("model", "score"))
    return ranking_metrics(long, "score", ["model"]).join(probability_metrics(long, "score", ["model"]), "model")


def improvement(metrics: DataFrame, metric: str) -> DataFrame:
    """The blend against the best single model."""
    best = F.max(F.when(F.col("model") != "blend", F.col(metric)))
    own = F.max(F.when(F.col("model") == "blend", F.col(metric)))
    return metrics.agg(own.alias("blend"), best.alias("best_single"), (own - best).alias("gain"), (100 * (own - best) / best).alias("gain_percent"))


def bootstrap(df: DataFrame, key: str, scores: Sequence[str], replicates: int = 2000, seed: int = 1, hashed: bool = False, metrics: Sequence[str] = METRICS) -> DataFrame:
    """replicate, score and the metrics (roc_auc, average_precision) of each resample of whole groups; replicates without both classes go.

    Rows are made once. hashed draws come from md5 and can be repeated by another engine; each is hashed, which suits few replicates."""
    rows, path = kept(df.select(key, "label", *scores), "bootstrap")
    freed(df.sparkSession)
    weights = (hashed_weights if hashed else draws)(rows, key, replicates, seed)
    out = resampled_metrics(rows, key, scores, weights, replicates, seed, metrics)
    removed(df.sparkSession, path)
    return out


def confidence(replicates: DataFrame, metric: str) -> DataFrame:
    """score, n, low and high: the central 95 % of the replicates."""
    q = F.percentile(metric, F.array(F.lit(0.025), F.lit(0.975)))
    return replicates.groupBy("score").agg(F.count("*").alias("n"), F.avg(metric).alias("mean"), q.alias("q")).select("score", "n", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def gain_probability(replicates: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    """Share of replicates in which first beats second, and the interval of the difference."""
    wide = replicates.groupBy("replicate").agg(F.max(F.when(F.col("score") == first, F.col(metric))).alias("a"), F.max(F.when(F.col("score") == second, F.col(metric))).alias("b"))
    d = F.col("a") - F.col("b")
    q = F.percentile(d, F.array(F.lit(0.025), F.lit(0.975)))
    return wide.agg(F.count(d).alias("n"), F.avg((d > 0).cast("int")).alias("p_better"), q.alias("q")).select("n", "p_better", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))


def drift(artifact: DataFrame, expected: Mapping[str, float], tolerance: float = 1e-12) -> DataFrame:
    """name, expected, actual, ok for each locked number of a one-row artifact."""
    names = list(expected)
    stack = ", ".join(f"'{n}', cast({expected[n]!r} as double), cast(`{n}` as double)" for n in names)
    return artifact.selectExpr(f"stack({len(names)}, {stack}) AS (name, expected, actual)").withColumn("ok", F.coalesce(F.abs(F.col("expected") - F.col("actual")) <= tolerance, F.lit(False)))


__all__ = ["bootstrap", "blend_choice", "blend_grid", "confidence", "drift", "gain_probability", "improvement", "platt_apply", "platt_fit", "single_and_blend"]
