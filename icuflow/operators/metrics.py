"""Ranking, threshold and calibration metrics on prediction tables, exact with ties, optionally weighted.

Scores are grouped before they are ranked, so the ranked table is as large as the number of distinct scores; running
sums go over it in two levels (within ranges of scores, then over ranges), so that no task sees all of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.operators.quantiles import exact_quantiles
from icuflow.sources.files import kept, removed

RANGES = 64


def score_groups(df: DataFrame, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """p, pos, neg for each distinct score: weights of its positives and negatives."""
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by, F.col(score).alias("p")).agg(F.sum(w * F.col("label")).alias("pos"), F.sum(w * (1 - F.col("label"))).alias("neg"))


def running(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ctp, cfp: running weights from the highest score down, its own included."""
    ranged = groups.withColumn("r", F.least(F.lit(RANGES - 1), F.greatest(F.lit(0), F.floor(F.col("p") * RANGES))).cast("int"))
    totals = ranged.groupBy(*by, "r").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = Window.partitionBy(*by, F.lit(0)).orderBy(F.desc("r")).rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*by, "r", F.coalesce(F.sum("rp").over(above), F.lit(0.0)).alias("bp"), F.coalesce(F.sum("rn").over(above), F.lit(0.0)).alias("bn"))
    inside = Window.partitionBy(*by, "r").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(before, [*by, "r"]).select(*by, "p", "pos", "neg", (F.col("bp") + F.sum("pos").over(inside)).alias("ctp"), (F.col("bn") + F.sum("neg").over(inside)).alias("cfp"))


def ranking_metrics(df: DataFrame, score: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """roc_auc and average_precision (steps, not trapezoids), with ties; null without both classes."""
    x = running(score_groups(df, score, by, weight), by)
    pairs, steps = F.sum(F.col("neg") * (F.col("ctp") - F.col("pos") / 2)), F.sum(F.col("pos") * F.try_divide(F.col("ctp"), F.col("ctp") + F.col("cfp")))
    return (x.groupBy(*by) if by else x).agg(F.try_divide(pairs, F.sum("pos") * F.sum("neg")).alias("roc_auc"), F.try_divide(steps, F.sum("pos")).alias("average_precision"))


def probability_metrics(df: DataFrame, score: str, by: Sequence[str] = (), clip: float = 1e-15) -> DataFrame:
    """Brier score and log loss."""
    p = F.least(F.greatest(F.col(score), F.lit(clip)), F.lit(1 - clip))
    loss = -(F.col("label") * F.ln(p) + (1 - F.col("label")) * F.ln(1 - p))
    return (df.groupBy(*by) if by else df).agg(F.avg(F.pow(F.col(score) - F.col("label"), F.lit(2))).alias("brier"), F.avg(loss).alias("log_loss"))


def rates(df: DataFrame) -> DataFrame:
    """From tp, fp, tn, fn: the usual rates. Precision, recall and F are 0 where undefined, specificity and NPV null."""
    tp, fp, tn, fn = (F.col(c).cast("double") for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return df.select(
        "*",
        zero(tp, tp + fp).alias("precision"),
        zero(tp, tp + fn).alias("recall"),
        F.try_divide(tn, tn + fp).alias("specificity"),
        F.try_divide(tn, tn + fn).alias("npv"),
        zero(2 * tp, 2 * tp + fp + fn).alias("f1"),
        zero(5 * tp, 5 * tp + fp + 4 * fn).alias("f2"),
        F.try_divide(tp + tn, n).alias("accuracy"),
        F.try_divide(tp + fp, n).alias("alert_rate"),
    ).withColumn("youden", F.col("recall") + F.col("specificity") - 1)


def threshold_grid(df: DataFrame, score: str, low: int, high: int, scale: int = 100) -> DataFrame:
    """Confusion counts at each threshold k / scale, low <= k <= high: rows are counted by grid step once, then cumulated from the top."""
    grid = F.array(*[F.lit(k / scale) for k in range(low, high + 1)])
    step = F.size(F.filter(grid, lambda t: t <= F.col(score)))
    counts = df.groupBy(step.alias("step")).agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg"))
    steps = df.sparkSession.range(0, high - low + 2).select(F.col("id").cast("int").alias("step"))
    x = steps.join(counts, "step", "left").fillna(0, ["pos", "neg"])
    # as many rows as the grid has steps
    top, whole = Window.orderBy(F.desc("step")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = x.select("step", F.sum("pos").over(top).alias("tp"), F.sum("neg").over(top).alias("fp"), F.sum("pos").over(whole).alias("p"), F.sum("neg").over(whole).alias("n"))
    c = c.where("step > 0").select(((F.col("step") + low - 1) / scale).alias("threshold"), "tp", "fp", (F.col("n") - F.col("fp")).alias("tn"), (F.col("p") - F.col("tp")).alias("fn"))
    return rates(c)


def best_by(grid: DataFrame, metric: str, largest_threshold: bool = False) -> DataFrame:
    return grid.orderBy(F.desc(metric), F.desc("threshold") if largest_threshold else F.asc("threshold")).limit(1)


def recall_floor_pick(grid: DataFrame, floors: Sequence[float]) -> DataFrame:
    """Per floor: the highest precision with recall at least that; without any, the best F2."""
    levels = grid.sparkSession.createDataFrame([(float(f),) for f in floors], "recall_floor double")
    x = grid.join(F.broadcast(levels), F.col("recall") >= F.col("recall_floor"), "right")
    order = Window.partitionBy("recall_floor").orderBy(F.desc_nulls_last("precision"), "threshold")
    met = x.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("recall_floor", "threshold", "precision", "recall")
    spare = best_by(grid, "f2").select(F.col("threshold").alias("t2"), F.col("precision").alias("p2"), F.col("recall").alias("r2"))
    found = F.col("threshold").isNotNull()
    pick = lambda a, b: F.when(found, F.col(a)).otherwise(F.col(b)).alias(a)
    return met.join(F.broadcast(spare), F.lit(True)).select("recall_floor", pick("threshold", "t2"), pick("precision", "p2"), pick("recall", "r2"), found.alias("met"))


def sensitivity_pick(grid: DataFrame, least: float) -> DataFrame:
    """Sensitivity at least that, then the highest specificity, then nearest to it, then the higher threshold."""
    return grid.where(F.col("recall") >= least).orderBy(F.desc("specificity"), F.abs(F.col("recall") - least), F.desc("threshold")).limit(1)


def criteria_table(grid: DataFrame, least: float) -> DataFrame:
    parts = [best_by(grid, m).withColumn("criterion", F.lit(m)) for m in ("youden", "f1", "f2")]
    out = sensitivity_pick(grid, least).withColumn("criterion", F.lit("sensitivity"))
    for p in parts:
        out = out.unionByName(p)
    return out.select("criterion", "threshold", "precision", "recall", "specificity", "f1", "f2", "youden")


def nearest_thresholds(grid: DataFrame, wanted: Sequence[float], locked: float) -> DataFrame:
    """The grid row nearest to each wanted threshold (the lower of two), each once, the locked one always."""
    w = grid.sparkSession.createDataFrame([(float(t),) for t in dict.fromkeys([*wanted, locked])], "wanted double")
    near = grid.join(F.broadcast(w), F.lit(True)).groupBy("wanted").agg(F.min_by("threshold", F.struct(F.round(F.abs(F.col("threshold") - F.col("wanted")), 9), F.col("threshold"))).alias("threshold"))
    return grid.join(near.select("threshold").distinct(), "threshold", "left_semi").withColumn("locked", F.abs(F.col("threshold") - locked) < 1e-9)


def monotone_violations(grid: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """As the threshold rises, sensitivity must not rise and specificity not fall."""
    order = Window.orderBy("threshold")
    x = grid.select((F.col("recall") - F.lag("recall").over(order)).alias("a"), (F.col("specificity") - F.lag("specificity").over(order)).alias("b"))
    return x.agg(F.count_if(F.col("a") > tolerance).alias("sensitivity_rises"), F.count_if(F.col("b") < -tolerance).alias("specificity_falls"))


def describe(df: DataFrame, column: str, by: Sequence[str] = (), points: Sequence[float] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """Count, mean, deviation, extremes and exact percentiles (interpolated). Rows are made once, and both read them."""
    rows, path = kept(df.select(*by, column), "described")
    x, _ = kept((rows.groupBy(*by) if by else rows).agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("deviation"), F.min(column).alias("low"), F.max(column).alias("high")), "described")
    q = exact_quantiles(rows, [column], points, by).drop("n", "column_name")
    removed(df.sparkSession, path)
    same = [x[c].eqNullSafe(q[c]) for c in by]
    y = x.join(q, same or F.lit(True), "left")
    return y.select(*[x[c] for c in by], "n", "mean", "deviation", "low", "high", *[F.col("q")[k].alias(f"p{round(p * 100)}") for k, p in enumerate(points)])


def probability_checks(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: values that are missing or not finite, and values outside [0, 1]."""
    aggs = []
    for c in columns:
        bad = F.col(c).isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
        aggs += [F.count_if(bad).alias(f"{c}__not_finite"), F.count_if(~bad & ~F.col(c).between(0, 1)).alias(f"{c}__outside")]
    one = df.agg(*aggs)
    stack = ", ".join(f"'{c}', `{c}__not_finite`, `{c}__outside`" for c in columns)
    return one.selectExpr(f"stack({len(columns)}, {stack}) AS (column_name, n_not_finite, n_outside)")


def class_weight(df: DataFrame) -> DataFrame:
    return df.agg(F.sum(1 - F.col("label")).alias("n_negative"), F.sum("label").alias("n_positive"), F.try_divide(F.sum(1 - F.col("label")), F.sum("label")).alias("weight"))


def aligned(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join of two prediction tables with where each row comes from and whether labels agree."""
    x = a.withColumn("_a", F.lit(1)).withColumnRenamed("label", "label_a").join(b.withColumn("_b", F.lit(1)).withColumnRenamed("label", "label_b"), list(keys), "full_outer")
    side = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("both")
    return x.withColumn("indicator", side).withColumn("labels_agree", F.col("label_a") == F.col("label_b")).drop("_a", "_b")
