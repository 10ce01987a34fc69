"""What changed between a stay's consecutive windows, and tables about histories, alerts and cohorts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.functions.scalars import missing

# Production settings.
LEAST_ATTRIBUTION, LEAST_VALUE = 1e-4, 1e-6


def changed_features(df: DataFrame, names: Sequence[str], k: int, max_gap: int | None = None) -> DataFrame:
    """Of each window with one before it in its stay, the k features whose attribution changed most and whose change counts, with a record of the change. A window more than max_gap windows back isn't compared with.

    df: stay_id, window_id, the columns names and attributions (in that order). A change counts if the value changed, came or went, or the attribution changed by LEAST_ATTRIBUTION.
    Attributions' changes are taken to 12 places, so that equal ones stand in the order of names whatever the last bits of a mean."""
    order = Window.partitionBy("stay_id").orderBy("window_id")
    x = df.select("stay_id", "window_id", F.array(*names).alias("now"), F.col("attributions").alias("now_a"))
    near = _near(order, max_gap)
    x = x.select("*", F.when(near, F.lag("now").over(order)).alias("was"), F.lag("now_a").over(order).alias("was_a")).where("was is not null")
    listed = F.array(*[F.lit(n) for n in names])

    def record(i: Column) -> Column:
        at = lambda c: F.col(c)[i]
        gone = missing(at("was")) != missing(at("now"))
        both = ~missing(at("was")) & ~missing(at("now"))
        delta = F.when(both, at("now") - at("was"))
        shift = F.round(at("now_a") - at("was_a"), 12)
        changed = gone | F.coalesce(F.abs(delta) > LEAST_VALUE, F.lit(False))
        return F.struct((-F.abs(shift)).alias("order"), i.alias("i"), F.element_at(listed, i + 1).alias("feature"), at("was").alias("previous_value"), at("now").alias("current_value"), delta.alias("value_delta"), shift.alias("attribution_delta"), changed.alias("value_changed"))

    rows = F.transform(F.sequence(F.lit(0), F.lit(len(names) - 1)), record)
    counted = F.filter(F.array_sort(rows), lambda r: r["value_changed"] | (-r["order"] >= LEAST_ATTRIBUTION))
    y = x.select("stay_id", "window_id", F.posexplode(F.slice(counted, 1, k)).alias("pos", "r"))
    return y.select("stay_id", "window_id", (F.col("pos") + 1).alias("rank"), *[F.col(f"r.{c}").alias(c) for c in ("feature", "previous_value", "current_value", "value_delta", "attribution_delta", "value_changed")])


def _near(order, max_gap: int | None) -> Column:
    return F.lit(True) if max_gap is None else F.col("window_id") - F.lag("window_id").over(order) <= max_gap


def changed_vitals(df: DataFrame, vitals: Sequence[str], max_gap: int | None = None, tolerance: float = 1e-9) -> DataFrame:
    """Of each window with one before it in its stay, at most max_gap windows back: the vitals that came, went or changed. delta is null unless both are there.

    df: stay_id, window_id and the columns vitals (missing: null or NaN)."""
    order = Window.partitionBy("stay_id").orderBy("window_id")
    clean = [F.when(~missing(F.col(v)), F.col(v).cast("double")).alias(v) for v in vitals]
    x = df.select("stay_id", "window_id", F.array(*clean).alias("now"))
    x = x.select("*", F.when(_near(order, max_gap), F.lag("now").over(order)).alias("was")).where("was is not null")
    listed = F.array(*[F.lit(v) for v in vitals])
    y = x.select("stay_id", "window_id", F.posexplode(F.arrays_zip("was", "now")).alias("i", "r"))
    delta = F.col("r.now") - F.col("r.was")
    changed = F.coalesce(F.abs(delta) > tolerance, F.col("r.now").isNull() != F.col("r.was").isNull())
    return y.where(changed).select("stay_id", "window_id", F.element_at(listed, F.col("i") + 1).alias("vital"), F.col("r.was").alias("previous_value"), F.col("r.now").alias("current_value"), delta.alias("delta"))


def attribution_by_step(df: DataFrame) -> DataFrame:
    """timestep (the place in the stay), mean_abs and n: the mean absolute attribution over rows and features. df: stay_id, window_id, attributions."""
    step = F.row_number().over(Window.partitionBy("stay_id").orderBy("window_id"))
    x = df.select(step.alias("timestep"), "attributions").select("timestep", F.explode("attributions").alias("v"))
    return x.groupBy("timestep").agg(F.avg(F.abs("v")).alias("mean_abs"), F.count("*").alias("n"))


def attribution_trend(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """Of each stay the k features of the largest mean absolute attribution, window by window: stay_id, window_id, rank, feature, attribution."""
    listed = F.array(*[F.lit(n) for n in names])
    long = df.select("stay_id", "window_id", F.posexplode("attributions").alias("i", "attribution"))
    means = long.groupBy("stay_id", "i").agg(F.avg(F.abs("attribution")).alias("m"))
    best = means.withColumn("rank", F.row_number().over(Window.partitionBy("stay_id").orderBy(F.desc("m"), "i"))).where(F.col("rank") <= k)
    x = long.join(best.drop("m"), ["stay_id", "i"])
    return x.select("stay_id", "window_id", "rank", F.element_at(listed, F.col("i") + 1).alias("feature"), "attribution")


def attribution_series(df: DataFrame, names: Sequence[str], k: int = 5) -> DataFrame:
    """The same as one row a window: stay_id, window_id, and feature_1, attribution_1 and so on, by rank in the stay."""
    x = attribution_trend(df, names, k)
    columns = [F.max(F.when(F.col("rank") == r, F.col(c))).alias(f"{c}_{r}") for r in range(1, k + 1) for c in ("feature", "attribution")]
    return x.groupBy("stay_id", "window_id").agg(*columns)


def cohorts(df: DataFrame, full: int) -> DataFrame:
    """cohort, n, rate (share of label 1, 0 without rows) and coverage (percent of all rows): all rows, and those with a history of full windows. df: sequence_length, label."""
    whole = F.col("sequence_length") >= full
    n, positive = F.count("*"), F.sum("label")
    x = df.agg(n.alias("n"), F.coalesce(positive, F.lit(0)).alias("pos"), F.count_if(whole).alias("full_n"), F.coalesce(F.sum(F.when(whole, F.col("label"))), F.lit(0)).alias("full_pos"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    row = lambda name, a, b: F.struct(F.lit(name).alias("cohort"), F.col(b).alias("n"), share(a, b).alias("rate"), (100 * share(b, "n")).alias("coverage"))
    return x.select(F.explode(F.array(row("overall", "pos", "n"), row("full_length", "full_pos", "full_n"))).alias("r")).select("r.*")


def data_quality(df: DataFrame, required: int, features: Sequence[str]) -> DataFrame:
    """status of each window (INSUFFICIENT_HISTORY until the stay has required windows, else OK) and its number of missing features."""
    position = F.row_number().over(Window.partitionBy("stay_id").orderBy("window_id"))
    n = sum((missing(F.col(c)).cast("int") for c in features), F.lit(0))
    return df.select("stay_id", "window_id", F.when(position < required, "INSUFFICIENT_HISTORY").otherwise("OK").alias("status"), n.cast("long").alias("n_missing"))


def alert_log(decided: DataFrame, predicted: str, threshold: float) -> DataFrame:
    """Rows worth keeping of an alert machine's: alerts, suppressed crossings, and rows whose given class isn't that of their score (mismatch)."""
    mismatch = F.coalesce(F.col(predicted) != (F.col("p") >= threshold).cast("int"), F.lit(False))
    x = decided.withColumn("mismatch", mismatch)
    return x.where(F.col("alert") | F.col("mismatch") | (F.col("reason") == "threshold_crossing_suppressed"))


def constraint_violations(rows: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """rule, n: how many rows break each rule (null counts as broken). One pass for all rules."""
    counts = rows.agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("n")) for n in rules])).alias("r")).select("r.*")
