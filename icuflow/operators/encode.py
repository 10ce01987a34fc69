"""Feature vectors by MLlib pipelines, models on them, and additive attributions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.functions.scalars import top_k


def feature_pipeline(numeric: Sequence[str], categories: Sequence[str]) -> Pipeline:
    """Categories indexed by frequency, unseen and null in a bucket of their own, one-hot; numbers as they are, null as NaN."""
    index = StringIndexer(inputCols=list(categories), outputCols=[f"{c}_index" for c in categories], handleInvalid="keep", stringOrderType="frequencyDesc")
    hot = OneHotEncoder(inputCols=index.getOutputCols(), outputCols=[f"{c}_hot" for c in categories], handleInvalid="keep", dropLast=True)
    return Pipeline(stages=[index, hot, VectorAssembler(inputCols=[*numeric, *hot.getOutputCols()], outputCol="features", handleInvalid="keep")])


def fit_on(train: DataFrame, numeric: Sequence[str], categories: Sequence[str]) -> PipelineModel:
    return feature_pipeline(numeric, categories).fit(train)


def feature_names(df: DataFrame, column: str = "features") -> list[str]:
    """From the column's metadata, in order of index."""
    attrs = df.schema[column].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for kind in attrs.values() for a in kind), key=lambda a: a["idx"])]


def dimension_audit(df: DataFrame, column: str = "features") -> DataFrame:
    """How many rows have each vector length."""
    return df.groupBy(F.size(vector_to_array(column)).alias("n_dims")).agg(F.count("*").alias("n_rows"))


def onehot_widths(df: DataFrame, categories: Sequence[str]) -> DataFrame:
    """What the encoder makes of each column: its labels and one more."""
    counts = df.agg(*[(F.count_distinct(c) + 1).alias(c) for c in categories])
    return counts.unpivot([], list(categories), "column_name", "width")


def tree_model(train: DataFrame, numeric: Sequence[str], validation: DataFrame | None = None, rounds: int = 30, depth: int = 6, seed: int = 42):
    """Boosted trees for the label; missing numbers become train medians first. Classes are weighted alike. With validation rows, rounds end when their loss no longer falls; without any, all rounds are made."""
    n = train.agg(F.sum("label").alias("p"), F.count("*").alias("n")).first()
    weight = (n["n"] - n["p"]) / n["p"] if n["p"] else 1.0
    filled = Imputer(strategy="median", inputCols=list(numeric), outputCols=[f"{c}__f" for c in numeric])
    assemble = VectorAssembler(inputCols=filled.getOutputCols(), outputCol="features")
    trees = GBTClassifier(maxDepth=depth, stepSize=0.05, maxBins=128, maxIter=rounds, subsamplingRate=0.8, weightCol="w", seed=seed)
    weighted = lambda df: df.withColumn("w", F.when(F.col("label") == 1, F.lit(weight)).otherwise(F.lit(1.0)))
    medians = filled.fit(train)
    if validation is None or validation.isEmpty():
        return PipelineModel([medians, *Pipeline(stages=[assemble, trees]).fit(medians.transform(weighted(train))).stages])
    both = weighted(train).withColumn("held", F.lit(False)).unionByName(weighted(validation).withColumn("held", F.lit(True)))
    trees.setValidationIndicatorCol("held")
    return PipelineModel([medians, *Pipeline(stages=[assemble, trees]).fit(medians.transform(both)).stages])


def linear_model(train: DataFrame, features: Sequence[str]):
    assemble = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")
    return Pipeline(stages=[assemble, LogisticRegression(regParam=1e-3)]).fit(train)


def scored(model, df: DataFrame) -> DataFrame:
    return model.transform(df).withColumn("p", vector_to_array("probability")[1])


def linear_attributions(df: DataFrame, coefficients: dict[str, float], intercept: float) -> DataFrame:
    """attributions: coefficient times distance from the column's mean, in order; margin and base add up exactly."""
    names = list(coefficients)
    means = df.agg(*[F.avg(c).alias(f"{c}__mean") for c in names])
    x = df.join(F.broadcast(means), F.lit(True))
    parts = F.array(*[F.lit(coefficients[c]) * (F.coalesce(F.col(c), F.col(f"{c}__mean")) - F.col(f"{c}__mean")) for c in names])
    base = sum((F.lit(coefficients[c]) * F.col(f"{c}__mean") for c in names), F.lit(intercept))
    margin = sum((F.lit(coefficients[c]) * F.coalesce(F.col(c), F.col(f"{c}__mean")) for c in names), F.lit(intercept))
    return x.select(*df.columns, parts.alias("attributions"), base.alias("base"), margin.alias("margin"))


def top_attributions(df: DataFrame, names: Sequence[str], k: int, keys: Sequence[str]) -> DataFrame:
    """rank, feature and attribution of the k largest of each row."""
    x = df.select(*keys, F.posexplode(top_k(F.col("attributions"), names, k)).alias("pos", "e"))
    return x.select(*keys, (F.col("pos") + 1).alias("rank"), F.col("e.name").alias("feature"), F.col("e.value").alias("attribution"))


def importance(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """feature, mean_abs, mean and rank over all rows."""
    x = df.select(F.posexplode("attributions").alias("k", "v")).groupBy("k").agg(F.avg(F.abs("v")).alias("mean_abs"), F.avg("v").alias("mean"))
    listed = F.array(*[F.lit(n) for n in names])
    # as many rows as features
    order = Window.orderBy(F.desc("mean_abs"), "k")
    return x.select(F.element_at(listed, F.col("k") + 1).alias("feature"), "mean_abs", "mean", F.row_number().over(order).alias("rank"))


def additivity(df: DataFrame) -> DataFrame:
    """How far base plus attributions is from the margin."""
    error = F.abs(F.aggregate("attributions", F.lit(0.0), lambda a, v: a + v) + F.col("base") - F.col("margin"))
    return df.agg(F.count("*").alias("n"), F.avg(error).alias("mean_error"), F.percentile(error, F.lit(0.5)).alias("median_error"), F.max(error).alias("max_error"))


def waterfall(df: DataFrame, names: Sequence[str], keys: Sequence[str], k: int) -> DataFrame:
    """Bars from the base to the margin: the k largest attributions, then the rest as one; each starts where the last ended."""
    top = F.transform(top_k(F.col("attributions"), names, k), lambda e: F.struct(e["name"].alias("feature"), e["value"].alias("value")))
    total = F.aggregate("attributions", F.lit(0.0), lambda a, v: a + v)
    shown = F.aggregate(top, F.lit(0.0), lambda a, e: a + e["value"])
    bars = F.concat(top, F.array(F.struct(F.lit("Other").alias("feature"), (total - shown).alias("value"))))
    x = df.select(*keys, "base", F.posexplode(bars).alias("step", "e")).select(*keys, "base", "step", F.col("e.feature").alias("feature"), F.col("e.value").alias("value"))
    order = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("base") + F.sum("value").over(order)
    return x.select(*keys, "step", "feature", "value", (end - F.col("value")).alias("start"), end.alias("end"))


def rank_stability(ranked: DataFrame, run: str, feature: str, value: str, top: int) -> DataFrame:
    """For each pair of runs: Spearman's correlation of ranks and Jaccard of the top features."""
    order = Window.partitionBy(run).orderBy(F.desc(value), feature)
    r = ranked.select(F.col(run).alias("run"), F.col(feature).alias("feature"), F.row_number().over(order).cast("double").alias("rank"))
    a, b = r.select(F.col("run").alias("run_a"), "feature", F.col("rank").alias("ra")), r.select(F.col("run").alias("run_b"), "feature", F.col("rank").alias("rb"))
    x = a.join(b, "feature").where("run_a < run_b")
    in_a, in_b = F.col("ra") <= top, F.col("rb") <= top
    return x.groupBy("run_a", "run_b").agg(F.corr("ra", "rb").alias("spearman"), (F.count_if(in_a & in_b) / F.count_if(in_a | in_b)).alias("top_jaccard"))


def present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c)
