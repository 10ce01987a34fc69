"""Exact quantiles by repeated range counts: no task sees all values, or all distinct values, of a column or group.

All columns, groups and points go together. Each wanted rank has a bracket, a range of values that holds it. A round cuts
every bracket at about CUTS values of its own (an approximate sketch; any cuts are right), counts what lies between, and
keeps the part with the rank, so a bracket shrinks by about CUTS a round. Those with at most MOST rows, or one value, are
done: the rank's value is looked up in their sorted rows. Nulls don't count; NaN is the greatest value, as in sorting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from icuflow.sources.files import kept, removed

CUTS, MOST = 256, 1 << 15
#: So many ranks' cuts (2 KB each) go to every task; with more, the brackets are many enough to deal rows by.
FEW = 4096


def _narrowed(values: DataFrame, targets: DataFrame, few: bool) -> DataFrame:
    """targets with smaller brackets: g, rank, low, high, below (rows of g under the bracket) and m (rows in it). few: rows stay where they are, as a shuffle by bracket would put each bracket's into one task."""
    brackets = targets.select("g", "low", "high").distinct()
    inside = values.join(brackets, "g").where("v between low and high")
    cuts = inside.groupBy("g", "low", "high").agg(F.array_distinct(F.percentile_approx("v", [k / CUTS for k in range(1, CUTS)], 20 * CUTS)).alias("cuts"))
    steps = CUTS.bit_length()
    at = f"a + shiftleft(1, {steps - 1} - k)"
    part = F.expr(f"aggregate(sequence(0, {steps - 1}), 0, (a, k) -> if({at} <= size(cuts) AND cuts[{at} - 1] < v, {at}, a))")  # how many cuts are below v
    counts = inside.join(F.broadcast(cuts) if few else cuts, ["g", "low", "high"]).groupBy("g", "low", "high", part.alias("part")).agg(F.count("*").alias("c"), F.min("v").alias("from"), F.max("v").alias("to"))
    upto = Window.partitionBy("g", "low", "high").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # CUTS rows at most
    counts = counts.withColumn("under", F.coalesce(F.sum("c").over(upto), F.lit(0)))
    x = targets.drop("m").join(counts, ["g", "low", "high"]).where("rank - below >= under and rank - below < under + c")
    return x.select("g", "rank", F.col("from").alias("low"), F.col("to").alias("high"), (F.col("below") + F.col("under")).alias("below"), F.col("c").alias("m"))


def exact_quantiles(df: DataFrame, columns: Sequence[str], points: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by..., column_name, n and q: the interpolated values at points, as an array. Columns without values give no row."""
    listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("v")) for c in columns])
    x = df.select(*by, F.explode(listed).alias("e")).where("e.v is not null").select(F.struct(*by, "e.column_name").alias("g"), "e.v")
    values, path = kept(x, "quantiles")
    own = values.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
    place = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(place(p)), F.ceil(place(p))) for p in points])))
    targets, at = kept(own.select("g", F.explode(ranks).alias("rank"), "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("m")), "ranks")
    todo = f"m > {MOST} and low < high"
    folders = [path, at]
    while n := targets.where(todo).count():
        targets, at = kept(targets.where(f"not ({todo})").unionByName(_narrowed(values, targets.where(todo), n <= FEW)), "ranks")
        folders.append(at)
    brackets = targets.where("low < high").select("g", "low", "high").distinct()
    rows = values.join(brackets, "g").where("v between low and high").groupBy("g", "low", "high").agg(F.sort_array(F.collect_list("v")).alias("vs"))  # MOST at most
    value = F.coalesce(F.expr("vs[int(rank - below)]"), F.col("low"))
    found = targets.join(rows, ["g", "low", "high"], "left").groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", value.alias("v")))).alias("at"))
    y = found.join(own.select("g", "n"), "g")

    def one(p: float):
        low, high = F.col("at")[F.floor(place(p))], F.col("at")[F.ceil(place(p))]
        return low + (high - low) * (place(p) - F.floor(place(p)))

    out, _ = kept(y.select("g.*", "n", F.array(*[one(p) for p in points]).alias("q")), "quantiles")
    removed(df.sparkSession, *folders)
    return out
