"""Splits without leaks: by subject or stay, stratified by label, decided by a hash that any layout repeats."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from icuflow.sources.telemetry import hash01


def group_labels(df: DataFrame, group: str, label: str = "label") -> DataFrame:
    """A group's label is the largest of its rows."""
    return df.groupBy(group).agg(F.max(label).alias("label"))


def hash_split(groups: DataFrame, group: str, shares: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Each group to a part by its hash, positives and negatives apart: no shuffle beyond the groups' own."""
    h = hash01(F.lit(seed), F.col("label"), F.col(group))
    part, low = F.lit(None).cast("string"), 0.0
    for name, share in shares.items():
        part = F.when((h >= low) & (h < low + share), F.lit(name)).otherwise(part)
        low += share
    return groups.withColumn("split", F.coalesce(part, F.lit(list(shares)[-1])))


def ranked_split(groups: DataFrame, group: str, cuts: Mapping[str, float], seed: int = 42) -> DataFrame:
    """Exact shares: groups are ranked by hash within their label. cuts: upper bounds of the rank's share, ascending."""
    order = Window.partitionBy("label").orderBy(hash01(F.lit(seed), F.col(group)), group)
    share = F.percent_rank().over(order)
    part = F.lit(list(cuts)[-1])
    for name, upper in reversed(list(cuts.items())[:-1]):
        part = F.when(share < upper, F.lit(name)).otherwise(part)
    return groups.withColumn("split", part)


def assigned(df: DataFrame, splits: DataFrame, group: str) -> DataFrame:
    return df.join(splits.select(group, "split"), group, "left")


def split_summary(df: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Per part: rows, distinct keys, positives and prevalence. keys: output name to column."""
    counts = [F.count_distinct(c).alias(n) for n, c in keys.items()]
    return df.groupBy("split").agg(F.count("*").alias("n_rows"), *counts, F.sum("label").alias("n_positive"), F.round(F.avg("label"), 6).alias("prevalence"))


def sample_by_hash(df: DataFrame, n: int, *columns: str, seed: int = 0) -> DataFrame:
    """The n rows with the smallest hashes: a uniform sample that doesn't depend on order."""
    return df.withColumn("_h", hash01(F.lit(seed), *map(F.col, columns))).orderBy("_h", *columns).limit(n).drop("_h")


def interleaved(df: DataFrame, group: str, order: str, seed: int = 0) -> DataFrame:
    """turn: the row's place within its group; rank in turn: a hash. Sorting by both deals the groups round robin, order kept inside."""
    turn = Window.partitionBy(group).orderBy(order)
    return df.withColumn("turn", F.row_number().over(turn)).withColumn("shuffle", hash01(F.lit(seed), F.col(group), F.col("turn")))


def systematic(df: DataFrame, group: str, order: str, step: int, forced: DataFrame) -> DataFrame:
    """Every step-th row of each group, and the forced keys."""
    turn = Window.partitionBy(group).orderBy(order)
    picked = df.withColumn("_n", F.row_number().over(turn)).where(F.pmod("_n", F.lit(step)) == 0).drop("_n")
    return picked.unionByName(df.join(forced.select(group, order).distinct(), [group, order], "left_semi")).distinct()


def block_sample(scan: DataFrame, step: int, block_rows: int, forced: Column | None = None, most: int = 64) -> DataFrame:
    """Of every step-th block of a Parquet scan up to so many evenly spaced rows, the first and the last among them, and all forced rows.

    A block is a run of block_rows rows of a file, by place in the file (_metadata.row_index); blocks are numbered over the
    files by path. Only one row a file is numbered in one task, and goes to all others; a file's rows stay where they are read. scan: the columns wanted, straight from files."""
    names = scan.columns
    x = scan.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    sizes = x.groupBy("_file").agg(F.count("*").alias("_n")).withColumn("_blocks", F.ceil(F.col("_n") / block_rows))
    before = F.sum("_blocks").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = sizes.select("_file", "_n", F.coalesce(before, F.lit(0)).alias("_before"))
    y = x.join(F.broadcast(files), "_file").withColumn("_block", F.floor(F.col("_row") / block_rows)).withColumn("_at", F.col("_row") % block_rows)
    n = F.least(F.lit(block_rows), F.col("_n") - F.col("_block") * block_rows)
    # place k of m is at floor(k * (n - 1) / (m - 1)): a row is one of them if some k falls between it and the next
    at, last = F.col("_at"), most - 1
    spaced = (n <= most) | (at == n - 1) | (F.ceil(at * last / (n - 1)) < F.ceil((at + 1) * last / (n - 1)))
    chosen = ((F.col("_before") + F.col("_block")) % step == 0) & spaced
    return y.where(chosen if forced is None else chosen | forced).select(*names)
