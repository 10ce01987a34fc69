"""The domain tables: observations, stays, predictions and messages, derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The measured kinds, in column order.
VITALS = ("click", "error", "purchase", "signup", "view")
#: Rows of a table that one task sorts, about.
ROWS_A_TASK = 1 << 20
#: Rows of a table for each bucket of stays that a stream keeps state for, about.
ROWS_A_BUCKET = 1 << 13


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, charttime, vital_sign, value, event_id: the long fact."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("stay_id"), F.col("ts").alias("charttime"), F.col("event_type").alias("vital_sign"), "value", "event_id")


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a stay: keys, intime, label, age and three categories. The dimension is one row a user, so joins are left to the optimizer."""
    first = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("stay_id")).agg(F.date_trunc("day", F.min("ts")).alias("intime"))
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    dim = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return first.join(dim, first.stay_id == dim.c_custkey).select(
        "stay_id",
        F.floor(F.col("stay_id") / 3).alias("subject_id"),
        "intime",
        (F.col("c_acctbal") < 0).cast("int").alias("label"),
        F.pmod("stay_id", F.lit(70)).cast("int").alias("age"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_name").alias("nation"),
        F.col("r_name").alias("region"),
    )


def tasks_for(spark: SparkSession, sf_dir: str, name: str) -> int:
    """As many tasks as have about ROWS_A_TASK rows of the table each. Rows are counted from the files' footers."""
    return -(-table(spark, sf_dir, name).count() // ROWS_A_TASK)


def buckets_for(spark: SparkSession, sf_dir: str, name: str) -> int:
    """Buckets of stays for a stream over the table: some 100 stays each, and enough to deal evenly."""
    return max(64, table(spark, sf_dir, name).count() // ROWS_A_BUCKET)


def partitions_for(spark: SparkSession, sf_dir: str, name: str) -> int | None:
    """The same; None if the session's number of partitions is enough."""
    n = tasks_for(spark, sf_dir, name)
    return n if n > int(spark.conf.get("spark.sql.shuffle.partitions")) else None


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stay_id, window_id, label, p1, p2: two scores a window. Line numbers repeat within an order, so windows are numbered anew.

    What follows by stay keeps the partitions of the join, whose number grows with the table."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    if n := partitions_for(spark, sf_dir, "lineitem"):
        li, o = li.repartition(n, "l_orderkey"), o.repartition(n, "o_orderkey")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    x = li.join(o, li.l_orderkey == o.o_orderkey)
    return x.select(
        F.col("l_orderkey").alias("stay_id"),
        (F.row_number().over(order) - 1).cast("long").alias("window_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        ((F.col("l_quantity") - 0.5) / 51).alias("p1"),
        F.least(F.greatest(F.col("l_extendedprice") / 120000, F.lit(1e-4)), F.lit(1 - 1e-4)).alias("p2"),
    )


def hash01(*columns: str):
    """A number in [0, 1) from the md5 of the columns as text, joined by colons: the same in other engines."""
    key = F.concat_ws(":", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in columns])
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON observation messages with faults chosen by hash: some repeat, come late, lack a field, or hold a bad value, kind or version."""
    e = table(spark, sf_dir, "events")
    e, h = e.withColumn("h", hash01("event_id")), F.col("h")  # one digest a row
    lag = F.when(h < 0.05, F.lit(61)).when(h < 0.10, F.lit(60)).otherwise(F.lit(5))
    fields = e.select(
        F.when(h.between(0.10, 0.12), F.lit("2.0")).otherwise(F.lit("1.0")).alias("schema_version"),
        F.col("event_id").cast("string").alias("event_id"),
        F.when(~h.between(0.12, 0.14), F.col("user_id")).alias("stay_id"),
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("charttime"),
        F.date_format(F.timestamp_seconds(F.unix_timestamp("ts") + lag), "yyyy-MM-dd HH:mm:ss").alias("ingestion_time"),
        F.when(h < 0.5, F.lit("realtime")).otherwise(F.lit("replay")).alias("source_mode"),
        F.lit("monitor").alias("source_type"),
        F.when(h.between(0.14, 0.16), F.lit("unknown")).otherwise(F.concat(F.lit(" "), F.upper("event_type"))).alias("vital_sign"),
        F.when(h.between(0.16, 0.18), -F.col("value")).otherwise(F.col("value")).alias("value"),
    )
    twice = fields.where(F.pmod(F.col("event_id").cast("long"), F.lit(20)) == 0)
    return fields.unionByName(twice).select(F.col("event_id").alias("key"), F.to_json(F.struct(*fields.columns)).alias("value"))


# The same tables as SQL, for comparison.
STAYS_SQL = """stays AS (
  SELECT f.stay_id, CAST(floor(f.stay_id / 3) AS BIGINT) AS subject_id, f.intime, CAST(c_acctbal < 0 AS INTEGER) AS label,
         CAST(f.stay_id % 70 AS INTEGER) AS age, c_mktsegment AS segment, n_name AS nation, r_name AS region
  FROM (SELECT user_id AS stay_id, date_trunc('day', min(ts)) AS intime FROM events GROUP BY 1) f
  JOIN customer ON f.stay_id = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
PREDS_SQL = """preds AS (
  SELECT l_orderkey AS stay_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS window_id,
         CAST(o_orderstatus = 'F' AS INTEGER) AS label, (l_quantity - 0.5) / 51 AS p1,
         least(greatest(l_extendedprice / 120000, 1e-4), 1 - 1e-4) AS p2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
