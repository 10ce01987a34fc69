"""Reading and writing: declared schemas, checked sinks, artifacts."""

from __future__ import annotations

import functools
import json
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's spark.checkpoint.dir is; without that setting, only a local session gets one, of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="icuflow-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written once to a new shared folder and read from there, and the folder."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, *folders: str) -> None:
    """Delete folders that nothing reads any more."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def read_csv(spark: SparkSession, path: str, schema: str, partitions: int | None = None) -> DataFrame:
    """CSV with a header. Compressed files can't be split, so their rows are dealt anew if partitions is given."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    return df.repartition(partitions) if partitions else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", rows_per_file: int | None = None) -> int:
    """Writes, reads back and returns the number of rows; raises if it differs from what was written."""
    from pyspark.sql import Observation

    seen = Observation()
    writer = df.observe(seen, F.count("*").alias("n")).write.mode(mode)
    (writer.option("maxRecordsPerFile", rows_per_file) if rows_per_file else writer).parquet(path)
    n, back = seen.get["n"], df.sparkSession.read.parquet(path).count()
    if n != back:
        raise ValueError(f"{path}: {n} rows written, {back} read back")
    return back


def write_metrics(df: DataFrame, path: str) -> None:
    """A small table as one CSV file."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def save_artifact(spark: SparkSession, value: dict, path: str) -> None:
    """A JSON object through Spark's file systems; raises unless it reads back equal."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    if load_artifact(spark, path) != value:
        raise ValueError(f"{path}: the artifact doesn't read back equal")


def load_artifact(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])


def gated_write(df: DataFrame, checks: DataFrame, path: str) -> bool:
    """Writes only if every row of checks is ok."""
    if checks.where(~F.coalesce(F.col("ok"), F.lit(False))).isEmpty():
        df.write.mode("overwrite").parquet(path)
        return True
    return False


def catalog_of(tables: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, column_type and n_rows for every column of the tables; a scan of no column counts the rows."""
    found = []
    for name, df in tables.items():
        listed = F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("column_type")) for c, k in df.dtypes])
        found.append(df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), F.explode(listed).alias("c"), "n_rows").select("table_name", "c.*", "n_rows"))
    return functools.reduce(DataFrame.unionByName, found)
