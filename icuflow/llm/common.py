"""What the operators of this subpackage share: the scratch folder, tables and hashed samples."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MEMBER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where it is unset, as in local tests, one of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="icuflow-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later reads neither recompute it nor depend on one executor."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    return out


def discard(*settled: DataFrame) -> None:
    """Delete settled tables that nothing reads any more."""
    for df in settled:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def id_remainder(column: str, divisor: int) -> Column:
    """crc32 of the id written as text, modulo divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def hash_share(*columns: str) -> Column:
    """A number in [0, 1) that depends on the row alone, for samples that any layout repeats."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / float(1 << 30)


def unused(columns: Iterable[str], name: str) -> str:
    """name, or name with underscores until no column is called so (Spark's names ignore case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return what a worker has freed to the system: workers are used again, stage after stage, and keep it otherwise."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def thrifty(run: Callable) -> Callable:
    """A function for mapInArrow that gives back what it has freed once its batches are done."""

    def wrapped(batches):
        yield from run(batches)
        give_back()

    return wrapped


def chars_in(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.char_length("text"))).first()[0] or 0


class Members:
    """A bitmap of hashed ids, of MEMBER_BITS bits at most: no member is missed, a few others pass, and a later join drops those.

    ids: one column. has() takes F.xxhash64 of ids. The bitmap is put together by an aggregation, its size doesn't grow beyond the bound."""

    def __init__(self, ids: DataFrame, most: int = MEMBER_BITS):
        n = ids.count()
        self.bits = 1 << min(max(16, (16 * n).bit_length()), most.bit_length() - 1)
        place = F.pmod(F.xxhash64(ids.columns[0]), F.lit(self.bits))
        bits = ids.select(F.shiftright(place, 6).alias("word"), F.expr("1L").alias("one"), place.bitwiseAND(63).cast("int").alias("bit"))
        words = bits.groupBy("word").agg(F.bit_or(F.expr("shiftleft(one, bit)")).alias("set")).toArrow()
        self.words = np.zeros(self.bits >> 6, np.int64)
        self.words[words.column("word").to_numpy()] = words.column("set").to_numpy()

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes & np.int64(self.bits - 1)
        return (self.words[place >> 6] >> (place & 63)) & 1 == 1
