"""Shared helpers of the training-data operators: reading, cutting lineage, batching."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and bytes handed to a Python worker at once, so that a batch of long texts stays small.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
#: Folders that stash() has written and purge() has not deleted, oldest first.
_STASHED: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One input table, by a path that only Spark needs to understand."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes where
    they are larger. They are read when a plan runs, so they stay lowered."""
    unit = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = re.match(r"(-?[0-9]+)([kmg]?)", spark.conf.get(key).lower())
        if not now or not 0 < int(now[1]) * unit[now[2]] <= most:
            spark.conf.set(key, str(most))


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, of spark.checkpoint.dir. Where it is not
    set, one process (a local master, as in tests) gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="finlake-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def stash(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: later jobs start from the
    files, so a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/finlake-{uuid.uuid4().hex}"
    _STASHED.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stashed() -> int:
    """How many folders stash() has left so far; purge() can begin there."""
    return len(_STASHED)


def purge(spark: SparkSession, since: int = 0, last: int = 0) -> None:
    """Delete the folders that this process has stashed from the place ``since`` on, but
    for the ``last`` newest: once what was made from them is written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    upto = max(since, len(_STASHED) - last)
    for path in _STASHED[since:upto]:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    del _STASHED[since:upto]


def free_name(name: str, taken: list[str]) -> str:
    """name, with as many underscores before it as no column of docs has, in any case."""
    have = {t.lower() for t in taken}
    while name.lower() in have:
        name = f"_{name}"
    return name


def rank_by(df: DataFrame, order: Column) -> DataFrame:
    """df with _rank, the place of each row from 0: rows are dealt by ranges of
    ``order``, counted a range, and numbered within it. No task holds all rows."""
    ranged = stash(df.repartitionByRange(partitions(df.sparkSession), order).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    offsets = ranged.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(order)) - 1
    return stash(ranged.join(offsets, "_part").withColumn("_rank", inside + F.col("_before")).drop("_part", "_before"))


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64 over an array of uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
