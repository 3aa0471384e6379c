"""Session helpers: staged tables in the shared folder and the clock of integer nanoseconds."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. In local mode, where all is one process, an own folder if it is unset; an error on a cluster."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir isn't set: it names the folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='lumenspan-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/lumenspan-{uuid.uuid4().hex}/{name}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at.getParent())
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read again: lineage ends there."""
    path, schema = new_folder(df.sparkSession, name), df.schema
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Have the files of shuffles that nothing needs any more removed; else they stay until the driver happens to collect its garbage."""
    for _ in range(2):  # what just ended may still be held by an event that waits for a listener
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def nanos(df: DataFrame, name: str) -> Column:
    """Nanoseconds since 1970 of a timestamp column, with or without a zone; without one it is read as UTC."""
    if dict(df.dtypes)[name] == "timestamp_ntz":
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{name}`) * 1000L")
    return F.unix_micros(name) * 1000


def floor_ns(ts: Column, seconds: int) -> Column:
    """Start of the tumbling window of this many seconds that holds ``ts``."""
    size = seconds * 1_000_000_000
    return ts - F.pmod(ts, F.lit(size))


def gathered(df: DataFrame, key: str, *order: str) -> DataFrame:
    """Rows of a key in one partition and next to each other, in order.

    The partition is chosen by a hash of the key: a repartition by the key itself may be left out where a join below has
    it already, and adaptive execution can undo that join's partitions later.
    """
    return df.repartition(F.xxhash64(key)).sortWithinPartitions(key, *order)
