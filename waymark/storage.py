"""Tables in the shared folder: what jobs cut their lineage with.

A written table survives the loss of any executor, unlike a cached or locally
checkpointed one. The folder is the one the cluster names in
``spark.checkpoint.dir``; only where that is unset (tests) one is chosen here.
"""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

FALLBACK_DIR = "/tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver share; only on one machine (``local`` masters) may it be unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
        if not now.isDefined() and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = now.get() if now.isDefined() else f"file://{FALLBACK_DIR}"
    return named.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_dir(spark)}/waymark/{name}-{uuid.uuid4().hex}"


def _at(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path in whatever store it is; a missing one is no error."""
    fs, at = _at(spark, path)
    fs.delete(at, True)


class Written:
    """A DataFrame written to the shared folder and read back.

    Sizes of files decide on broadcasts, so they are compressed as usual, unless a
    table is known not to be joined.
    """

    def __init__(self, df: DataFrame, name: str, compression: str = "snappy") -> None:
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        df.write.option("compression", compression).parquet(self.path)
        # what a result still reads stays until the driver ends, and no longer
        fs, at = _at(self.spark, self.path)
        fs.deleteOnExit(at)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        remove(self.spark, self.path)


def materialize(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """``df``, computed once and read from the shared folder from then on."""
    return Written(df, name, compression).df


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that are over; else they stay until the driver happens to collect its garbage.

    It is the call that Spark's own cleaner makes every spark.cleaner.periodicGC.interval,
    made where files of several times the input would pile up. The driver holds on to
    the plan of its last job, so an empty one comes before.
    """
    spark.range(1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark._jvm.System.gc()
