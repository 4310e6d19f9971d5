"""Streams of events and records."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from waymark.storage import remove, scratch_path


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts by key in tumbling windows of event time, on a stream or a table; later events than ``late`` are left out of a stream."""
    stamped = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counts = stamped.groupBy(F.window("_t", width).alias("w"), key).agg(F.count("*").alias("n"))
    return counts.select(F.col("w.start").cast("timestamp_ntz").alias("start"), key, "n")


def run_available(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is, exactly once, and read what it wrote."""
    spark = stream.sparkSession
    out, check = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    if mode == "append":
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        remove(spark, check)
        return spark.read.schema(stream.schema).parquet(out)

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
    remove(spark, check)
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).first()[0]
    return every.where(F.col("batch") == last).drop("batch")


def stream_table(spark: SparkSession, path: str, files_a_batch: int = 1) -> DataFrame:
    """A stream over a folder of Parquet files, or over one file."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_a_batch)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def running_tracks(records: DataFrame, key: str, time: str) -> DataFrame:
    """Keyed state across batches: ``(key, n, first, last)`` of each vehicle after each batch that has records of it."""

    def update(name: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, first, last = state.get if state.exists else (0, None, None)
        for f in frames:
            n += len(f)
            low, high = int(f[time].min()), int(f[time].max())
            first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        state.update((n, first, last))
        yield pd.DataFrame({key: [name[0]], "n": [n], "first": [first], "last": [last]})

    return records.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, first long, last long", "n long, first long, last long", "update", GroupStateTimeout.NoTimeout)
