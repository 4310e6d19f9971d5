"""Preparation of record files: ids, order, subsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.scalars import uuid5

#: Fixed value: the namespace for URLs of RFC 4122, taken unless another is given.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def attach_ids(lines: DataFrame, index: str, namespace: str = NAMESPACE, prefix: str = "vehicle-record-") -> DataFrame:
    """``lines`` with ``record_id``, the version 5 UUID of the line's number."""
    return lines.withColumn("record_id", uuid5(namespace, F.concat(F.lit(prefix), F.col(index).cast("string"))))


def numbered(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """``lines`` with their number in file order, from 0.

    A line's place in its partition is known to it; the sizes of the partitions before
    it, one row for each partition, are joined. No sort, and no Python over rows. Give
    a table that is read alike each time, as it is read twice.
    """
    held = lines.withColumn("__part", F.spark_partition_id()).withColumn("__at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    sizes = held.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    base = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__base"))
    return held.join(base, "__part").withColumn(name, F.col("__base") + F.col("__at")).drop("__part", "__at", "__base")


def sort_by_time(records: DataFrame, time: str, tie: str) -> DataFrame:
    """Records in order of time, ties by ``tie``: an external, range-partitioned sort."""
    return records.orderBy(time, tie)


def out_of_order(records: DataFrame, time: str, tie: str) -> DataFrame:
    """``inversions``: how many records have a smaller time than the one before them by ``tie``.

    Neighbours are compared within stretches of ``tie`` and across their seams, so no task orders the whole table.
    """
    stretch = records.select(F.col(time).alias("t"), F.col(tie).alias("o")).withColumn("s", F.floor(F.col("o") / 65536))
    inside = stretch.withColumn("p", F.lag("t").over(Window.partitionBy("s").orderBy("o")))
    ends = stretch.groupBy("s").agg(F.min_by("t", "o").alias("first"), F.max_by("t", "o").alias("last"))
    seams = ends.withColumn("before", F.lag("last").over(Window.orderBy("s"))).agg(F.count_if(F.col("before") > F.col("first")).alias("n"))
    within = inside.agg(F.count_if(F.col("p") > F.col("t")).alias("m"))
    return within.crossJoin(seams).select((F.col("m") + F.col("n")).alias("inversions"))


def subset(records: DataFrame, annotated: Column, n: int, order: list[str]) -> DataFrame:
    """All annotated records and the first ``n`` others in order: a dataset of a chosen size."""
    # the first n come from a distributed top-n; the rank of each record is never taken
    others = records.where(~annotated).orderBy(*order).limit(n)
    return records.where(annotated).unionByName(others)
