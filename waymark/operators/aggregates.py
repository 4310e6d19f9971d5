"""Aggregates over records and clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.functions.vectors import l2_normalize


def centroid(df: DataFrame, keys: list[str], feature: str, normalize: bool = True) -> DataFrame:
    """Keys, ``n`` and ``centroid``: the mean of the (normalised) features, dimension by dimension.

    Means combine before the shuffle. Null features do not count.
    """
    v = l2_normalize(F.col(feature)) if normalize else F.col(feature)
    parts = df.select(*keys, F.posexplode(v).alias("dim", "x"))
    means = parts.groupBy(*keys, "dim").agg(F.avg("x").alias("x"), F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.struct("dim", "x")))
    return means.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(ordered, lambda s: s["x"]).alias("centroid"))


def majority(df: DataFrame, keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """Keys and ``value``: the most frequent one; of several, that seen first by ``order``, or the smallest. Nulls do not count."""
    seen = F.min(F.struct(*order)).alias("_first") if order else F.lit(None).cast("int").alias("_first")
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"), seen)
    by = [F.desc("_n"), F.asc("_first"), F.asc(value)] if order else [F.desc("_n"), F.asc(value)]
    # a row for each key and value is left here, not one for each record
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*by))
    return counts.withColumn("_rank", first).where("_rank = 1").select(*keys, value, F.col("_n").alias("n"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int = 12) -> DataFrame:
    """``(bin, n)`` for bins 1 to ``bins`` of equal width, the last closed; values outside do not count, empty bins have 0."""
    v = df.select(value.cast("double").alias("v")).where(F.col("v").between(low, high))
    counted = v.select(F.least(F.floor((F.col("v") - low) / ((high - low) / bins)) + 1, F.lit(bins)).cast("int").alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def singleton_counts(assignments: DataFrame, keys: list[str], cluster: str = "cluster_id") -> DataFrame:
    """Keys, ``clusters``, ``singletons``, ``larger``."""
    sizes = assignments.groupBy(*keys, cluster).agg(F.count("*").alias("_n"))
    return sizes.groupBy(*keys).agg(F.count("*").alias("clusters"), F.count_if(F.col("_n") == 1).alias("singletons"), F.count_if(F.col("_n") > 1).alias("larger"))


def best(df: DataFrame, keys: list[str], score: str, ties: list[str]) -> DataFrame:
    """The row of each key with the greatest score; of several, the first by ``ties``."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), *ties))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
