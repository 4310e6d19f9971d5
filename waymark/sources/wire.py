"""The messages that regions exchange, as columns. Transport is the shuffle; this is for files and queues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import null_if_unset, unset_if_null

RECORD = "struct<record_id:string,vehicle_id:long,camera_id:long,timestamp:long>"
ENVELOPE = f"region_id string, is_auxiliary boolean, done boolean, cluster struct<cluster_id:string,centroid_vehicle_feature:array<float>,centroid_license_plate_feature:array<float>,centroid_license_plate_text:string,node_path:array<long>,records:array<{RECORD}>>"


def to_envelopes(clusters: DataFrame, region: Column, is_auxiliary: Column) -> DataFrame:
    """A message (region_id, is_auxiliary, done, cluster as JSON) for each cluster with a path of two nodes or more, and one that says the region is done."""
    record = lambda r: F.struct(r["record_id"].alias("record_id"), unset_if_null(r["vehicle_id"]).alias("vehicle_id"), r["camera_id"].alias("camera_id"), r["time"].alias("timestamp"))
    names = ("cluster_id", "centroid_vehicle_feature", "centroid_license_plate_feature", "centroid_license_plate_text", "node_path")
    cluster = F.struct(*names, F.transform("records", record).alias("records"))
    named = clusters.select("*", region.alias("region_id"), is_auxiliary.alias("is_auxiliary"))
    sent = named.where(F.size("node_path") > 1).select("region_id", "is_auxiliary", F.lit(False).alias("done"), F.to_json(cluster).alias("cluster"))
    done = named.select("region_id", "is_auxiliary").distinct().select("region_id", "is_auxiliary", F.lit(True).alias("done"), F.lit(None).cast("string").alias("cluster"))
    return sent.unionByName(done)


def from_envelopes(messages: DataFrame) -> DataFrame:
    """Clusters of messages, with ``region_id`` and ``is_auxiliary``."""
    kind = ENVELOPE.split("cluster ", 1)[1]
    c = messages.where("NOT done").select("region_id", "is_auxiliary", F.from_json("cluster", kind).alias("c")).select("region_id", "is_auxiliary", "c.*")
    record = lambda r: F.struct(r["record_id"].alias("record_id"), null_if_unset(r["vehicle_id"]).alias("vehicle_id"), r["camera_id"].alias("camera_id"), r["timestamp"].alias("time"))
    return c.withColumn("records", F.transform("records", record))


def is_complete(messages: DataFrame, regions: DataFrame) -> bool:
    """Every region (region_id) has said that it is done."""
    return regions.join(messages.where("done").select("region_id").distinct(), "region_id", "left_anti").isEmpty()
