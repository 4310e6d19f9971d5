"""Whole reconstructions: one region, or many with merging across their borders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.trajectories import is_valid_path
from waymark.operators import clustering, graph, mapmatching, merging
from waymark.sources.records import in_regions
from waymark.storage import materialize


def _with_paths(clusters: DataFrame, cameras: DataFrame, edges: DataFrame) -> DataFrame:
    """Clusters of two records or more get the path through their records' nodes in order of time."""
    step = clusters.where("n >= 2").select("region", "cluster_id", F.posexplode("records").alias("i", "r"))
    nodes = step.select("region", "cluster_id", "i", F.col("r.camera_id").alias("camera_id")).join(cameras.select("camera_id", "node_id"), "camera_id")
    ordered = F.sort_array(F.collect_list(F.struct("i", "node_id")))
    traces = nodes.groupBy("region", "cluster_id").agg(F.transform(ordered, lambda s: s["node_id"]).alias("trace"))
    matched = mapmatching.map_match(traces, edges).drop("trace")
    return clusters.join(matched, ["region", "cluster_id"], "left")


def centralized(records: DataFrame, cameras: DataFrame, edges: DataFrame, k: int = clustering.K, threshold: float = 0.85) -> DataFrame:
    """Clusters with node paths of all records as one region. cameras: (camera_id, node_id), a bounded table."""
    one = records.withColumn("region", F.lit("0"))
    assigned = materialize(clustering.cluster_records(one, k, threshold), "assigned")
    return _with_paths(clustering.summarize(assigned), cameras, edges)


def distributed(records: DataFrame, cameras: DataFrame, edges: DataFrame, region_nodes: DataFrame, region_cameras: DataFrame, borders: DataFrame, k: int = clustering.K, threshold: float = 0.85) -> tuple[DataFrame, DataFrame]:
    """``(clusters, members)`` by regions, then merged across borders.

    Every region, main or auxiliary, is a group of the same plan: what the original
    system runs on separate hosts and ships by messages is a shuffle here. A record
    in several regions is clustered in each; ids of clusters tell regions apart.
    Across regions, clusters are compared that a search on centroids finds near.
    """
    regions = region_cameras.select("region").distinct()
    number = regions.select("region", F.xxhash64("region").alias("_r"))
    assigned = clustering.cluster_records(in_regions(records, region_cameras), k, threshold).join(number, "region")
    assigned = materialize(assigned.withColumn("cluster_id", F.xxhash64("_r", "cluster_id")).drop("_r"), "assigned")
    clusters = materialize(_with_paths(clustering.summarize(assigned), cameras, edges), "clusters")
    members = assigned.select("region", "cluster_id", "record_id", "camera_id", "time").join(cameras.select("camera_id", "node_id"), "camera_id")
    aux = F.col("region").contains("-")
    shipped = clusters.where(is_valid_path(F.col("node_path"))).select("cluster_id")
    moving = members.join(shipped, "cluster_id", "left_semi")
    paths = clusters.where(aux).select("cluster_id", "node_path")
    flat = clusters.select("cluster_id", "centroid_vehicle", "centroid_plate", "plate_text")
    centroids = flat.select("cluster_id", "centroid_vehicle", "centroid_plate")
    pairs = materialize(merging.match_across(moving.where(aux), moving.where(~aux), paths, borders, region_nodes.select("region", "node_id"), centroids, k), "pairs")
    merged, moved = merging.merge(flat, members.select("cluster_id", "record_id", "camera_id", "node_id", "time"), pairs)
    moved = materialize(moved, "members")
    ordered = F.sort_array(F.collect_list(F.struct("time", "record_id", "node_id")))
    traces = moved.groupBy("cluster_id").agg(F.count("*").alias("n"), F.transform(ordered, lambda s: s["node_id"]).alias("trace"))
    done = mapmatching.map_match(traces.where("n >= 2"), edges).select("cluster_id", "node_path")
    return merged.join(traces.select("cluster_id", "n"), "cluster_id").join(done, "cluster_id", "left"), moved


def partition(nodes: DataFrame, edges: DataFrame, cameras: DataFrame, node_regions: DataFrame, least_cameras: int = 20, low: int = 5, high: int = 10) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(region_nodes, region_cameras, borders)`` of a road network whose nodes have main regions."""
    from waymark.operators.regions import region_tables

    borders = graph.border_edges(edges, node_regions)
    aux = graph.expand_auxiliary(edges, graph.auxiliary_regions(borders), cameras, least_cameras, low, high)
    region_nodes, region_cameras = region_tables(node_regions, aux, cameras)
    return region_nodes, region_cameras, borders
