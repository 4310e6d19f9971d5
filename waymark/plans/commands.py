"""Whole runs from files to files: reconstruction of one region or of many, and evaluation."""

from __future__ import annotations

import argparse
import json
import logging
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark import metrics
from waymark.operators import clustering, evaluation, graph
from waymark.plans import reconstruct
from waymark.sources import records as sources
from waymark.storage import materialize

_log = logging.getLogger("waymark")


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A table by the ending of its path: CSV with a header, JSON lines, else Parquet."""
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, inferSchema=True)
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def place_cameras(cameras: DataFrame, nodes: DataFrame, cell: float) -> DataFrame:
    """``(camera_id, node_id)``: each camera (camera_id, x, y) on its nearest node (node_id, x, y)."""
    near = graph.nearest(cameras.withColumnRenamed("camera_id", "point_id"), nodes.withColumnRenamed("node_id", "site_id"), cell)
    return near.select(F.col("point_id").alias("camera_id"), F.col("site_id").alias("node_id"))


def with_numbers(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records under 64-bit numbers for their ids, and the table (record_id, name) that gives the ids back."""
    numbered = materialize(records.withColumn("name", F.col("record_id")).withColumn("record_id", F.xxhash64("record_id")), "records")
    return numbered.drop("name"), numbered.select("record_id", "name")


def to_file_form(clusters: DataFrame, members: DataFrame, names: DataFrame) -> DataFrame:
    """Clusters with the fields of a cluster file. members: (cluster_id, record_id, vehicle_id, camera_id, time)."""
    each = members.join(names, "record_id").select("cluster_id", F.struct("time", "name", "vehicle_id", "camera_id").alias("r"))
    held = each.groupBy("cluster_id").agg(F.sort_array(F.collect_list("r")).alias("r"))
    record = lambda r: F.struct(r["name"].alias("record_id"), r["vehicle_id"].alias("vehicle_id"), r["camera_id"].alias("camera_id"), r["time"].alias("time"))
    out = clusters.join(held.select("cluster_id", F.transform("r", record).alias("members")), "cluster_id")
    none = F.array().cast("array<long>")
    return out.select(
        F.col("cluster_id").cast("string"), F.col("centroid_vehicle").cast("array<float>").alias("centroid_vehicle_feature"), F.col("centroid_plate").cast("array<float>").alias("centroid_license_plate_feature"),
        F.col("plate_text").alias("centroid_license_plate_text"), F.coalesce("node_path", none).alias("node_path"), F.col("members").alias("records"),
    )


def run_centralized(spark: SparkSession, args: argparse.Namespace) -> None:
    with metrics.stage("centralized"):
        records, names = with_numbers(sources.read_records(spark, args.records, args.dimension))
        cameras = place_cameras(sources.read_cameras(spark, args.cameras), read_table(spark, args.nodes), args.cell)
        clusters = materialize(reconstruct.centralized(records, cameras, read_table(spark, args.edges), args.k, args.threshold), "clusters")
        members = clusters.select("cluster_id", F.explode("records").alias("r")).select("cluster_id", "r.record_id", "r.vehicle_id", "r.camera_id", "r.time")
        sources.write_clusters(to_file_form(clusters, members, names), args.output, args.one_array)


def run_distributed(spark: SparkSession, args: argparse.Namespace) -> None:
    with metrics.stage("distributed"):
        records, names = with_numbers(sources.read_records(spark, args.records, args.dimension))
        nodes, edges = read_table(spark, args.nodes), read_table(spark, args.edges)
        cameras = place_cameras(sources.read_cameras(spark, args.cameras), nodes, args.cell)
        region_nodes, region_cameras, borders = reconstruct.partition(nodes, edges, cameras, nodes.select("node_id", "region"))
        clusters, members = reconstruct.distributed(records, cameras, edges, region_nodes, region_cameras, borders, args.k, args.threshold)
        members = members.drop("node_id", "camera_id", "time").join(records.select("record_id", "vehicle_id", "camera_id", "time"), "record_id")
        sources.write_clusters(to_file_form(clusters, members, names), args.output, args.one_array)


def run_evaluate(spark: SparkSession, args: argparse.Namespace) -> dict[str, float | None]:
    """Precision, recall, F1, expansion, LCSS, EDR and STLC of a cluster file against the annotated records, or another cluster file."""
    held = materialize(sources.read_clusters(spark, args.clusters, args.one_array), "clusters")
    nodes, edges = read_table(spark, args.nodes), read_table(spark, args.edges)
    cameras = place_cameras(sources.read_cameras(spark, args.cameras), nodes, args.cell)
    of = lambda c: c.select("cluster_id", F.explode("records").alias("r")).select("cluster_id", "r.record_id", "r.camera_id", F.col("r.time").alias("time")).join(cameras, "camera_id")
    truth = sources.read_raw(spark, args.records).select("record_id", "vehicle_id", "camera_id", "time").join(cameras, "camera_id")
    members, paths = of(held), held.select("cluster_id", "node_path")
    if args.true_clusters:
        true = materialize(sources.read_clusters(spark, args.true_clusters, args.one_array), "clusters")
        vehicles = truth.where("vehicle_id IS NOT NULL").select("vehicle_id").distinct()
        scores = evaluation.against_clusters(members, of(true), vehicles, truth.select("record_id", "vehicle_id"))
        distances = evaluation.trajectories_against_clusters(members, paths, of(true), true.select("cluster_id", "node_path"), vehicles, truth, nodes)
    else:
        scores = evaluation.against_records(members, truth.select("record_id", "vehicle_id"))
        distances = evaluation.trajectories_against_records(members, paths, truth, nodes, edges)
    out = {**scores.first().asDict(), **distances.first().asDict()}
    for name, value in out.items():
        _log.info("%s: %s", name, value)
    return out


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="python -m waymark", description=__doc__)
    commands = top.add_subparsers(dest="command", required=True)
    for name, what in (("centralized", run_centralized), ("distributed", run_distributed), ("evaluate", run_evaluate)):
        p = commands.add_parser(name, help=what.__doc__)
        p.set_defaults(run=what)
        p.add_argument("--records", required=True, help="record file, JSON lines")
        p.add_argument("--cameras", required=True, help="camera file, JSON lines of camera_id and position")
        p.add_argument("--nodes", required=True, help="table of node_id, x, y; for distributed with region")
        p.add_argument("--edges", required=True, help="table of u, v, length")
        p.add_argument("--cell", type=float, default=500.0, help="width of a cell in the search for a camera's node")
        p.add_argument("--one-array", action="store_true", help="cluster files are one JSON array")
        p.add_argument("--log", help="log file")
        if name == "evaluate":
            p.add_argument("--clusters", required=True, help="cluster file")
            p.add_argument("--true-clusters", help="cluster file taken as the truth")
        else:
            p.add_argument("--output", required=True, help="cluster file to write")
            p.add_argument("--k", type=int, default=clustering.K)
            p.add_argument("--threshold", type=float, default=clustering.SIMILARITY_THRESHOLD)
            p.add_argument("--dimension", type=int, default=sources.DIMENSION, help="of the projected features")
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    args = parser().parse_args(argv)
    metrics.log_to(args.log)
    found = args.run(spark or SparkSession.builder.appName(f"waymark {args.command}").getOrCreate(), args)
    if found is not None:
        print(json.dumps(found))
