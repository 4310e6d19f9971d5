"""Matching and merging of clusters across regions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.scalars import MERGE_DECAY, MERGING_THRESHOLD, merge_score
from waymark.functions.trajectories import is_valid_path, path_edges
from waymark.operators.aggregates import best, centroid, majority
from waymark.operators.clustering import K
from waymark.operators.components import connected_components
from waymark.operators.knn import knn_join


def crossing(clusters: DataFrame, borders: DataFrame) -> DataFrame:
    """``(cluster_id, region, direction)``: paths (cluster_id, node_path) that take a border edge."""
    steps = clusters.where(is_valid_path(F.col("node_path"))).select("cluster_id", F.explode(path_edges(F.col("node_path"))).alias("e"))
    return steps.select("cluster_id", "e.u", "e.v").join(borders, ["u", "v"]).select("cluster_id", "region", "direction").distinct()


def overlapping(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(cluster_id, region)``: clusters with a record, (cluster_id, record_id, node_id), at a node of the region."""
    return members.join(nodes.select("region", "node_id"), "node_id").select("cluster_id", "region").distinct()


def overlap_scores(left: DataFrame, right: DataFrame, decay: float = MERGE_DECAY) -> DataFrame:
    """``(left_id, right_id, common, apart, score)`` of clusters, (cluster_id, record_id), that share a record.

    An equi-join on the record, counted by pair of clusters; what is apart follows
    from the sizes. Pairs without a common record never merge and never arise.
    """
    a, b = left.select(F.col("cluster_id").alias("left_id"), "record_id").distinct(), right.select(F.col("cluster_id").alias("right_id"), "record_id").distinct()
    common = a.join(b, "record_id").groupBy("left_id", "right_id").agg(F.count("*").alias("common"))
    na, nb = a.groupBy("left_id").agg(F.count("*").alias("_na")), b.groupBy("right_id").agg(F.count("*").alias("_nb"))
    apart = F.col("_na") + F.col("_nb") - 2 * F.col("common")
    return common.join(na, "left_id").join(nb, "right_id").select("left_id", "right_id", "common", apart.alias("apart"), merge_score(F.col("common"), apart, decay).alias("score"))


def pairs_to_merge(scores: DataFrame, threshold: float = MERGING_THRESHOLD, keys: tuple[str, ...] = ("left_id",)) -> DataFrame:
    """The best right cluster of each left one, if it scores the threshold or more; ties to the smaller id."""
    return best(scores, list(keys), "score", ["right_id"]).where(F.col("score") >= threshold)


def rough_search(queries: DataFrame, base: DataFrame, centroids: DataFrame, k: int = K) -> DataFrame:
    """``(aux, main, cluster_id, other)``: for each cluster of ``queries`` the clusters of ``base`` with the nearest centroids.

    queries: (aux, main, cluster_id); base: (aux, main, other); centroids:
    (cluster_id, centroid_vehicle, centroid_plate). The k nearest by the vehicle
    centroid and the k nearest by the plate centroid, among clusters of the same
    pair of regions; a null centroid is near nothing. Ids are integers.
    """

    def long(side: DataFrame, name: str) -> DataFrame:
        kinds = F.explode(F.array(*(F.struct(F.lit(f"{i}|").alias("kind"), F.col(c).cast("array<double>").alias("feature")) for i, c in enumerate(("centroid_vehicle", "centroid_plate")))))
        held = side.select("aux", "main", F.col(name).alias("cluster_id")).distinct().join(centroids, "cluster_id")
        return held.select(F.col("cluster_id").alias("id"), "aux", "main", kinds.alias("k")).select(F.concat("k.kind", "aux", F.lit("|"), "main").alias("kg"), "id", "k.feature")

    near = knn_join(long(queries, "cluster_id"), long(base, "other"), k, by="kg")
    part = F.split("g", r"\|")
    return near.select(part[1].alias("aux"), part[2].alias("main"), F.col("id").alias("cluster_id"), F.col("neighbor").alias("other")).where("cluster_id <> other").distinct()


def match_across(aux: DataFrame, main: DataFrame, aux_paths: DataFrame, borders: DataFrame, nodes: DataFrame, centroids: DataFrame | None = None, k: int = K) -> DataFrame:
    """``(a, b)``: clusters of auxiliary regions and the main-region clusters they continue, in one plan for all regions.

    aux and main: members (region, cluster_id, record_id, node_id); aux_paths:
    (cluster_id, node_path); borders: border_edges(); nodes: (region, node_id) of
    main and auxiliary regions. For each auxiliary cluster that crosses from i to j
    (or back), the records it shares with clusters of i, and of j, at nodes that
    the main and the auxiliary region share, are scored; the best of each side is
    taken. centroids, if given, restricts the pairs to those that a rough search on
    them finds, among the main region's clusters with a record in the auxiliary one.
    """
    ends = F.split("region", "-")
    cross = crossing(aux_paths, borders).select("cluster_id", "region", "direction")
    side = cross.select("cluster_id", F.col("region").alias("aux"), "direction", F.explode(F.array(ends[0], ends[1])).alias("main"))
    shared = nodes.select(F.col("region").alias("aux"), "node_id").join(nodes.select(F.col("region").alias("main"), "node_id"), "node_id")
    sides = side.join(shared, ["aux", "main"])
    a = aux.join(sides, ["cluster_id", "node_id"]).select("cluster_id", "aux", "main", "direction", "record_id").distinct()
    in_main = main.select(F.col("region").alias("main"), F.col("cluster_id").alias("other"), "record_id", "node_id")
    b = in_main.join(shared, ["main", "node_id"]).select("aux", "main", "other", "record_id").distinct()
    keys = ["cluster_id", "aux", "main", "direction"]
    common = a.join(b, ["aux", "main", "record_id"]).groupBy(*keys, "other").agg(F.count("*").alias("common"))
    if centroids is not None:
        near = rough_search(side.select("cluster_id", "aux", "main"), b.select("aux", "main", "other"), centroids, k)
        common = common.join(near, ["aux", "main", "cluster_id", "other"], "left_semi")
    na = a.groupBy(*keys).agg(F.count("*").alias("_na"))
    nb = b.groupBy("aux", "main", "other").agg(F.count("*").alias("_nb"))
    apart = F.col("_na") + F.col("_nb") - 2 * F.col("common")
    scored = common.join(na, keys).join(nb, ["aux", "main", "other"]).withColumn("score", merge_score(F.col("common"), apart))
    top = best(scored, keys, "score", ["other"]).where(F.col("score") >= MERGING_THRESHOLD)
    return top.select(F.col("cluster_id").alias("a"), F.col("other").alias("b")).distinct()


def merge(clusters: DataFrame, members: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Clusters and members after merging along ``pairs`` (a, b).

    clusters: (cluster_id, centroid_vehicle, centroid_plate, plate_text); members:
    (cluster_id, record_id, ...). A component becomes one cluster, named by its
    smallest: its centroids are the plain means of its clusters' centroids, its
    text the most frequent of its clusters' texts (ties to the smaller), its
    records the union. Other clusters stay.
    """
    of = connected_components(pairs, "a", "b").withColumnRenamed("node", "cluster_id")
    named = clusters.join(of, "cluster_id", "left")
    group = named.where("component IS NOT NULL").drop("cluster_id").withColumnRenamed("component", "cluster_id")
    v = centroid(group, ["cluster_id"], "centroid_vehicle", normalize=False).select("cluster_id", F.col("centroid").alias("centroid_vehicle"))
    p = centroid(group, ["cluster_id"], "centroid_plate", normalize=False).select("cluster_id", F.col("centroid").alias("centroid_plate"))
    text = majority(group, ["cluster_id"], "plate_text").select("cluster_id", "plate_text")
    merged = group.select("cluster_id").distinct().join(v, "cluster_id", "left").join(p, "cluster_id", "left").join(text, "cluster_id", "left")
    rest = named.where("component IS NULL").select(*merged.columns)
    moved = members.join(of, "cluster_id", "left").withColumn("cluster_id", F.coalesce("component", "cluster_id")).drop("component")
    return rest.unionByName(merged), moved.dropDuplicates(["cluster_id", "record_id"])
