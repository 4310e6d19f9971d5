"""Precision, recall, F1, expansion and trajectory distances of clusters."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.functions.trajectories import Paths, against_one, edr_distance, is_valid_path, lcss_distance, places, similarity_in_space, similarity_in_time
from waymark.operators.aggregates import best
from waymark.operators.mapmatching import map_match
from waymark.storage import materialize

GAMMA = 0.8
EPSILON = 200.0
#: Pairs, and points of their true trajectories, that are compared together with one trajectory.
PAIRS, POINTS = 1024, 1 << 20


def best_clusters(members: DataFrame, truth: DataFrame) -> DataFrame:
    """``(vehicle_id, cluster_id, common, in_cluster, of_vehicle, parts)``, one row for each vehicle of ``truth``.

    members: (cluster_id, record_id); truth: (record_id, vehicle_id). The cluster
    with most records of the vehicle, ties to the smaller id; common is 0 and the
    cluster null for a vehicle in no cluster. parts: clusters with a record of it.
    """
    known = truth.where("vehicle_id IS NOT NULL")
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("in_cluster"))
    hits = members.join(known, "record_id").groupBy("vehicle_id", "cluster_id").agg(F.count("*").alias("common"))
    parts = hits.groupBy("vehicle_id").agg(F.count("*").alias("parts"))
    top = best(hits, ["vehicle_id"], "common", ["cluster_id"]).join(sizes, "cluster_id").join(parts, "vehicle_id")
    every = known.groupBy("vehicle_id").agg(F.count("*").alias("of_vehicle"))
    zero = F.lit(0).cast("long")
    return every.join(top, "vehicle_id", "left").select("vehicle_id", "cluster_id", F.coalesce("common", zero).alias("common"), "in_cluster", "of_vehicle", F.coalesce("parts", zero).alias("parts"))


def _averages(scored: DataFrame) -> DataFrame:
    p, r = F.avg("precision").alias("precision"), F.avg("recall").alias("recall")
    out = scored.agg(p, r, F.avg("parts").alias("expansion"))
    return out.select("precision", "recall", F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "expansion")


def against_records(members: DataFrame, truth: DataFrame) -> DataFrame:
    """``(precision, recall, f1, expansion)``: averages over vehicles, one without a cluster counts 0; f1 of the averages, null for 0 and 0."""
    b = best_clusters(members, truth)
    return _averages(b.select(F.coalesce(F.col("common") / F.col("in_cluster"), F.lit(0.0)).alias("precision"), (F.col("common") / F.col("of_vehicle")).alias("recall"), "parts"))


def against_clusters(members: DataFrame, true_members: DataFrame, vehicles: DataFrame, truth: DataFrame) -> DataFrame:
    """The same against clusters taken as the truth, over the ids in ``vehicles``.

    For each vehicle its best true cluster and best cluster are compared by the
    records they share, annotated or not; a vehicle in neither counts 0.
    """
    t = best_clusters(true_members, truth).select("vehicle_id", F.col("cluster_id").alias("true_id"), F.col("in_cluster").alias("in_true"))
    c = best_clusters(members, truth).select("vehicle_id", "cluster_id", "in_cluster", "parts")
    shared = members.select("cluster_id", "record_id").join(true_members.select(F.col("cluster_id").alias("true_id"), "record_id"), "record_id").groupBy("cluster_id", "true_id").agg(F.count("*").alias("common"))
    pairs = vehicles.select("vehicle_id").distinct().join(t, "vehicle_id", "left").join(c, "vehicle_id", "left").join(shared, ["cluster_id", "true_id"], "left")
    n = F.coalesce("common", F.lit(0))
    return _averages(pairs.select(F.coalesce(n / F.col("in_cluster"), F.lit(0.0)).alias("precision"), F.coalesce(n / F.col("in_true"), F.lit(0.0)).alias("recall"), F.coalesce("parts", F.lit(0)).alias("parts")))


def _side(points: DataFrame, paths: DataFrame | None) -> DataFrame:
    """``(id, x, y, t, px, py)``: each trajectory's records in any order, and its path's points, as arrays; points: (id, x, y, t), paths: (id, points)."""
    number = lambda c, f: F.transform(c, lambda p: p[f].cast("double"))
    side = points.groupBy("id").agg(F.collect_list(F.struct("x", "y", "t")).alias("r")).select("id", *(number("r", f).alias(f) for f in ("x", "y", "t")))
    if paths is None:
        return side.select("*", *(F.lit(None).cast("array<double>").alias(f) for f in ("px", "py")))
    return side.join(paths.select("id", number("points", "x").alias("px"), number("points", "y").alias("py")), "id", "full")


def _lists(table: pa.Table, names: tuple[str, ...]) -> Paths:
    """How many entries each row has, and those of columns of equally long lists; a null has none, and is NaN as an entry."""
    columns = [table.column(n).combine_chunks() for n in names]
    n = columns[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return n, *(c.flatten().to_numpy(zero_copy_only=False) for c in columns)


class _Records:
    """A trajectory's distinct places with the number of records at each, and its times."""

    def __init__(self, x: np.ndarray, y: np.ndarray, t: np.ndarray) -> None:
        px, py, which = places(x, y)
        self.n, self.places, self.times = len(x), (np.bincount(which, minlength=len(px)), px, py), np.sort(t[~np.isnan(t)])


def _stlc(a: _Records, b: _Records, gamma: float) -> float:
    if not a.n or not b.n:
        return np.nan
    (s, s2), d, d2 = similarity_in_space(a.places, b.places), similarity_in_time(a.times, b.times), similarity_in_time(b.times, a.times)
    return 1 - (gamma * (s / a.n + s2 / b.n) + (1 - gamma) * (d / a.n + d2 / b.n)) / 2


def _compare(pairs: DataFrame, key: str, points: DataFrame, true_points: DataFrame, gamma: float, epsilon: float, paths: DataFrame | None = None, true_paths: DataFrame | None = None) -> DataFrame:
    """``(key, lcss, edr, stlc)`` for each of ``pairs`` (key, id, true_id); null where a side has no records, or no path of two points.

    A trajectory may be long and the best of many vehicles: the pairs that share it
    are dealt into parts of about PAIRS pairs and POINTS points, and a part gets it once.
    """
    known = materialize(pairs.select(key, "id", "true_id"), "pairs")
    size = true_points.groupBy("id").agg(F.count("*").alias("size"))
    if true_paths is not None:
        size = size.union(true_paths.select("id", F.size("points").cast("long"))).groupBy("id").agg(F.sum("size").alias("size"))
    load = known.join(size.withColumnRenamed("id", "true_id"), "true_id", "left").groupBy("id").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = load.select("id", F.ceil(F.greatest(F.lit(1), F.col("n") / PAIRS, F.col("size") / POINTS)).alias("parts"))
    one = _side(points, paths).join(parts, "id").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
    many = known.join(_side(true_points, true_paths).withColumnRenamed("id", "true_id"), "true_id").join(parts, "id")
    many = many.withColumn("part", F.pmod(F.xxhash64("true_id", key), "parts")).select(key, "id", "part", "x", "y", "t", "px", "py")

    def run(one: pa.Table, many: pa.Table) -> pa.Table:
        lcss = edr = stlc = np.full(many.num_rows, np.nan)
        if one.num_rows and many.num_rows:
            # a path of one point is none
            n, x, y = _lists(one, ("px", "py"))
            paths = _lists(many, ("px", "py"))
            lcss, edr = (np.where(paths[0] > 1, d, np.nan) for d in against_one(x, y, paths, epsilon)) if n[0] > 1 else (lcss, edr)
            own = _Records(*_lists(one, ("x", "y", "t"))[1:])
            n, *others = _lists(many, ("x", "y", "t"))
            end = np.cumsum(n)
            stlc = np.array([_stlc(own, _Records(*(v[i:j] for v in others)), gamma) for i, j in zip((end - n).tolist(), end.tolist(), strict=True)])
        return pa.table({key: many.column(key)} | {k: pa.array(v, mask=np.isnan(v)) for k, v in (("lcss", lcss), ("edr", edr), ("stlc", stlc))})

    kind = f"{key} {known.schema[key].dataType.simpleString()}, lcss double, edr double, stlc double"
    return one.groupBy("id", "part").cogroup(many.groupBy("id", "part")).applyInArrow(run, kind)


def stlc(pairs: DataFrame, points: DataFrame, true_points: DataFrame, gamma: float = GAMMA) -> DataFrame:
    """``(pair_id, stlc)``: spatio-temporal distance of each pair (pair_id, id, true_id) of trajectories (id, x, y, t).

    The nearest point of the other trajectory in space, and in time, for every
    point, then means of exp(-distance). A pair with an empty side has no row; a
    point without a place or time is near to none.
    """
    return _compare(pairs, "pair_id", points, true_points, gamma, EPSILON).where("stlc IS NOT NULL").select("pair_id", "stlc")


def path_distances(pairs: DataFrame, path: str, true_path: str, epsilon: float = EPSILON) -> DataFrame:
    """``pairs`` with valid paths of points, array<struct<x, y>>, and their ``lcss`` and ``edr``."""
    valid = pairs.where(is_valid_path(F.col(path)) & is_valid_path(F.col(true_path)))
    return valid.withColumn("lcss", lcss_distance(F.col(path), F.col(true_path), epsilon)).withColumn("edr", edr_distance(F.col(path), F.col(true_path), epsilon))


def points_along(paths: DataFrame, nodes: DataFrame, key: str, path: str) -> DataFrame:
    """``(key, points)``: node paths as points, by one join on the node."""
    steps = paths.select(key, F.posexplode(path).alias("i", "node_id")).join(nodes.select("node_id", "x", "y"), "node_id")
    ordered = F.sort_array(F.collect_list(F.struct("i", "x", "y")))
    return steps.groupBy(key).agg(F.transform(ordered, lambda p: F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y"))).alias("points"))


def _trajectories(members: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """Points ``(id, x, y, t)`` of records (key, node_id, time)."""
    return members.select(F.col(key).alias("id"), "node_id", F.col("time").alias("t")).join(nodes.select("node_id", "x", "y"), "node_id").select("id", "x", "y", "t")


def _distances(pairs: DataFrame, points: DataFrame, true_points: DataFrame, paths: DataFrame, true_paths: DataFrame, nodes: DataFrame, gamma: float, epsilon: float) -> DataFrame:
    """One row: averages of the three distances over ``pairs`` (id, true_id), each over those that have it; null where none has. paths: (id, node_path)."""
    along, true_along = (points_along(p.where(is_valid_path(F.col("node_path"))), nodes, "id", "node_path") for p in (paths, true_paths))
    # vehicles of equal clusters have equal distances
    each = _compare(pairs.groupBy("id", "true_id").agg(F.count("*").alias("n")), "n", points, true_points, gamma, epsilon, along, true_along)
    return each.agg(*((F.sum(F.col(c) * F.col("n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("n")))).alias(c) for c in ("lcss", "edr", "stlc")))


def trajectories_against_records(members: DataFrame, paths: DataFrame, truth: DataFrame, nodes: DataFrame, edges: DataFrame, gamma: float = GAMMA, epsilon: float = EPSILON) -> DataFrame:
    """``(lcss, edr, stlc)``: averages over vehicles of the distances between their records and those of their best cluster.

    members: (cluster_id, record_id, node_id, time); paths: (cluster_id, node_path);
    truth: (record_id, vehicle_id, node_id, time), vehicle_id null for records without
    annotation; nodes: (node_id, x, y) in metres; edges: (u, v, length). A vehicle's
    own path is matched from its records. Vehicles in no cluster, and for the path
    distances those with a path missing, do not count.
    """
    known = truth.where("vehicle_id IS NOT NULL")
    best_of = best_clusters(members.select("cluster_id", "record_id"), known.select("record_id", "vehicle_id")).where("cluster_id IS NOT NULL")
    pairs = best_of.select(F.col("cluster_id").alias("id"), F.col("vehicle_id").alias("true_id"))
    ordered = F.sort_array(F.collect_list(F.struct("time", "record_id", "node_id")))
    traces = known.groupBy("vehicle_id").agg(F.transform(ordered, lambda r: r["node_id"]).alias("trace"))
    true_paths = map_match(traces, edges).select(F.col("vehicle_id").alias("id"), "node_path")
    return _distances(pairs, _trajectories(members, nodes, "cluster_id"), _trajectories(known, nodes, "vehicle_id"), paths.select(F.col("cluster_id").alias("id"), "node_path"), true_paths, nodes, gamma, epsilon)


def trajectories_against_clusters(members: DataFrame, paths: DataFrame, true_members: DataFrame, true_paths: DataFrame, vehicles: DataFrame, truth: DataFrame, nodes: DataFrame, gamma: float = GAMMA, epsilon: float = EPSILON) -> DataFrame:
    """The same against clusters taken as the truth, over the ids in ``vehicles``: each vehicle's best true cluster and best cluster.

    true_members and true_paths as members and paths; truth: (record_id, vehicle_id).
    """
    known = truth.select("record_id", "vehicle_id")
    c = best_clusters(members.select("cluster_id", "record_id"), known).select("vehicle_id", F.col("cluster_id").alias("id"))
    t = best_clusters(true_members.select("cluster_id", "record_id"), known).select("vehicle_id", F.col("cluster_id").alias("true_id"))
    pairs = vehicles.select("vehicle_id").distinct().join(c, "vehicle_id").join(t, "vehicle_id").where("id IS NOT NULL AND true_id IS NOT NULL").select("id", "true_id")
    own, true = (p.select(F.col("cluster_id").alias("id"), "node_path") for p in (paths, true_paths))
    return _distances(pairs, _trajectories(members, nodes, "cluster_id"), _trajectories(true_members, nodes, "cluster_id"), own, true, nodes, gamma, epsilon)
