"""The road graph: nodes (node_id, x, y) and edges (u, v, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.storage import materialize


def without_self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("u <> v")


def with_travel_time(edges: DataFrame, length: str, speed: str, road_class: str) -> DataFrame:
    """Missing speeds from the mean of the road class, or of all; ``travel_time`` = length / speed."""
    each = edges.groupBy(F.col(road_class).alias("_class")).agg(F.avg(speed).alias("_mean"), F.sum(speed).alias("_sum"), F.count(speed).alias("_n"))
    total, n = each.agg(F.sum("_sum"), F.sum("_n")).first()
    overall = F.lit(total / n if n else None).cast("double")
    filled = F.coalesce(F.col(speed), F.col("_mean"), overall)
    out = edges.join(each.select("_class", "_mean"), F.col(road_class).eqNullSafe(F.col("_class")), "left")
    return out.withColumn("speed_used", filled).withColumn("travel_time", F.col(length) / F.col("speed_used")).drop("_class", "_mean")


def with_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges without a geometry get the straight line between their ends."""
    p = nodes.select(F.col("node_id").alias("u"), F.struct("x", "y").alias("_p"))
    q = nodes.select(F.col("node_id").alias("v"), F.struct("x", "y").alias("_q"))
    return edges.join(p, "u").join(q, "v").withColumn("geometry", F.coalesce("geometry", F.array("_p", "_q"))).drop("_p", "_q")


def hops(edges: DataFrame, starts: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """``(key, node, hop)``: the least number of edges, up to ``most``, from any start (key, node) of each key.

    Breadth first, a join a round; each round's frontier is written, so that lineage stays short.
    """
    links = edges.select("u", "v")
    if not directed:
        links = links.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    links = links.where("u <> v").distinct()
    seen = materialize(starts.select("key", "node").distinct().withColumn("hop", F.lit(0)), "hops")
    frontier = seen
    for hop in range(1, most + 1):
        step = frontier.join(links, F.col("node") == F.col("u")).select("key", F.col("v").alias("node")).distinct()
        fresh = materialize(step.join(seen.select("key", "node"), ["key", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hops")
        if fresh.isEmpty():
            break
        seen, frontier = seen.union(fresh), fresh
    return seen


def largest_scc(edges: DataFrame) -> DataFrame:
    """``node``: the nodes of the largest strongly connected component; of several, that with the smallest node.

    Forward and backward colouring: every node takes the smallest node that can
    reach it; within a colour, what reaches the colour's root backwards is one
    component. Components found leave the graph, and the rest goes on.
    """
    links = materialize(edges.select("u", "v").where("u <> v").distinct(), "links")
    left = materialize(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct(), "nodes")
    found = None
    while not left.isEmpty():
        colour = materialize(left.withColumn("root", F.col("node")), "colours")
        while True:
            told = links.join(colour, F.col("u") == F.col("node")).select(F.col("v").alias("node"), "root")
            new = materialize(colour.union(told).groupBy("node").agg(F.min("root").alias("root")), "colours")
            if new.join(colour, ["node", "root"], "left_anti").isEmpty():
                break
            colour = new
        same = links.join(colour.toDF("u", "r"), "u").join(colour.toDF("v", "s"), "v").where("r = s").select("u", "v", "r")
        same = materialize(same, "same")
        reach = materialize(colour.where("node = root"), "reach")
        frontier = reach
        while True:
            step = frontier.join(same, (F.col("node") == F.col("v")) & (F.col("root") == F.col("r"))).select(F.col("u").alias("node"), "root").distinct()
            fresh = materialize(step.join(reach, ["node", "root"], "left_anti"), "reach")
            if fresh.isEmpty():
                break
            reach, frontier = materialize(reach.union(fresh), "reach"), fresh
        found = reach if found is None else found.union(reach)
        left = materialize(left.join(reach, "node", "left_anti"), "nodes")
        links = materialize(links.join(reach.select(F.col("node").alias("u")), "u", "left_anti").join(reach.select(F.col("node").alias("v")), "v", "left_anti"), "links")
    sizes = found.groupBy("root").agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), "root").limit(1).select("root")
    return found.join(F.broadcast(top), "root").select("node")


def border_edges(edges: DataFrame, region_nodes: DataFrame) -> DataFrame:
    """``(region, direction, u, v)`` of edges between two main regions i < j: one join for all pairs of regions."""
    of = region_nodes.select("region", "node_id")
    r = edges.select("u", "v").distinct().join(of.select(F.col("node_id").alias("u"), F.col("region").alias("ru")), "u").join(of.select(F.col("node_id").alias("v"), F.col("region").alias("rv")), "v").where("ru <> rv")
    name = F.concat_ws("-", F.least("ru", "rv").cast("string"), F.greatest("ru", "rv").cast("string"))
    direction = F.when(F.col("ru") < F.col("rv"), "i_to_j").otherwise("j_to_i")
    return r.select(name.alias("region"), direction.alias("direction"), "u", "v")


def auxiliary_regions(borders: DataFrame) -> DataFrame:
    """``(region, node_id)``: the ends of the border edges of each pair of regions."""
    return borders.select("region", F.explode(F.array("u", "v")).alias("node_id")).distinct()


def expand_auxiliary(edges: DataFrame, aux_nodes: DataFrame, cameras: DataFrame, least_cameras: int, low: int = 1, high: int = 10) -> DataFrame:
    """``(region, cutoff, node_id)``: each auxiliary region grown by the smallest cutoff in low..high with enough cameras; others are dropped.

    One breadth-first search to ``high`` serves all cutoffs.
    """
    reach = materialize(hops(edges, aux_nodes.select(F.col("region").alias("key"), F.col("node_id").alias("node")), high), "reach")
    held = reach.join(cameras.select("camera_id", F.col("node_id").alias("node")), "node").groupBy("key", "hop").agg(F.count("*").alias("n"))
    cut = held.sparkSession.range(low, high + 1).select(F.col("id").cast("int").alias("cutoff"))
    total = held.crossJoin(F.broadcast(cut)).where("hop <= cutoff").groupBy("key", "cutoff").agg(F.sum("n").alias("n"))
    chosen = total.where(F.col("n") >= least_cameras).groupBy("key").agg(F.min("cutoff").alias("cutoff"))
    return reach.join(chosen, "key").where("hop <= cutoff").select(F.col("key").alias("region"), "cutoff", F.col("node").alias("node_id"))


def nearest(points: DataFrame, sites: DataFrame, cell: float) -> DataFrame:
    """``(point_id, site_id, distance)``: the nearest site (site_id, x, y) of each point (point_id, x, y), ties to the smaller id.

    Sites are hashed into square cells; a point looks into its own cell and the eight
    around it. Points that can't be sure of their nearest site then go on with cells
    of twice the width, so a far point asks nine cells a round, and rounds grow with
    the logarithm of its distance.
    """
    grid = materialize(sites.select("site_id", F.col("x").alias("sx"), F.col("y").alias("sy"), F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")), "sites")
    left = materialize(points.select("point_id", "x", "y", F.floor(F.col("x") / cell).alias("px"), F.floor(F.col("y") / cell).alias("py")), "points")
    best, ring = None, 1
    span = grid.agg(F.max("cx") - F.min("cx"), F.max("cy") - F.min("cy"), F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
    if span[0] is None:
        return left.select("point_id", F.lit(None).cast("long").alias("site_id"), F.lit(None).cast("double").alias("distance")).limit(0)
    while not left.isEmpty():
        wide = lambda c: F.floor(F.col(c) / ring)  # noqa: B023, E731
        beside = lambda c: F.explode(F.sequence(wide(c) - 1, wide(c) + 1))  # noqa: B023, E731
        around = left.withColumn("cx", beside("px")).withColumn("cy", beside("py"))
        d = F.sqrt(F.pow(F.col("x") - F.col("sx"), F.lit(2)) + F.pow(F.col("y") - F.col("sy"), F.lit(2)))
        hit = around.join(grid.withColumn("cx", wide("cx")).withColumn("cy", wide("cy")), ["cx", "cy"]).withColumn("d", d).groupBy("point_id").agg(F.min(F.struct("d", "site_id")).alias("m"))
        hit = materialize(hit.where(F.col("m.d") <= ring * cell).select("point_id", F.col("m.site_id").alias("site_id"), F.col("m.d").alias("distance")), "nearest")
        best = hit if best is None else best.union(hit)
        left = materialize(left.join(hit, "point_id", "left_anti"), "points")
        ring *= 2
    return best


def simplify(edges: DataFrame) -> DataFrame:
    """Edges (u, v, length) with chains contracted: nodes that only pass traffic on between two neighbours go.

    A directed edge whose head is such a node continues in the one edge that
    leads on; continuations are followed by pointer doubling, so a chain of n
    edges takes log n joins. Rings without any other node stay as they are.
    Parallel edges and self loops count as one neighbour and are kept.
    """
    one = edges.groupBy("u", "v").agg(F.min("length").alias("length"))
    ends = one.where("u <> v")
    near = ends.select(F.col("u").alias("n"), F.col("v").alias("o")).union(ends.select("v", "u"))
    neighbours = near.distinct().groupBy("n").agg(F.count("*").alias("k"))
    degree = near.groupBy("n").agg(F.count("*").alias("d"))
    out = ends.groupBy(F.col("u").alias("n")).agg(F.count("*").alias("out"))
    loops = one.where("u = v").select(F.col("u").alias("n"))
    passing = neighbours.join(degree, "n").join(out, "n").where("k = 2 AND (d = 2 AND out = 1 OR d = 4 AND out = 2)").join(loops, "n", "left_anti").select("n")
    passing = materialize(passing, "passing")
    step = ends.join(passing, F.col("v") == F.col("n")).select("u", "v").join(ends.select(F.col("u").alias("v"), F.col("v").alias("w")), "v").where("w <> u")
    state = ends.join(step, ["u", "v"], "left").select("u", "v", "length", F.col("u").alias("a"), F.col("v").alias("b"), F.col("w").alias("w"))
    # (u, v): a chain's first edge; (a, b): its last so far; (b, w): the edge to go on with
    state = materialize(state, "chains")
    rounds = max(1, state.count().bit_length())
    for _ in range(rounds):
        more = state.select(F.col("u").alias("b"), F.col("v").alias("w"), F.col("length").alias("l2"), F.col("a").alias("a2"), F.col("b").alias("b2"), F.col("w").alias("w2"))
        joined = state.join(more, ["b", "w"], "left")
        on = F.col("l2").isNotNull()
        state = materialize(joined.select("u", "v", F.when(on, F.col("length") + F.col("l2")).otherwise(F.col("length")).alias("length"), F.when(on, F.col("a2")).otherwise(F.col("a")).alias("a"), F.when(on, F.col("b2")).otherwise(F.col("b")).alias("b"), F.when(on, F.col("w2")).alias("w")), "chains")
        if state.where("w IS NOT NULL").isEmpty():
            break
    whole = state.where("w IS NULL").join(passing.select(F.col("n").alias("u")), "u", "left_anti").select("u", F.col("b").alias("v"), "length")
    # edges of rings never end: all that do not start at another node and were not passed through
    ring = state.where("w IS NOT NULL").select("u", "v")
    return whole.union(one.where("u = v").select("u", "v", "length")).union(ends.join(ring, ["u", "v"], "left_semi").select("u", "v", "length"))
