"""Map matching: node paths through the road graph, for traces of nodes and of free points.

Cameras stand on nodes, so a trace is a sequence of nodes already; its path joins
the shortest paths between consecutive distinct ones. A trace with a leg that
cannot be driven has no path.

Traces of points, which may lie off the network, are matched by a longest common
subsequence: the shortest path between the nodes nearest to a trace's ends is
scored by the share of points that it passes, in order, within a distance; a trace
whose path scores too low is split at the point farthest from it, its parts are
matched apart, and the joined path is taken if it scores higher.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Edges of a graph that is broadcast; a larger one is refused.
MOST_EDGES = 5_000_000


def shortest_path(ways: dict[int, list[tuple[int, float]]], start: int, goal: int) -> list[int] | None:
    """Nodes of the shortest path, of equal ones that through smaller nodes; None if there is none."""
    done: dict[int, int | None] = {}
    queue = [(0.0, start, None)]
    while queue:
        far, node, came = heapq.heappop(queue)
        if node in done:
            continue
        done[node] = came
        if node == goal:
            path = [node]
            while (came := done[path[-1]]) is not None:
                path.append(came)
            return path[::-1]
        for after, length in ways.get(node, ()):
            if after not in done:
                heapq.heappush(queue, (far + length, after, node))
    return None


def match(ways: dict[int, list[tuple[int, float]]], trace: list[int], known: dict) -> list[int] | None:
    path: list[int] = []
    for node in trace:
        if not path:
            path.append(node)
        elif path[-1] != node:
            leg = (path[-1], node)
            if leg not in known:
                known[leg] = shortest_path(ways, *leg)
            if known[leg] is None:
                return None
            path += known[leg][1:]
    return path or None


def _ways(edges: DataFrame) -> dict[int, list[tuple[int, float]]]:
    n = edges.count()
    if n > MOST_EDGES:
        raise ValueError(f"a graph of {n} edges is too large to broadcast; match its regions one by one")
    ways: dict[int, list[tuple[int, float]]] = {}
    for r in edges.groupBy("u", "v").agg(F.min("length").alias("length")).orderBy("u", "v").toLocalIterator():
        ways.setdefault(r["u"], []).append((r["v"], r["length"]))
    return ways


def to_segments(points: np.ndarray, path: np.ndarray) -> np.ndarray:
    """Distances of points (rows) to the segments of a path of places (columns); a path of one place is one segment."""
    a, b = (path[:-1], path[1:]) if len(path) > 1 else (path, path)
    way = b - a
    size = np.maximum((way * way).sum(1), 1e-12)
    along = np.clip(((points[:, None] - a) * way).sum(2) / size, 0, 1)
    return np.sqrt(((points[:, None] - a - along[:, :, None] * way) ** 2).sum(2))


def common_share(near: np.ndarray) -> float:
    """The longest common subsequence of points and segments, as a share of the points; a segment may pass several."""
    best = np.zeros(near.shape[1] + 1, np.int64)
    for row in near:
        best[1:] = np.maximum(best[1:], best[1:] + row)
        best = np.maximum.accumulate(best)
    return float(best[-1]) / len(near)


class PointMatcher:
    """Matches traces of points to a graph: ways out of each node, and the places of nodes."""

    def __init__(self, ways: dict[int, list[tuple[int, float]]], places: dict[int, tuple[float, float]], distance: float, share: float) -> None:
        self.ways, self.places, self.distance, self.share = ways, places, distance, share
        self.ids = np.array(sorted(places), np.int64)
        self.xy = np.array([places[i] for i in self.ids.tolist()], float).reshape(-1, 2)
        self.known: dict = {}

    def nearest(self, point: np.ndarray) -> int:
        return int(self.ids[((self.xy - point) ** 2).sum(1).argmin()])

    def leg(self, a: int, b: int) -> list[int] | None:
        if (a, b) not in self.known:
            self.known[a, b] = shortest_path(self.ways, a, b)
        return self.known[a, b]

    def score(self, points: np.ndarray, path: list[int]) -> tuple[float, int]:
        far = to_segments(points, np.array([self.places[n] for n in path], float))
        return common_share(far <= self.distance), int(far.min(1).argmax())

    def match(self, points: np.ndarray) -> list[int] | None:
        """The path of a trace; None if its ends are not joined."""
        if not len(points):
            return None
        path = self.leg(self.nearest(points[0]), self.nearest(points[-1]))
        if path is None:
            return None
        # pieces are split until they score the share or have two points; a stack, as traces may be long
        done, todo = [], [(0, len(points), path)]
        while todo:
            begin, end, way = todo.pop()
            share, worst = self.score(points[begin:end], way)
            middle = begin + worst
            if share < self.share and begin < middle < end - 1:
                node = self.nearest(points[middle])
                first, second = self.leg(way[0], node), self.leg(node, way[-1])
                if first is not None and second is not None:
                    joined = first + second[1:]
                    if self.score(points[begin:end], joined)[0] > share:
                        todo += [(middle, end, second), (begin, middle + 1, first)]
                        continue
            done.append(way)
        out = list(done[0])
        for way in done[1:]:
            out += way[1:] if out[-1] == way[0] else way
        return out


def match_points(traces: DataFrame, edges: DataFrame, nodes: DataFrame, trace: str = "trace", distance: float = 50.0, share: float = 0.9) -> DataFrame:
    """``traces`` with ``node_path`` for traces of points, array<struct<x, y>>, that need not lie on the network.

    edges: (u, v, length); nodes: (node_id, x, y) in the unit of ``distance``, within
    which a path passes a point; share: of the points that a path must pass not to
    be split. A null or empty trace, and one whose ends are not joined, has no path.
    """
    graph = _ways(edges)
    places = {r["node_id"]: (r["x"], r["y"]) for r in nodes.select("node_id", "x", "y").limit(2 * MOST_EDGES + 1).toLocalIterator()}
    if len(places) > 2 * MOST_EDGES:
        raise ValueError("a graph of so many nodes is too large to broadcast; match its regions one by one")
    shared = traces.sparkSession.sparkContext.broadcast((graph, places))

    @F.pandas_udf("array<long>")
    def path(column: pd.Series) -> pd.Series:
        matcher = PointMatcher(*shared.value, distance, share)
        return column.map(lambda t: None if t is None else matcher.match(np.array([(p["x"], p["y"]) for p in t], float).reshape(-1, 2)))

    return traces.withColumn("node_path", path(trace))


def map_match(traces: DataFrame, edges: DataFrame, trace: str = "trace") -> DataFrame:
    """``traces`` with ``node_path``; null where there is none. edges: (u, v, length).

    The graph is broadcast: a city's road network has a bound, MOST_EDGES, that is
    checked first. Each task remembers the legs it has found.
    """
    shared = traces.sparkSession.sparkContext.broadcast(_ways(edges))

    @F.pandas_udf("array<long>")
    def path(column: pd.Series) -> pd.Series:
        known: dict = {}
        return column.map(lambda t: None if t is None else match(shared.value, list(t), known))

    return traces.withColumn("node_path", path(trace))
