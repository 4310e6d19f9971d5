import base64
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.operators import aggregates, clustering, components, datasets, evaluation, graph, knn, mapmatching, merging
from waymark.operators.components import connected_components
from waymark.sources import records as sources
from waymark.sources import wire


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_components(spark):
    # sizes 2, 4, 4, an isolated loop, a repeated and a null edge
    e = spark.createDataFrame([(9, 8), (1, 2), (2, 3), (4, 3), (20, 21), (21, 22), (23, 20), (5, 5), (1, 2), (None, 7)], "a long, b long")
    of = dict(rows(connected_components(e, "a", "b")))
    assert of == {8: 8, 9: 8, 1: 1, 2: 1, 3: 1, 4: 1, 20: 20, 21: 20, 22: 20, 23: 20, 5: 5}
    assert rows(connected_components(e.limit(0), "a", "b")) == []


def test_components_of_a_long_chain_and_a_star(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 300).select(F.lit(5000).cast("long").alias("a"), (F.col("id") + 5000).alias("b"))
    of = connected_components(chain.union(star), "a", "b").groupBy("component").count()
    assert rows(of) == [(0, 201), (5000, 300)]


def test_rounds_of_a_small_graph_are_not_spread_over_all_partitions(spark, monkeypatch):
    files = []

    class Counted(components.Written):
        def __init__(self, df, name):
            super().__init__(df, name)
            files.append(len(self.df.inputFiles()))

    monkeypatch.setattr(components, "Written", Counted)
    held = {"spark.sql.shuffle.partitions": "16", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        assert {r[1] for r in rows(connected_components(chain, "a", "b"))} == {0}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    # the first two are the edges as they come and the self loops
    assert files[2:] and set(files[2:]) == {1}


def test_knn_includes_self_and_breaks_ties(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None)], "id long, feature array<double>")
    got = rows(knn.knn_join(v, v, 2).select("id", "neighbor", "rank"))
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 1), (2, 2, 2), (3, 1, 2), (3, 3, 1)]


def test_knn_within_a_column(spark):
    v = spark.createDataFrame([("a", 1, [1.0, 0.0]), ("a", 2, [0.0, 1.0]), ("b", 1, [1.0, 0.0]), ("b", 3, [1.0, 0.1])], "region string, id long, feature array<double>")
    got = rows(knn.knn_join(v, v, 9, by="region").select("g", "id", "neighbor"))
    assert got == [("a", 1, 1), ("a", 1, 2), ("a", 2, 1), ("a", 2, 2), ("b", 1, 1), ("b", 1, 3), ("b", 3, 1), ("b", 3, 3)]


def test_similar_pairs_in_several_blocks(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, feature array<double>")
    one = rows(knn.similar_pairs(v, 0.5).select("a", "b"))
    monkeypatch.setattr(knn, "BLOCK", 7)
    monkeypatch.setattr(knn, "BASE_BLOCK", 9)
    assert rows(knn.similar_pairs(v, 0.5).select("a", "b")) == one
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert one == [(i, j) for i in range(60) for j in range(i + 1, 60) if u[i] @ u[j] > 0.5]


def test_majority_ties(spark):
    t = spark.createDataFrame([(1, "b", 5), (1, "a", 7), (2, "x", 1), (2, "y", 2), (2, "y", 3), (3, None, 1)], "k int, v string, t int")
    assert rows(aggregates.majority(t, ["k"], "v", ["t"])) == [(1, "b", 1), (2, "y", 2)]
    assert rows(aggregates.majority(t, ["k"], "v")) == [(1, "a", 1), (2, "y", 2)]


def test_histogram_closes_the_last_bin(spark):
    t = spark.createDataFrame([(0.0,), (12.0,), (11.9,), (5.5,), (-1.0,), (12.1,)], "v double")
    got = dict(rows(aggregates.histogram(t, F.col("v"), 0, 12)))
    assert {k: n for k, n in got.items() if n} == {1: 1, 6: 1, 12: 2}
    assert len(got) == 12


def test_sorting_and_subsets(spark):
    t = spark.createDataFrame([(0, 5), (1, 5), (2, 3), (3, 9)], "line long, time long")
    assert rows(datasets.out_of_order(t, "time", "line")) == [(1,)]
    assert [r["line"] for r in datasets.sort_by_time(t, "time", "line").collect()] == [2, 0, 1, 3]
    assert rows(datasets.subset(t, F.col("line") == 3, 2, ["time", "line"]).select("line")) == [(0,), (2,), (3,)]
    assert [r["line_no"] for r in datasets.numbered(t).collect()] == [0, 1, 2, 3]


@pytest.fixture(scope="module")
def regions(spark):
    nodes = spark.createDataFrame([(i, 0 if i < 4 else 1) for i in range(8)], "node_id long, region long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6), (6, 7), (5, 2), (1, 1)], "u long, v long")
    return nodes, edges


def test_borders_and_expansion(spark, regions):
    nodes, edges = regions
    borders = graph.border_edges(edges, nodes)
    assert rows(borders) == [("0-1", "i_to_j", 3, 4), ("0-1", "j_to_i", 5, 2)]
    aux = graph.auxiliary_regions(borders)
    assert rows(aux) == [("0-1", n) for n in (2, 3, 4, 5)]
    cams = spark.createDataFrame([(10, 1), (11, 6), (12, 3)], "camera_id long, node_id long")
    grown = graph.expand_auxiliary(edges, aux, cams, 3, 1, 4)
    assert rows(grown) == [("0-1", 1, n) for n in range(1, 7)]
    assert rows(graph.expand_auxiliary(edges, aux, cams, 4, 1, 4)) == []


def test_largest_scc(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (9, 7)], "u long, v long")
    assert rows(graph.largest_scc(e)) == [(1,), (2,), (3,)]


def test_nearest(spark):
    sites = spark.createDataFrame([(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 0.0, 0.0)], "site_id long, x double, y double")
    points = spark.createDataFrame([(1, 1.0, 0.0), (2, 9.0, 1.0), (3, 400.0, 0.0)], "point_id long, x double, y double")
    got = rows(graph.nearest(points, sites, 2.0))
    assert [(p, s) for p, s, _ in got] == [(1, 1), (2, 2), (3, 2)]
    assert rows(graph.nearest(points, sites.limit(0), 2.0)) == []


def test_map_match(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (3, 1, 1.0)], "u long, v long, length double")
    t = spark.createDataFrame([(1, [1, 3]), (2, [3, 3, 2]), (3, [1, 9]), (4, [2]), (5, None), (6, [])], "id long, trace array<long>")
    got = {r["id"]: r["node_path"] for r in mapmatching.map_match(t, e).collect()}
    assert got == {1: [1, 2, 3], 2: [3, 1, 2], 3: None, 4: [2], 5: None, 6: None}


def camera_records(spark):
    v = {1: [1.0, 0.0], 2: [0.99, 0.1], 3: [0.0, 1.0], 4: [0.05, 1.0], 5: [1.0, 0.02]}
    plate = {1: [1.0, 1.0], 2: [1.0, 0.9], 3: None, 4: [0.2, 1.0], 5: [-1.0, 1.0]}
    data = [("0", i, i, i, -i if i == 5 else i, v[i], plate[i], None if plate[i] is None else ("XY1" if i < 3 else "ZZ9")) for i in v] + [("0", 6, 6, 6, 9, None, None, None)]
    return spark.createDataFrame(data, "region string, record_id long, vehicle_id long, camera_id long, time long, vehicle_feature array<double>, plate_feature array<double>, plate_text string")


def test_greedy_clustering(spark):
    got = {r["record_id"]: r["cluster_id"] for r in clustering.cluster_records(camera_records(spark), 129, 0.85).collect()}
    # 5 comes first; 1 has the same vehicle but another plate, so it founds a cluster that 2 joins; 6 has no feature
    assert got == {5: 5, 1: 1, 2: 1, 3: 3, 4: 3, 6: 6}


def test_running_centroid_matches_the_aggregate(spark):
    assigned = clustering.cluster_records(camera_records(spark), 129, 0.85)
    c = {r["cluster_id"]: r for r in clustering.summarize(assigned).collect()}
    state = clustering.Cluster(1)
    for x in ([1.0, 0.0], [0.99, 0.1]):
        state.add(clustering._unit(x), None, None)
    assert c[1]["centroid_vehicle"] == pytest.approx(state.vehicle.tolist())
    assert c[1]["plate_text"] == "XY1"
    assert c[3]["n"] == 2
    assert c[6]["centroid_vehicle"] is None


def test_matching_and_merging(spark, regions):
    nodes, edges = regions
    borders = graph.border_edges(edges, nodes)
    aux_nodes = graph.auxiliary_regions(borders)
    all_nodes = nodes.select(F.col("region").cast("string").alias("region"), "node_id").union(aux_nodes)
    schema = "region string, cluster_id long, record_id string, node_id long"
    aux = spark.createDataFrame([("0-1", 100, "r2", 2), ("0-1", 100, "r3", 3), ("0-1", 100, "r4", 4)], schema)
    main = spark.createDataFrame([("0", 1, "r1", 1), ("0", 1, "r2", 2), ("0", 1, "r3", 3), ("1", 2, "r4", 4), ("1", 3, "r6", 6)], schema)
    paths = spark.createDataFrame([(100, [2, 3, 4])], "cluster_id long, node_path array<long>")
    pairs = merging.match_across(aux, main, paths, borders, all_nodes)
    assert rows(pairs) == [(100, 1), (100, 2)]
    clusters = spark.createDataFrame([(1, [1.0, 0.0], None, "A"), (2, [0.0, 1.0], [1.0, 1.0], "B"), (3, [5.0, 5.0], None, None), (100, [1.0, 1.0], [3.0, 1.0], "B")], "cluster_id long, centroid_vehicle array<double>, centroid_plate array<double>, plate_text string")
    merged, members = merging.merge(clusters, main.union(aux), pairs)
    one = {r["cluster_id"]: r for r in merged.collect()}
    assert set(one) == {1, 3}
    assert one[1]["centroid_vehicle"] == pytest.approx([2 / 3, 2 / 3])
    assert one[1]["centroid_plate"] == pytest.approx([2.0, 1.0])
    assert one[1]["plate_text"] == "B"
    assert rows(members.where("cluster_id = 1").select("record_id")) == [("r1",), ("r2",), ("r3",), ("r4",)]
    untouched, _ = merging.merge(clusters, main, pairs.limit(0))
    assert untouched.count() == 4


def test_spanning_forest():
    rng = np.random.default_rng(1)
    for _ in range(30):
        a, b = rng.integers(0, 30, 40), rng.integers(0, 30, 40)
        a, b = a[a != b], b[a != b]
        some = knn._forest(a, b)

        def parts(x, y):
            of = {i: i for i in [*a, *b]}

            def root(i):
                while of[i] != i:
                    i = of[i]
                return i

            for u, v in zip(x, y, strict=True):
                of[root(u)] = root(v)
            return {frozenset(i for i in of if root(i) == r) for r in map(root, of)}

        assert parts(a[some], b[some]) == parts(a, b)
        assert len(some) == sum(len(p) - 1 for p in parts(a, b))


def test_lists_of_many_equal_vectors(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0] if i < 40 else [0.0, 1.0], i % 2) for i in range(60)], "id long, feature array<double>, part int")
    got = {r["id"]: r["neighbors"] for r in knn.knn_lists(df, df, 5).collect()}
    assert got == {i: ([0, 1, 2, 3, 4] if i < 40 else [40, 41, 42, 43, 44]) for i in range(60)}
    by = {r["id"]: r["neighbors"] for r in knn.knn_lists(df, df, 3, by="part").collect()}
    assert by == {i: [(0 if i < 40 else 40) + i % 2 + 2 * k for k in range(3)] for i in range(60)}


def test_rough_search_restricts_the_pairs(spark, regions):
    """The right cluster is matched where its centroid is among the nearest, and not where another's is nearer."""
    nodes, edges = regions
    borders = graph.border_edges(edges, nodes)
    all_nodes = nodes.select(F.col("region").cast("string").alias("region"), "node_id").union(graph.auxiliary_regions(borders))
    schema = "region string, cluster_id long, record_id string, node_id long"
    aux = spark.createDataFrame([("0-1", 100, "r2", 2), ("0-1", 100, "r3", 3), ("0-1", 100, "r4", 4)], schema)
    main = spark.createDataFrame([("0", 1, "r2", 2), ("0", 1, "r3", 3), ("0", 9, "q", 3), ("1", 2, "r4", 4)], schema)
    paths = spark.createDataFrame([(100, [2, 3, 4])], "cluster_id long, node_path array<long>")
    kind = "cluster_id long, centroid_vehicle array<double>, centroid_plate array<double>"
    near = spark.createDataFrame([(100, [1.0, 0.0], None), (1, [1.0, 0.1], None), (9, [0.0, 1.0], None), (2, [1.0, 1.0], None)], kind)
    far = spark.createDataFrame([(100, [1.0, 0.0], None), (1, [0.0, 1.0], None), (9, [1.0, 0.1], None), (2, [1.0, 1.0], None)], kind)
    plate = spark.createDataFrame([(100, [1.0, 0.0], [1.0, 0.0]), (1, [0.0, 1.0], [1.0, 0.0]), (9, [1.0, 0.1], None), (2, None, None)], kind)
    found = lambda c, k: rows(merging.match_across(aux, main, paths, borders, all_nodes, c, k))
    assert found(near, 1) == [(100, 1), (100, 2)]
    assert found(far, 1) == [(100, 2)]
    assert found(far, 2) == [(100, 1), (100, 2)]
    assert found(plate, 1) == [(100, 1)]


def test_trajectory_evaluation(spark):
    nodes = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "node_id long, x double, y double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(6) for j in range(6) if abs(i - j) == 1], "u long, v long, length double")
    kind = "cluster_id long, record_id string, node_id long, time double"
    # cluster 10 is vehicle 1 without its last record; vehicle 2 is in no cluster
    truth = spark.createDataFrame([("a", 1, 0, 0.0), ("b", 1, 2, 2.0), ("c", 1, 3, 3.0), ("d", 2, 5, 0.0), ("e", None, 4, 9.0)], "record_id string, vehicle_id long, node_id long, time double")
    members = spark.createDataFrame([(10, "a", 0, 0.0), (10, "b", 2, 2.0)], kind)
    paths = spark.createDataFrame([(10, [0, 1, 2])], "cluster_id long, node_path array<long>")
    got = evaluation.trajectories_against_records(members, paths, truth, nodes, edges, 0.8, 0.5).first()
    assert (got["lcss"], got["edr"]) == (0.0, 0.25)
    near = (2 + math.exp(-1)) / 3
    assert got["stlc"] == pytest.approx(1 - (0.8 * (1 + near) + 0.2 * (1 + near)) / 2)
    true_members = spark.createDataFrame([(7, "a", 0, 0.0), (7, "b", 2, 2.0), (7, "c", 3, 3.0)], kind)
    true_paths = spark.createDataFrame([(7, [0, 1, 2, 3])], "cluster_id long, node_path array<long>")
    vehicles = spark.createDataFrame([(1,), (2,), (3,)], "vehicle_id long")
    assert evaluation.trajectories_against_clusters(members, paths, true_members, true_paths, vehicles, truth, nodes, 0.8, 0.5).first() == got
    none = evaluation.trajectories_against_clusters(members.limit(0), paths, true_members, true_paths, vehicles, truth, nodes).first()
    assert tuple(none) == (None, None, None)


def _shuffled(spark) -> int:
    """Rows that all stages so far have shuffled."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty()
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_trajectory_shared_by_many_vehicles(spark, monkeypatch):
    """A long cluster that is the best of many vehicles goes to each part once, not to each vehicle; parts give what plain loops give."""
    vehicles, long, short = 200, 3000, 5
    rng = np.random.default_rng(7)
    nodes = {i: (float(i % 3), float(i // 3)) for i in range(9)}
    places = spark.createDataFrame([(i, *xy) for i, xy in nodes.items()], "node_id long, x double, y double")
    kind = "cluster_id long, record_id long, node_id long, time double"
    own = [(-1, k, int(rng.integers(9)), float(rng.integers(40_000))) for k in range(long)]
    true = [(k % vehicles, k, own[k][2], own[k][3]) for k in range(vehicles * short)]
    truth = spark.createDataFrame([(k, v) for v, k, _, _ in true], "record_id long, vehicle_id long")

    def paths(members):
        by = {}
        for c, k, n, t in sorted(members, key=lambda m: (m[3], m[1])):
            by.setdefault(c, []).append(n)
        return by

    def table(by):
        return spark.createDataFrame(list(by.items()), "cluster_id long, node_path array<long>")

    of = lambda v: ([nodes[n] for n in paths(true)[v]], [(*nodes[n], t) for c, _, n, t in true if c == v])
    whole, points = [nodes[n] for n in paths(own)[-1]], [(*nodes[n], t) for _, _, n, t in own]
    expected = []
    for v in range(vehicles):
        path, records = of(v)
        common, edits = [0] * (short + 1), list(range(short + 1))
        for i, p in enumerate(whole, 1):
            near = [math.dist(p, q) <= 0.5 for q in path]
            c, e = [0], [i]
            for j in range(short):
                c.append(common[j] + 1 if near[j] else max(common[j + 1], c[j]))
                e.append(min(edits[j] + (not near[j]), edits[j + 1] + 1, e[j] + 1))
            common, edits = c, e
        a, b = np.array(points), np.array(records)
        space = np.hypot(*(a[:, None, :2] - b[:, :2]).transpose(2, 0, 1))
        time = np.abs(a[:, None, 2] - b[:, 2])
        mean = lambda d: np.exp(-d.min(1)).mean() + np.exp(-d.min(0)).mean()
        expected.append((1 - common[-1] / short, edits[-1] / long, 1 - (0.8 * mean(space) + 0.2 * mean(time)) / 2))
    args = spark.createDataFrame(own, kind), table(paths(own)), spark.createDataFrame(true, kind), table(paths(true)), truth.select("vehicle_id"), truth, places, 0.8, 0.5
    # joins as of large tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    before = _shuffled(spark)
    try:
        got = evaluation.trajectories_against_clusters(*args).first()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert tuple(got) == pytest.approx(np.mean(expected, axis=0))
    assert _shuffled(spark) - before < vehicles * long / 4
    monkeypatch.setattr(evaluation, "PAIRS", 30)
    assert tuple(evaluation.trajectories_against_clusters(*args).first()) == pytest.approx(tuple(got))


def test_path_bits_equal_a_table(monkeypatch):
    from waymark.functions import trajectories

    rng = np.random.default_rng(5)
    n = np.r_[0, 1, rng.integers(2, 9, 5), 63, 64, 65, 127, 128, 129, 200]
    px, py = rng.integers(0, 3, (2, n.sum())).astype(float)
    px[::17] = np.nan
    ends = np.cumsum(n)
    for cells, most in ((1 << 22, 512), (300, 512), (1 << 22, 70)):
        monkeypatch.setattr(trajectories, "CELLS", cells)
        monkeypatch.setattr(trajectories, "MOST_BITS", most)
        for long in (0, 1, 5, 150):
            x, y = rng.integers(0, 3, (2, long)).astype(float)
            lcss, edr = trajectories.against_one(x, y, (n, px, py), 1.0)
            for i, m in enumerate(n.tolist()):
                sides = (np.array([long]), x, y), (n[i : i + 1], px[ends[i] - m : ends[i]], py[ends[i] - m : ends[i]])
                common, edits = (trajectories._fill(*sides, 1.0, k)[0] for k in ("lcss", "edr"))
                expected = (1 - common / min(m, long), edits / max(m, long)) if min(m, long) else (math.nan, math.nan)
                assert (lcss[i], edr[i]) == pytest.approx(expected, nan_ok=True, abs=0)


@pytest.mark.parametrize("sizes", [(0, 3), (3, 0), (4, 300), (300, 4), (50, 50)])
def test_similarity_in_time(sizes):
    from waymark.functions.trajectories import similarity_in_time

    rng = np.random.default_rng(6)
    for spread in (3, 300, 30_000):
        a, b = (np.sort(rng.integers(0, spread, k)).astype(float) for k in sizes)
        plain = np.exp(-np.abs(a[:, None] - b).min(1)).sum() if all(sizes) else 0.0
        assert similarity_in_time(a, b) == pytest.approx(plain, abs=1e-300)


def test_match_points(spark):
    """A street with a detour: points off the network pull the path onto the detour, noise does not."""
    places = {0: (0, 0), 1: (100, 0), 2: (200, 0), 3: (100, 80), 4: (300, 0), 9: (900, 900)}
    ways = [(0, 1), (1, 2), (2, 4), (0, 3), (3, 2)]
    nodes = spark.createDataFrame([(k, float(x), float(y)) for k, (x, y) in places.items()], "node_id long, x double, y double")
    edges = spark.createDataFrame([(u, v, math.dist(places[u], places[v])) for u, v in ways], "u long, v long, length double")
    straight, detour = [(2, 5), (60, -8), (140, 3), (290, 6)], [(2, 5), (50, 42), (98, 75), (150, 44), (290, 6)]
    data = [(1, straight), (2, detour), (3, []), (4, None), (5, [(895, 905), (1, 1)]), (6, [(101, 78)])]
    traces = spark.createDataFrame([(k, None if t is None else [{"x": float(x), "y": float(y)} for x, y in t]) for k, t in data], "id long, trace array<struct<x:double,y:double>>")
    got = {r["id"]: r["node_path"] for r in mapmatching.match_points(traces, edges, nodes, distance=20.0).collect()}
    assert got == {1: [0, 1, 2, 4], 2: [0, 3, 2, 4], 3: None, 4: None, 5: None, 6: [3]}


def test_distances_equal_a_plain_table():
    import pyarrow as pa

    from waymark.functions import trajectories

    rng = np.random.default_rng(4)
    paths = [[[{"x": float(x), "y": float(y)} for x, y in rng.integers(0, 3, (n, 2))] for n in rng.integers(0, 9, 40)] for _ in range(2)]
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    a, b = (pa.array(p, kind) for p in paths)
    for cells in (1 << 22, 20):
        trajectories.CELLS = cells
        got = {k: trajectories._tables(a, b, 1.0, k) for k in ("lcss", "edr")}
        for i, (p, q) in enumerate(zip(*paths, strict=True)):
            lcss, edr = np.zeros((len(p) + 1, len(q) + 1)), np.zeros((len(p) + 1, len(q) + 1))
            edr[0], edr[:, 0] = np.arange(len(q) + 1), np.arange(len(p) + 1)
            for x in range(len(p)):
                for y in range(len(q)):
                    near = math.dist(p[x].values(), q[y].values()) <= 1.0
                    lcss[x + 1, y + 1] = lcss[x, y] + 1 if near else max(lcss[x, y + 1], lcss[x + 1, y])
                    edr[x + 1, y + 1] = min(edr[x, y] + (not near), edr[x, y + 1] + 1, edr[x + 1, y] + 1)
            assert got["lcss"][i] == lcss[-1, -1]
            assert got["edr"][i] == edr[-1, -1]


def test_clusters_as_one_array(spark, tmp_path):
    import json
    from pathlib import Path

    kind = "cluster_id string, centroid_vehicle_feature array<float>, centroid_license_plate_feature array<float>, centroid_license_plate_text string, node_path array<long>, records array<struct<record_id:string,vehicle_id:long,camera_id:long,time:long>>"
    data = [(f"c{i}", [1.0, 0.0], None, None, [1, 2], [(f"r{i}", None, 1, i)]) for i in range(5)]
    for name, n in (("many", 5), ("none", 0)):
        path = f"{tmp_path}/{name}"
        sources.write_clusters(spark.createDataFrame(data[:n], kind).repartition(3), path, one_array=True)
        files = [f for f in Path(path).glob("part-*") if f.stat().st_size]
        assert len(files) == 1
        assert [c["cluster_id"] for c in json.loads(files[0].read_text())] == [f"c{i}" for i in range(n)]
        assert sorted(r["cluster_id"] for r in sources.read_clusters(spark, path, one_array=True).collect()) == [f"c{i}" for i in range(n)]


@pytest.mark.parametrize("one_array", [False, True])
def test_commands(spark, tmp_path, capsys, one_array):
    """Two vehicles on a street of two regions, from files to clusters to figures."""
    from waymark.plans import commands

    feature = lambda v: base64.b64encode(np.array(v, "<f4").tobytes()).decode()
    cars = {1: [1.0, 0.05, 0.0, 0.0], 2: [0.0, 0.0, 1.0, 0.02]}
    lines = [{"record_id": f"r{v}{k}", "vehicle_id": v, "camera_id": k, "car_feature": feature([x + 0.001 * k for x in cars[v]]), "plate_feature": feature([0.0] * 4), "plate_text": "", "time": 10 * k + v} for v in cars for k in range(4)]
    (tmp_path / "records.json").write_text("\n".join(map(json.dumps, lines)))
    (tmp_path / "cameras.json").write_text("\n".join(json.dumps({"camera_id": k, "position": [100.0 * k + 3, 2.0]}) for k in range(4)))
    (tmp_path / "nodes.csv").write_text("node_id,x,y,region\n" + "".join(f"{k},{100.0 * k},0.0,{k // 2}\n" for k in range(4)))
    (tmp_path / "edges.csv").write_text("u,v,length\n" + "".join(f"{k},{k + 1},100.0\n{k + 1},{k},100.0\n" for k in range(3)))
    common = [x for n, e in (("records", "json"), ("cameras", "json"), ("nodes", "csv"), ("edges", "csv")) for x in (f"--{n}", f"{tmp_path}/{n}.{e}")] + (["--one-array"] if one_array else [])
    commands.main(["centralized", *common, "--output", f"{tmp_path}/out", "--k", "5", "--dimension", "2"], spark)
    commands.main(["evaluate", *common, "--clusters", f"{tmp_path}/out"], spark)
    alone = json.loads(capsys.readouterr().out)
    assert (alone["precision"], alone["recall"], alone["f1"], alone["expansion"]) == (1, 1, 1, 1)
    assert (alone["lcss"], alone["edr"]) == (0, 0)
    assert alone["stlc"] == pytest.approx(0)
    commands.main(["evaluate", *common, "--clusters", f"{tmp_path}/out", "--true-clusters", f"{tmp_path}/out"], spark)
    assert json.loads(capsys.readouterr().out) == alone
    commands.main(["distributed", *common, "--output", f"{tmp_path}/both", "--k", "5", "--dimension", "2"], spark)
    found = sources.read_clusters(spark, f"{tmp_path}/both", one_array).collect()
    assert {r["record_id"] for c in found for r in c["records"]} == {line["record_id"] for line in lines}


def test_protobuf_bytes():
    from waymark.sources import protobuf

    assert protobuf.varint(300) == b"\xac\x02"
    cluster = {"cluster_id": "c", "centroid_vehicle_feature": [1.0], "centroid_license_plate_feature": None, "centroid_license_plate_text": None, "node_path": [1, 300], "records": [{"record_id": "r", "vehicle_id": None, "camera_id": 7, "time": -2}]}
    raw = bytes.fromhex("0a0163" "12040000803f" "2a0301ac02" "3209" "0a0172" "1001" "1807" "2003")
    assert protobuf.write_cluster(cluster) == raw
    assert protobuf.write_envelope("x", True, None) == bytes.fromhex("0a0178" "1001" "1801")
    assert protobuf.read_cluster(memoryview(raw)) == cluster
    # numbers that are not packed, an unknown field of each kind, and the last of two contents
    odd = bytes.fromhex("2801" "28ac02" "7801" "7a0161" "7d00000000" "790000000000000000")
    assert protobuf.read_cluster(memoryview(odd))["node_path"] == [1, 300]
    assert protobuf.read_envelope(bytes.fromhex("1801" "2203" "0a0163"))[2:][1]["cluster_id"] == "c"
    with pytest.raises(ValueError, match="ends"):
        list(protobuf.fields(memoryview(b"\x0a\x05a")))


def test_protobuf_round_trip(spark):
    from waymark.sources import protobuf

    data = [
        ("c1", [1.5, -2.0], [0.25], "粤B", [1, 2**40], [("r1", 5, 1, 10), ("r2", None, 2, -3)]), ("c2", [1.0], None, None, [3, 4], []),
        ("c3", None, None, "", [9], [("r3", None, 1, 1)]),
    ]
    clusters = spark.createDataFrame(data, protobuf.CLUSTER)
    got = protobuf.from_messages(protobuf.to_messages(clusters, F.lit("0-1"), F.lit(True))).collect()
    assert sorted((r["region_id"], r["is_auxiliary"], r["done"], r["cluster_id"]) for r in got if not r["done"]) == [("0-1", True, False, "c1"), ("0-1", True, False, "c2")]
    assert [(r["cluster_id"], r["records"]) for r in got if r["done"]] == [(None, None)]
    back = {r["cluster_id"]: r for r in got}
    for row in data[:2]:
        r = back[row[0]]
        assert (r["centroid_vehicle_feature"], r["centroid_license_plate_feature"], r["centroid_license_plate_text"], r["node_path"], [tuple(x) for x in r["records"]]) == row[1:]


def test_map_document_of_some_nodes(spark, tmp_path):
    (tmp_path / "map.json").write_text('[{"id": 1, "type": "node", "xy": [1.0, 2.0]}, {"id": 2, "type": "node", "xy": [3.0, 4.0]}, {"id": 3, "type": "way"}]')
    ids = spark.createDataFrame([(2,), (2,), (3,)], "node_id long")
    assert rows(sources.read_map_document(spark, f"{tmp_path}/map.json", ids)) == [(2, 3.0, 4.0)]


def test_evaluation(spark):
    truth = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2), ("d", 3), ("e", 3), ("x", None)], "record_id string, vehicle_id long")
    # vehicle 1 in two clusters (a tie), 2 with an unannotated record, 3 in none
    members = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (30, "x")], "cluster_id long, record_id string")
    b = {r["vehicle_id"]: r for r in evaluation.best_clusters(members, truth).collect()}
    assert (b[1]["cluster_id"], b[1]["parts"], b[3]["cluster_id"], b[3]["common"]) == (10, 2, None, 0)
    got = evaluation.against_records(members, truth).first()
    assert got["precision"] == pytest.approx((1 + 0.5 + 0) / 3)
    assert got["recall"] == pytest.approx((0.5 + 1 + 0) / 3)
    assert got["expansion"] == pytest.approx(1)
    none = evaluation.against_records(members.limit(0), truth).first()
    assert (none["precision"], none["f1"]) == (0, None)
    every = evaluation.against_clusters(members, members, spark.createDataFrame([(1,), (2,), (9,)], "vehicle_id long"), truth).first()
    assert every["precision"] == pytest.approx(2 / 3)


def test_stlc_bounds(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 10.0), (2, 0.0, 0.0, 0.0), (2, 3.0, 4.0, 10.0), (3, 500.0, 500.0, 9999.0)], "id long, x double, y double, t double")
    pairs = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 3, 1), (4, 1, 99)], "pair_id long, id long, true_id long")
    got = {r["pair_id"]: r["stlc"] for r in evaluation.stlc(pairs, p, p).collect()}
    assert got[1] == pytest.approx(0)
    assert got[2] == pytest.approx(1)
    assert got[2] == pytest.approx(got[3])
    assert 4 not in got


def b64(*v):
    return base64.b64encode(np.array(v, "<f4").tobytes()).decode()


def test_record_files(spark, tmp_path):
    lines = [
        {"record_id": "a", "vehicle_id": 1, "camera_id": 5, "car_feature": b64(1, 2), "plate_feature": b64(0, 0), "plate_text": "gone", "time": -5},
        {"record_id": "b", "vehicle_id": None, "camera_id": 6, "car_feature": b64(3, 1), "plate_feature": b64(1, 1), "plate_text": "AB", "time": 7},
        {"record_id": "c", "vehicle_id": 2, "camera_id": 6, "car_feature": b64(0, 5), "plate_feature": None, "plate_text": "no feature", "time": 7},
    ]
    (tmp_path / "r.json").write_text("\n".join(json.dumps(x) for x in lines))
    got = {r["record_id"]: r for r in sources.read_records(spark, str(tmp_path / "r.json"), None).collect()}
    assert [got[k]["plate_text"] for k in "abc"] == [None, "AB", None]
    assert got["a"]["plate_feature"] is None
    assert got["b"]["vehicle_feature"] == [3, 1]
    records = sources.read_records(spark, str(tmp_path / "r.json"), 2)
    assert records.count() == 3
    assert sources.annotated(records).count() == 2
    cams = spark.createDataFrame([("0", 5), ("0-1", 5), ("1", 6)], "region string, camera_id long")
    assert rows(sources.in_regions(records, cams).select("region", "record_id")) == [("0", "a"), ("0-1", "a"), ("1", "b"), ("1", "c")]


def test_projection_keeps_angles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 6)) + 3
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)] + [(99, None)], "id long, f array<float>")
    got = {r["id"]: r["f"] for r in sources.project(df, "f", 6).collect()}
    assert got.pop(99) is None
    p = np.array([got[i] for i in range(40)])
    c = x - x.mean(0)
    assert p @ p.T == pytest.approx(c @ c.T, abs=1e-3)


def test_cluster_files_and_messages(spark, tmp_path):
    record = "array<struct<record_id:string,vehicle_id:long,camera_id:long,time:long>>"
    data = [("x", [1.0], None, None, [1, 2], [("r", None, 5, 9)]), ("y", [2.0], [0.5], "AB", [], [("s", 4, 6, 1)])]
    c = spark.createDataFrame(data, f"cluster_id string, centroid_vehicle_feature array<float>, centroid_license_plate_feature array<float>, centroid_license_plate_text string, node_path array<long>, records {record}")
    sources.write_clusters(c, str(tmp_path / "c"))
    assert rows(sources.read_clusters(spark, str(tmp_path / "c")).select("cluster_id", "centroid_license_plate_text", "node_path")) == [("x", None, [1, 2]), ("y", "AB", [])]
    sent = wire.to_envelopes(c, F.lit("0-1"), F.lit(True))
    back = wire.from_envelopes(sent).collect()
    assert [(r["cluster_id"], r["records"][0]["vehicle_id"]) for r in back] == [("x", None)]
    assert wire.is_complete(sent, spark.createDataFrame([("0-1",)], "region_id string"))
    assert not wire.is_complete(sent, spark.createDataFrame([("0-1",), ("2",)], "region_id string"))


def test_other_files(spark, tmp_path):
    (tmp_path / "cam.json").write_text('{"camera_id": 3, "position": [1.5, 2.5]}\n')
    (tmp_path / "t.json").write_text('{"vehicle_id": 1, "xyt": [[5, 6, 20], [1, 2, 10]]}\n')
    (tmp_path / "n.csv").write_text("NodeID,Longitude,Latitude\n7,114.1,22.5\n")
    (tmp_path / "m.json").write_text('[{"id": 1, "type": "node", "xy": [3, 4]}, {"id": 2, "type": "way"}]')
    assert rows(sources.read_cameras(spark, str(tmp_path / "cam.json"))) == [(3, 1.5, 2.5)]
    t = sources.read_trajectories(spark, str(tmp_path / "t.json")).first()
    assert (t["start"], t["stop"], t["duration"], t["points"][0]["x"]) == (10, 20, 10, 1)
    assert rows(sources.read_nodes_csv(spark, str(tmp_path / "n.csv"))) == [(7, 114.1, 22.5)]
    assert rows(sources.read_map_document(spark, str(tmp_path / "m.json"))) == [(1, 3.0, 4.0)]
    sources.fan_out(spark.range(4), {str(tmp_path / "even"): F.col("id") % 2 == 0, str(tmp_path / "all"): F.lit(True)})
    assert (spark.read.json(str(tmp_path / "even")).count(), spark.read.json(str(tmp_path / "all")).count()) == (2, 4)


def test_simplify(spark):
    # a one-way chain 1-2-3-4, a two-way chain 4-5-6, a branch at 4, a ring 20-21-22, a loop at 1
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 2.0), (3, 4, 3.0), (4, 5, 1.0), (5, 4, 1.5), (5, 6, 2.0), (6, 5, 2.5), (4, 7, 9.0), (20, 21, 1.0), (21, 22, 1.0), (22, 20, 1.0), (1, 1, 0.5)], "u long, v long, length double")
    got = rows(graph.simplify(e))
    assert got == [(1, 1, 0.5), (1, 4, 6.0), (4, 6, 3.0), (4, 7, 9.0), (6, 4, 4.0), (20, 21, 1.0), (21, 22, 1.0), (22, 20, 1.0)]


def test_streamed_clusters(spark, tmp_path):
    from waymark.streaming.clusters import cluster_stream
    from waymark.streaming.counts import run_available, stream_table

    camera_records(spark).coalesce(1).write.parquet(str(tmp_path / "a"))
    more = camera_records(spark).where("record_id <= 2").withColumn("record_id", F.col("record_id") + 10)
    more.coalesce(1).write.mode("append").parquet(str(tmp_path / "a"))
    got = rows(run_available(cluster_stream(stream_table(spark, str(tmp_path / "a")), 0.85), "stream-clusters"))
    of = {r: c for _, r, c in got}
    assert len(of) == 8
    assert of[1] == of[2] == of[11] == of[12]
    assert of[3] == of[4] != of[1]
    assert of[6] == 6


def test_metrics(spark, tmp_path):
    from waymark import metrics

    metrics.log_to(str(tmp_path / "log"))
    df, seen = metrics.counted(spark.range(5), "n")
    with metrics.stage("count", "0-1"):
        df.collect()
    assert seen.get["rows"] == 5
    assert "region 0-1: count" in (tmp_path / "log").read_text()


def test_greedy_clustering_matches_a_plain_loop(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(9, 5))
    data = []
    for i in range(150):
        c = rng.integers(9)
        plate = (centres[c][::-1] + rng.normal(size=5) * 0.3).tolist() if i % 4 else None
        data.append((str(i % 2), i, i, i, int(rng.integers(50)), (centres[c] + rng.normal(size=5) * 0.4).tolist(), plate, f"AB{c}{rng.integers(3)}" if plate and i % 5 else None))
    df = spark.createDataFrame(data, "region string, record_id long, vehicle_id long, camera_id long, time long, vehicle_feature array<double>, plate_feature array<double>, plate_text string")
    got = {r["record_id"]: r["cluster_id"] for r in clustering.cluster_records(df, 12, 0.7).collect()}
    want = {}
    for region in "01":
        mine = sorted((r for r in data if r[0] == region), key=lambda r: (r[4], r[1]))
        unit = {r[1]: (clustering._unit(r[5]), clustering._unit(r[6])) for r in mine}
        of = {}
        for r in mine:
            near = set()
            for k in (0, 1):
                if unit[r[1]][k] is not None:
                    others = [(-(unit[r[1]][k] @ unit[s][k]), s) for s in unit if unit[s][k] is not None]
                    near |= {s for _, s in sorted(others)[:12]} - {r[1]}
            clusters = {of[s].name: of[s] for s in near if s in of}.values()
            scored = sorted(((c.score(*unit[r[1]], r[7]), -list(dict.fromkeys(of[s].name for s in of)).index(c.name), c.name) for c in clusters), reverse=True)
            best = next((c for c in clusters if scored and c.name == scored[0][2]), None)
            if best is None or scored[0][0] <= 0.7:
                best = clustering.Cluster(r[1])
            best.add(*unit[r[1]], r[7])
            of[r[1]] = best
            want[r[1]] = best.name
    assert got == want
    assert 5 < len(set(want.values())) < 120
