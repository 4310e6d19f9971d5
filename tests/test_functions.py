import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymark.functions import geo, scalars, trajectories, vectors


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def points(*xy):
    return F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in xy))


def array(*v):
    return F.array(*(F.lit(float(x)) for x in v))


def test_cosine_of_zero_or_null_is_null(spark):
    assert value(spark, vectors.cosine_similarity(array(1, 2), array(2, 4))) == pytest.approx(1)
    assert value(spark, vectors.cosine_similarity(array(0, 0), array(2, 4))) is None
    assert value(spark, vectors.cosine_similarity(F.lit(None).cast("array<double>"), array(2, 4))) is None
    assert value(spark, vectors.l2_normalize(array(0, 0))) is None


def test_clip_and_zero_feature(spark):
    assert [value(spark, vectors.clip(F.lit(x))) for x in (-0.5, 0.25, 3.0)] == [0, 0.25, 1]
    assert value(spark, vectors.zero_to_null(array(0, 0))) is None
    assert value(spark, vectors.zero_to_null(array(0, 1))) == [0, 1]


def test_feature_codec_round_trip(spark):
    v = np.array([1.5, -2.25, 0.0, 3e-5], "<f4")
    df = spark.createDataFrame([(v.tolist(),), (None,)], "v array<float>")
    back = df.select(vectors.decode_feature(vectors.encode_feature("v")).alias("v")).collect()
    assert back[0]["v"] == v.tolist()
    assert back[1]["v"] is None


@pytest.mark.parametrize(("a", "b", "gain"), [("AB1", "AB1", 0.2), ("AB1", "AB2", 0.05), ("AB1", "A22", 0.0), ("AB1", "222", -0.05), ("ABCD", "1234", -0.1), ("京A12", "粤A12", 0.05), (None, "A", 0.0)])
def test_edit_distance_gain(spark, a, b, gain):
    assert value(spark, scalars.edit_distance_gain(F.lit(a).cast("string"), F.lit(b))) == gain


# logistic(a) * 0.8 ** b, the table of the merge rule
SCORES = {(1, 0): 0.7311, (1, 1): 0.5848, (2, 1): 0.7046, (2, 2): 0.5637, (3, 2): 0.6096, (3, 3): 0.4877, (4, 3): 0.5028}


@pytest.mark.parametrize(("pair", "score"), SCORES.items())
def test_merge_score(spark, pair, score):
    got = value(spark, scalars.merge_score(F.lit(pair[0]), F.lit(pair[1])))
    assert got == pytest.approx(score, abs=5e-5)
    assert (got >= scalars.MERGING_THRESHOLD) == (pair[1] <= 2 and pair[0] >= pair[1] + 1)


def test_merge_score_edges(spark):
    assert value(spark, scalars.merge_score(F.lit(0), F.lit(0))) is None
    assert value(spark, scalars.merge_score(F.lit(1000), F.lit(0))) == 1


def test_uuid5(spark):
    ns = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    got = [r["v"] for r in spark.range(300).select(scalars.uuid5(ns, F.concat(F.lit("x-"), F.col("id"))).alias("v")).collect()]
    assert got == [uuid.uuid5(uuid.UUID(ns), f"x-{i}").hex for i in range(300)]


def test_region_names(spark):
    assert value(spark, scalars.region_name(F.lit(3))) == "3"
    assert value(spark, scalars.region_ends(scalars.region_name(F.lit(3), F.lit(11)))) == [3, 11]
    assert value(spark, scalars.null_if_unset(F.lit(-1))) is None


def test_utm(spark):
    east, north = geo.utm_forward(F.lit(117.0), F.lit(0.0))
    assert (value(spark, east), value(spark, north)) == (pytest.approx(500000), pytest.approx(0, abs=1e-6))
    assert value(spark, geo.utm_forward(F.lit(120.0), F.lit(0.0))[0]) == pytest.approx(833978.557, abs=1e-3)
    lon, lat = geo.utm_inverse(*geo.utm_forward(F.lit(114.0), F.lit(22.6)))
    assert (value(spark, lon), value(spark, lat)) == (pytest.approx(114, abs=1e-8), pytest.approx(22.6, abs=1e-8))


def edges(*pairs):
    return F.array(*(F.struct(F.lit(u).alias("u"), F.lit(v).alias("v")) for u, v in pairs))


def test_node_path(spark):
    assert value(spark, trajectories.node_path(edges((1, 2), (2, 3)))) == [1, 2, 3]
    assert value(spark, trajectories.node_path(edges((1, 2)))) == [1, 2]
    assert value(spark, trajectories.node_path(edges((1, 2), (4, 3)))) is None
    assert value(spark, F.size(trajectories.path_edges(F.array(F.lit(1))))) == 0
    assert not value(spark, trajectories.is_valid_path(F.lit(None).cast("array<long>")))


def reference_lcss(a, b, eps):
    d = np.zeros((len(a) + 1, len(b) + 1))
    for i, p in enumerate(a):
        for j, q in enumerate(b):
            d[i + 1, j + 1] = d[i, j] + 1 if math.dist(p, q) <= eps else max(d[i, j + 1], d[i + 1, j])
    return 1 - d[-1, -1] / min(len(a), len(b))


def reference_edr(a, b, eps):
    d = np.zeros((len(a) + 1, len(b) + 1))
    d[:, 0], d[0, :] = range(len(a) + 1), range(len(b) + 1)
    for i, p in enumerate(a, 1):
        for j, q in enumerate(b, 1):
            d[i, j] = min(d[i - 1, j - 1] + (math.dist(p, q) > eps), d[i - 1, j] + 1, d[i, j - 1] + 1)
    return d[-1, -1] / max(len(a), len(b))


def test_path_distances_match_plain_loops(spark):
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (1, 4), (5, 3), (8, 9)):
        a, b = rng.integers(0, 4, (n, 2)).tolist(), rng.integers(0, 4, (m, 2)).tolist()
        assert value(spark, trajectories.lcss_distance(points(*a), points(*b), 1.0)) == pytest.approx(reference_lcss(a, b, 1.0))
        assert value(spark, trajectories.edr_distance(points(*a), points(*b), 1.0)) == pytest.approx(reference_edr(a, b, 1.0))
        assert value(spark, trajectories.edr_distance(points(*a), points(*a), 0.0)) == 0


def test_path_distance_of_an_empty_path_is_null(spark):
    empty = F.array().cast("array<struct<x:double,y:double>>")
    assert value(spark, trajectories.lcss_distance(empty, points((1, 1)), 1.0)) is None
    assert value(spark, trajectories.edr_distance(points((1, 1)), empty, 1.0)) is None
