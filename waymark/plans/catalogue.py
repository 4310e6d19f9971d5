"""Registered queries over the test tables, and the SQL that gives the same rows.

The tables hold no vehicles, so the domain is mapped to them: events are records
(user_id the vehicle, event_id % 25 the camera, every third one annotated),
nations are cameras, nodes and places, embeddings are features, and trade between
nations is the road graph.
"""

from __future__ import annotations


from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from waymark.functions import geo, scalars, trajectories, vectors
from waymark.operators import aggregates, clustering, datasets, evaluation, graph, knn, mapmatching, merging, regions
from waymark.operators.components import connected_components
from waymark.sources import records as sources
from waymark.storage import scratch_path
from waymark.streaming import counts as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(c) -> F.Column:
    return F.round(c, 6)


SECONDS = "CAST(timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts) AS BIGINT)"


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as records."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("vehicle_id"), (F.col("event_id") % 25).alias("camera_id"), F.expr(SECONDS).alias("time"), "event_type")


SQL_RECORDS = "rec AS (SELECT event_id AS record_id, user_id AS vehicle_id, event_id % 25 AS camera_id, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_type FROM events)"
SQL_CLUSTERS = SQL_RECORDS + ", mem AS (SELECT (vehicle_id % 20)::VARCHAR || '-' || event_type AS cluster_id, record_id, camera_id, time, vehicle_id FROM rec)"


def members(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up clustering of records."""
    return records(spark, sf).withColumn("cluster_id", F.concat_ws("-", (F.col("vehicle_id") % 20).cast("string"), "event_type"))


def nations(spark: SparkSession, sf: str) -> DataFrame:
    """Nations as nodes on a 5 by 5 grid."""
    n = table(spark, sf, "nation")
    k = F.col("n_nationkey").cast("long")
    return n.select(k.alias("node_id"), (k % 5).cast("double").alias("x"), F.floor(k / 5).cast("double").alias("y"), F.col("n_regionkey").cast("long").alias("region"))


SQL_NATIONS = "node AS (SELECT n_nationkey::BIGINT AS node_id, (n_nationkey % 5)::DOUBLE AS x, (n_nationkey // 5)::DOUBLE AS y, n_regionkey::BIGINT AS region FROM nation)"


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """The three nations each nation's customers order most from: edges (u, v, n)."""
    line = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey")
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("u"))
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("v"))
    buyer = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "u")
    # suppliers and customers are looked up on counts by (order's nation, supplier), not on lines
    by = line.join(buyer, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("u", "l_suppkey").agg(F.count("*").alias("k"))
    n = by.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("u", "v").agg(F.sum("k").alias("n"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("n"), "v"))
    return n.withColumn("_k", rank).where("_k <= 3").drop("_k")


SQL_TRADE = """trade AS (SELECT u, v, n FROM (SELECT u, v, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS k FROM (
 SELECT c_nationkey::BIGINT AS u, s_nationkey::BIGINT AS v, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
 JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)) WHERE k <= 3)"""


def ring(spark: SparkSession, sf: str) -> DataFrame:
    """Each nation to the next two: a graph of several hops."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("u"))
    return n.select("u", F.explode(F.array((F.col("u") + 1) % 25, (F.col("u") + 2) % 25)).alias("v"))


SQL_RING = "ring AS (SELECT n_nationkey::BIGINT AS u, (n_nationkey + 1) % 25 AS v FROM nation UNION ALL SELECT n_nationkey, (n_nationkey + 2) % 25 FROM nation)"
SQL_UNIT = "emb AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
SQL_COS = "list_inner_product(a.v, b.v) / sqrt(list_inner_product(a.v, a.v) * list_inner_product(b.v, b.v))"


# --- vectors ---


@query(f"""WITH {SQL_UNIT}, s AS (SELECT a.vec_id AS id, b.vec_id AS neighbor, {SQL_COS} AS sim FROM emb a, emb b),
 r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, neighbor) AS rank FROM s)
 SELECT id, neighbor, round(sim, 6) AS similarity, rank FROM r WHERE rank <= 10 AND id <> neighbor""")
def knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    hits = knn.knn_join(e, e, 10, q_id="vec_id", b_id="vec_id", q_vec="embedding", b_vec="embedding")
    return hits.where("id <> neighbor").select("id", "neighbor", r6("similarity").alias("similarity"), F.col("rank").cast("long").alias("rank"))


def _sql_half(a: int, b: int, k: int) -> str:
    cos = SQL_COS.replace("a.v", f"a.v[{a}:{b}]").replace("b.v", f"b.v[{a}:{b}]")
    return f"SELECT id, candidate FROM (SELECT a.vec_id AS id, b.vec_id AS candidate, row_number() OVER (PARTITION BY a.vec_id ORDER BY {cos} DESC, b.vec_id) AS k FROM emb a, emb b) WHERE k <= {k} AND id <> candidate"


@query(f"WITH {SQL_UNIT} {_sql_half(1, 32, 5)} UNION {_sql_half(33, 64, 5)}")
def knn_two_modality_union(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 32).alias("vehicle"), F.slice("embedding", 33, 32).alias("plate"))
    return knn.candidates(e, 5, ("vehicle", "plate"))


def _sql_near(a: int, b: int, k: int) -> str:
    return _sql_half(a, b, k).replace("SELECT id, candidate FROM (SELECT", "SELECT aux, id AS cluster_id, candidate AS other FROM (SELECT a.label::VARCHAR AS aux,").replace("FROM emb a, emb b)", "FROM emb a JOIN emb b ON a.label = b.label)")


@query(f"WITH {SQL_UNIT} {_sql_near(1, 32, 4)} UNION {_sql_near(33, 64, 4)}")
def rough_search(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("cluster_id"), F.col("label").cast("string").alias("aux"), F.slice("embedding", 1, 32).alias("centroid_vehicle"), F.slice("embedding", 33, 32).alias("centroid_plate"))
    side = e.select("aux", F.col("aux").alias("main"), "cluster_id")
    return merging.rough_search(side, side.withColumnRenamed("cluster_id", "other"), e.drop("aux"), 4).select("aux", "cluster_id", "other")


@query(f"WITH {SQL_UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round({SQL_COS}, 6) AS similarity FROM emb a, emb b WHERE a.vec_id < b.vec_id AND {SQL_COS} > 0.3")
def cosine_pairs_threshold(spark: SparkSession, sf: str) -> DataFrame:
    pairs = knn.similar_pairs(table(spark, sf, "embeddings"), 0.3, id_col="vec_id", vec="embedding")
    return pairs.select("a", "b", r6("similarity").alias("similarity"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE * 3) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS m FROM e)
 SELECT vec_id, unnest(range(1, 65)) AS dim, round(unnest(v) / m, 6) AS x FROM n""")
def l2_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select("vec_id", vectors.l2_normalize(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return e.select("vec_id", F.posexplode("v").alias("dim", "x")).select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), r6("x").alias("x"))


@query("SELECT vec_id, round(greatest(0.0, least(1.0, embedding[1]::DOUBLE * 10)), 6) AS clipped, round(greatest(-0.5, least(0.5, embedding[2]::DOUBLE * 10)), 6) AS clipped_2 FROM embeddings")
def vector_clip(spark: SparkSession, sf: str) -> DataFrame:
    x, y = (F.col("embedding")[i].cast("double") * 10 for i in (0, 1))
    return table(spark, sf, "embeddings").select("vec_id", r6(vectors.clip(x)).alias("clipped"), r6(vectors.clip(y, -0.5, 0.5)).alias("clipped_2"))


SQL_CENTROID = f"{SQL_UNIT}, c AS (SELECT label, dim, avg(x / m) AS x FROM (SELECT label, unnest(range(1, 65)) AS dim, unnest(v) AS x, sqrt(list_inner_product(v, v)) AS m FROM emb) GROUP BY 1, 2)"


@query(f"WITH {SQL_CENTROID} SELECT label, dim, round(x, 6) AS x FROM c")
def centroid_by_label(spark: SparkSession, sf: str) -> DataFrame:
    c = aggregates.centroid(table(spark, sf, "embeddings"), ["label"], "embedding")
    return c.select("label", F.posexplode("centroid").alias("dim", "x")).select("label", (F.col("dim") + 1).cast("long").alias("dim"), r6("x").alias("x"))


@query(f"WITH {SQL_CENTROID} SELECT (label % 3)::BIGINT AS part, dim, round(avg(x), 6) AS x FROM c GROUP BY 1, 2")
def merged_centroid_unweighted(spark: SparkSession, sf: str) -> DataFrame:
    c = aggregates.centroid(table(spark, sf, "embeddings"), ["label"], "embedding").withColumn("part", (F.col("label") % 3).cast("long"))
    m = aggregates.centroid(c.withColumnRenamed("centroid", "v").drop("n"), ["part"], "v", normalize=False)
    return m.select("part", F.posexplode("centroid").alias("dim", "x")).select("part", (F.col("dim") + 1).cast("long").alias("dim"), r6("x").alias("x"))


SQL_GAIN = "CASE WHEN {a} IS NULL OR {b} IS NULL THEN 0.0 WHEN levenshtein({a}, {b}) = 0 THEN 0.2 WHEN levenshtein({a}, {b}) = 1 THEN 0.05 WHEN levenshtein({a}, {b}) = 2 THEN 0.0 WHEN levenshtein({a}, {b}) = 3 THEN -0.05 ELSE -0.1 END::DOUBLE"


@query(f"WITH b AS (SELECT DISTINCT p_brand AS t FROM part) SELECT x.t AS a, y.t AS b, {SQL_GAIN.format(a='x.t', b='y.t')} AS gain FROM b x JOIN b y ON x.t <= y.t")
def edit_gain(spark: SparkSession, sf: str) -> DataFrame:
    b = table(spark, sf, "part").select(F.col("p_brand").alias("a")).distinct()
    pairs = b.join(F.broadcast(b.withColumnRenamed("a", "b")), F.col("a") <= F.col("b"))
    return pairs.select("a", "b", scalars.edit_distance_gain(F.col("a"), F.col("b")).alias("gain"))


@query(f"""WITH {SQL_CENTROID}, l AS (SELECT label, list(x ORDER BY dim) AS v FROM c GROUP BY label),
 p AS (SELECT e.vec_id, e.v[1:32] AS av, l.v[1:32] AS bv, e.v[33:64] AS ap, e.vec_id % 4 = 0 AS bare, l.v[33:64] AS bp, q.p_brand AS t, 'Brand#1' || (e.label % 3 + 1)::VARCHAR AS u
 FROM emb e JOIN l USING (label) LEFT JOIN part q ON q.p_partkey = e.vec_id),
 s AS (SELECT *, list_inner_product(av, bv) / sqrt(list_inner_product(av, av) * list_inner_product(bv, bv)) AS cv, list_inner_product(ap, bp) / sqrt(list_inner_product(ap, ap) * list_inner_product(bp, bp)) AS cp FROM p)
 SELECT vec_id, round(greatest(0.0, least(1.0, CASE WHEN bare THEN cv ELSE 0.2 * cv + 0.8 * cp + {SQL_GAIN.format(a='t', b='u')} END)), 6) AS score FROM s""")
def multimodal_score(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    c = aggregates.centroid(e, ["label"], "embedding").select("label", "centroid")
    text = table(spark, sf, "part").select(F.col("p_partkey").alias("vec_id"), "p_brand")
    j = e.join(c, "label").join(text, "vec_id", "left")
    plate = F.when(F.col("vec_id") % 4 != 0, F.slice("embedding", 33, 32))
    brand = F.concat(F.lit("Brand#1"), (F.col("label") % 3 + 1).cast("string"))
    score = scalars.record_cluster_score(F.slice("embedding", 1, 32), plate, F.col("p_brand"), F.slice("centroid", 1, 32), F.slice("centroid", 33, 32), brand)
    return j.select("vec_id", r6(score).alias("score"))


@query("SELECT vec_id, 64::BIGINT AS n, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 4) AS total, vec_id % 5 = 0 AS missing FROM embeddings")
def feature_codec(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").withColumn("code", vectors.encode_feature("embedding"))
    zero = vectors.zero_to_null(F.when(F.col("vec_id") % 5 == 0, F.transform("embedding", lambda x: F.lit(0.0).cast("float"))).otherwise(F.col("embedding")))
    v = e.select("vec_id", vectors.decode_feature("code").alias("v"), zero.isNull().alias("missing"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return v.select("vec_id", F.size("v").cast("long").alias("n"), F.round(total, 4).alias("total"), "missing")


# --- scalars, identifiers, coordinates ---


@query("""WITH d AS (SELECT event_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('vehicle-record-' || event_id::VARCHAR)) AS h FROM events)
 SELECT event_id, h[1:12] || '5' || h[14:16] || substr('89ab', (strpos('0123456789abcdef', h[17:17]) - 1)::INT % 4 + 1, 1) || h[18:32] AS record_id FROM d""")
def uuid5_ids(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.attach_ids(table(spark, sf, "events").select("event_id"), "event_id")


@query("""SELECT event_id, round(-4.25994981e-06 * (event_id % 1000) * 10 + -8.74119271e-06 * value + 114.01421, 6) AS lon, round(8.11700876e-06 * (event_id % 1000) * 10 + -3.95042166e-06 * value + 22.643807, 6) AS lat FROM events""")
def affine_transform(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    lon, lat = geo.affine((F.col("event_id") % 1000 * 10).cast("double"), F.col("value"))
    return e.select("event_id", r6(lon).alias("lon"), r6(lat).alias("lat"))


def _sql_utm() -> str:
    east, north = "eta", "xi"
    for j, a in enumerate(geo.ALPHA, 1):
        east += f" + {a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)"
        north += f" + {a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)"
    return f"""WITH p AS (SELECT n_nationkey::BIGINT AS node_id, 114.0::DOUBLE + (n_nationkey % 5) * 0.1::DOUBLE AS lon, 22.5::DOUBLE + (n_nationkey // 5) * 0.05::DOUBLE AS lat FROM nation),
 q AS (SELECT *, sinh(atanh(sin(radians(lat))) - {geo.ECC!r} * atanh({geo.ECC!r} * sin(radians(lat)))) AS t, radians(lon - {geo.meridian(50)!r}) AS lam FROM p),
 s AS (SELECT *, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM q)
 SELECT node_id, round(500000.0 + {geo.RADIUS!r} * ({east}), 4) AS easting, round({geo.RADIUS!r} * ({north}), 4) AS northing, round(lon, 6) AS lon_back, round(lat, 6) AS lat_back FROM s"""


@query(_sql_utm())
def utm_project(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("n_nationkey")
    p = table(spark, sf, "nation").select(n.cast("long").alias("node_id"), (114.0 + n % 5 * 0.1).alias("lon"), (22.5 + F.floor(n / 5) * 0.05).alias("lat"))
    e, m = geo.utm_forward(F.col("lon"), F.col("lat"))
    there = p.select("node_id", e.alias("easting"), m.alias("northing"))
    lon, lat = geo.utm_inverse(F.col("easting"), F.col("northing"))
    return there.select("node_id", F.round("easting", 4).alias("easting"), F.round("northing", 4).alias("northing"), r6(lon).alias("lon_back"), r6(lat).alias("lat_back"))


@query("SELECT i::VARCHAR || '-' || j::VARCHAR AS region, i, j, NULLIF(i - 1, -1) AS maybe FROM (SELECT DISTINCT n_regionkey::BIGINT AS i, n_regionkey + 1::BIGINT AS j FROM nation)")
def region_names(spark: SparkSession, sf: str) -> DataFrame:
    i = table(spark, sf, "nation").select(F.col("n_regionkey").cast("long").alias("i")).distinct().withColumn("j", F.col("i") + 1)
    named = i.select(scalars.region_name(F.col("i"), F.col("j")).alias("region"), scalars.unset_if_null(F.when(F.col("i") > 0, F.col("i") - 1)).alias("wire"))
    ends = scalars.region_ends(F.col("region"))
    return named.select("region", ends[0].cast("long").alias("i"), ends[1].cast("long").alias("j"), scalars.null_if_unset(F.col("wire")).alias("maybe"))


# --- predicates and relational work ---


@query("SELECT event_id AS record_id, user_id AS vehicle_id FROM events WHERE event_id % 3 = 0")
def annotated_filter(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf).withColumn("vehicle_id", F.when(F.col("record_id") % 3 == 0, F.col("vehicle_id")))
    return sources.annotated(r).select("record_id", "vehicle_id")


@query(f"WITH {SQL_RECORDS} SELECT record_id, n_regionkey::VARCHAR AS region FROM rec JOIN nation ON camera_id = n_nationkey WHERE n_regionkey IN (1, 3)")
def region_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    cams = table(spark, sf, "nation").where("n_regionkey IN (1, 3)").select(F.col("n_nationkey").cast("long").alias("camera_id"), F.col("n_regionkey").cast("string").alias("region"))
    return sources.in_regions(records(spark, sf), cams).select("record_id", "region")


@query(f"WITH {SQL_RECORDS} SELECT camera_id, count(*) AS n, count(*) FILTER (record_id % 3 = 0) AS annotated FROM rec GROUP BY 1")
def records_per_camera(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).groupBy("camera_id").agg(F.count("*").alias("n"), F.count_if(F.col("record_id") % 3 == 0).alias("annotated"))


@query(f"WITH {SQL_RECORDS}, s AS (SELECT camera_id, vehicle_id, count(*) AS k FROM rec GROUP BY 1, 2) SELECT camera_id, count(*) AS clusters, count(*) FILTER (k = 1) AS singletons, count(*) FILTER (k > 1) AS larger FROM s GROUP BY 1")
def singleton_counts(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.singleton_counts(records(spark, sf).withColumnRenamed("vehicle_id", "cluster_id"), ["camera_id"])


@query(f"WITH {SQL_RECORDS}, c AS (SELECT vehicle_id, event_type, count(*) AS n, min((time, record_id)) AS f FROM rec GROUP BY 1, 2) SELECT vehicle_id, event_type, n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, f) AS k FROM c) WHERE k = 1")
def majority_text_first_seen(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.majority(records(spark, sf), ["vehicle_id"], "event_type", ["time", "record_id"])


@query(f"WITH {SQL_RECORDS}, t AS (SELECT vehicle_id, camera_id, min(event_type) AS text FROM rec GROUP BY 1, 2), c AS (SELECT vehicle_id, text, count(*) AS n FROM t GROUP BY 1, 2) SELECT vehicle_id, text, n FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, text) AS k FROM c) WHERE k = 1")
def majority_text_partial(spark: SparkSession, sf: str) -> DataFrame:
    t = records(spark, sf).groupBy("vehicle_id", "camera_id").agg(F.min("event_type").alias("text"))
    return aggregates.majority(t, ["vehicle_id"], "text")


@query("SELECT i::INT AS bin, (SELECT count(*) FROM events WHERE value BETWEEN 10 AND 190 AND least(floor((value - 10) / 15) + 1, 12) = i) AS n FROM range(1, 13) t(i)")
def histogram_12(spark: SparkSession, sf: str) -> DataFrame:
    return aggregates.histogram(table(spark, sf, "events"), F.col("value"), 10, 190, 12)


@query("""SELECT 'value' AS what, round(min(value), 6) AS low, round(max(value), 6) AS high, round(avg(value), 6) AS mean, round(median(value), 6) AS middle FROM events
 UNION ALL SELECT 'price', round(min(l_extendedprice), 6), round(max(l_extendedprice), 6), round(avg(l_extendedprice), 6), round(median(l_extendedprice), 6) FROM lineitem""")
def scalar_stats(spark: SparkSession, sf: str) -> DataFrame:
    stats = lambda c: (F.round(F.min(c), 6).alias("low"), F.round(F.max(c), 6).alias("high"), F.round(F.avg(c), 6).alias("mean"), F.round(F.median(c), 6).alias("middle"))
    v = table(spark, sf, "events").agg(*stats("value")).select(F.lit("value").alias("what"), "*")
    return v.union(table(spark, sf, "lineitem").agg(*stats("l_extendedprice")).select(F.lit("price").alias("what"), "*"))


@query(f"WITH {SQL_RECORDS} SELECT record_id, time FROM rec WHERE time > 1704500000 AND time < 1705000000")
def time_range_filter(spark: SparkSession, sf: str) -> DataFrame:
    return records(spark, sf).where((F.col("time") > 1704500000) & (F.col("time") < 1705000000)).select("record_id", "time")


@query(f"""WITH {SQL_RECORDS}, t AS (SELECT vehicle_id, min(time) AS start, max(time) AS stop FROM rec GROUP BY 1), l AS (SELECT min(time) + 3600 AS a, max(time) - 3600 AS b FROM rec)
 SELECT vehicle_id, start, stop, stop - start AS duration FROM t, l WHERE start < a OR stop > b""")
def outlier_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    t = records(spark, sf).groupBy("vehicle_id").agg(F.min("time").alias("start"), F.max("time").alias("stop"))
    ends = t.agg((F.min("start") + 3600).alias("a"), (F.max("stop") - 3600).alias("b"))
    out = t.crossJoin(F.broadcast(ends)).where("start < a OR stop > b")
    return out.select("vehicle_id", "start", "stop", (F.col("stop") - F.col("start")).alias("duration"))


@query(f"WITH {SQL_RECORDS} SELECT record_id, time, row_number() OVER (PARTITION BY camera_id ORDER BY time, record_id) AS place, camera_id FROM rec")
def sort_stable(spark: SparkSession, sf: str) -> DataFrame:
    ordered = datasets.sort_by_time(records(spark, sf).select("record_id", "time", "camera_id"), "time", "record_id")
    return ordered.withColumn("place", F.row_number().over(Window.partitionBy("camera_id").orderBy("time", "record_id")).cast("long")).select("record_id", "time", "place", "camera_id")


@query(f"WITH {SQL_RECORDS} SELECT count(*) FILTER (p > time) AS inversions FROM (SELECT time, lag(time) OVER (ORDER BY record_id) AS p FROM rec)")
def sortedness(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.out_of_order(records(spark, sf), "time", "record_id")


@query(f"WITH {SQL_RECORDS} SELECT record_id FROM (SELECT record_id, row_number() OVER (PARTITION BY record_id % 3 = 0 ORDER BY time, record_id) AS k FROM rec) WHERE record_id % 3 = 0 OR k <= 500")
def dataset_generation(spark: SparkSession, sf: str) -> DataFrame:
    return datasets.subset(records(spark, sf), F.col("record_id") % 3 == 0, 500, ["time", "record_id"]).select("record_id")


@query(f"WITH {SQL_RECORDS}, {SQL_NATIONS} SELECT record_id, node_id, x, y, sqrt(x * x + y * y) AS far FROM rec JOIN node ON camera_id = node_id")
def camera_node_join(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf)
    far = geo.euclidean(F.col("x"), F.col("y"), F.lit(0.0), F.lit(0.0))
    return records(spark, sf).join(n, F.col("camera_id") == F.col("node_id")).select("record_id", "node_id", "x", "y", far.alias("far"))


@query(f"""WITH {SQL_NATIONS}, p AS (SELECT s_suppkey AS point_id, (s_suppkey * 7 % 41) / 8.0 AS x, (s_suppkey * 11 % 43) / 8.0 AS y FROM supplier),
 d AS (SELECT point_id, node_id AS site_id, sqrt(pow(p.x - node.x, 2) + pow(p.y - node.y, 2)) AS distance FROM p, node)
 SELECT point_id, site_id, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY distance, site_id) AS k FROM d) WHERE k = 1""")
def nearest_node(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("s_suppkey")
    p = table(spark, sf, "supplier").select(k.alias("point_id"), (k * 7 % 41 / 8.0).alias("x"), (k * 11 % 43 / 8.0).alias("y"))
    near = graph.nearest(p, nations(spark, sf).withColumnRenamed("node_id", "site_id"), 1.0)
    return near.select("point_id", "site_id", r6("distance").alias("distance"))


# --- traces and paths ---


@query(f"WITH {SQL_RECORDS}, {SQL_NATIONS} SELECT vehicle_id, count(*) AS n, string_agg(x::INT::VARCHAR || ',' || y::INT::VARCHAR, ' ' ORDER BY time, record_id) AS trace FROM rec JOIN node ON camera_id = node_id GROUP BY 1")
def trace_build(spark: SparkSession, sf: str) -> DataFrame:
    j = records(spark, sf).join(nations(spark, sf), F.col("camera_id") == F.col("node_id"))
    t = j.groupBy("vehicle_id").agg(trajectories.trace(F.col("time"), F.col("record_id"), F.col("x"), F.col("y")).alias("t"))
    text = F.array_join(F.transform("t", lambda p: F.concat_ws(",", p["x"].cast("int").cast("string"), p["y"].cast("int").cast("string"))), " ")
    return t.select("vehicle_id", F.size("t").cast("long").alias("n"), text.alias("trace"))


def _paths(spark: SparkSession, sf: str) -> DataFrame:
    """Each vehicle's nodes by time."""
    ordered = F.sort_array(F.collect_list(F.struct("time", "record_id", "camera_id")))
    return records(spark, sf).groupBy("vehicle_id").agg(F.transform(ordered, lambda s: s["camera_id"]).alias("path"))


SQL_STEPS = f"{SQL_RECORDS}, num AS (SELECT vehicle_id, camera_id, row_number() OVER (PARTITION BY vehicle_id ORDER BY time, record_id) AS k FROM rec)"


@query(f"""WITH {SQL_STEPS}, {SQL_TRADE}, e AS (SELECT a.vehicle_id, a.k, a.camera_id AS u, b.camera_id AS v, EXISTS (SELECT 1 FROM trade WHERE trade.u = a.camera_id AND trade.v = b.camera_id) AS ok FROM num a JOIN num b ON a.vehicle_id = b.vehicle_id AND b.k = a.k + 1)
 SELECT vehicle_id, count(*) AS edges, count(*) FILTER (NOT ok) AS missing, bool_and(ok) AS valid FROM e GROUP BY 1""")
def path_validity(spark: SparkSession, sf: str) -> DataFrame:
    p = _paths(spark, sf).withColumn("edges", trajectories.path_edges(F.col("path"))).where("size(edges) > 0")
    # a path of edges gives its nodes back
    p = p.withColumn("back", trajectories.node_path(F.col("edges"))).where(F.col("back") == F.col("path"))
    known = trade(spark, sf).select("u", "v", F.lit(True).alias("known"))
    e = p.select("vehicle_id", F.explode("edges").alias("e")).select("vehicle_id", "e.u", "e.v").join(known, ["u", "v"], "left")
    missing = F.count_if(F.col("known").isNull())
    return e.groupBy("vehicle_id").agg(F.count("*").alias("edges"), missing.alias("missing"), (missing == 0).alias("valid"))


@query(f"""WITH RECURSIVE {SQL_STEPS}, {SQL_NATIONS}, pts AS (SELECT vehicle_id, list((x, y) ORDER BY k) AS p FROM num JOIN node ON camera_id = node_id GROUP BY 1),
 pr AS (SELECT a.vehicle_id AS id, a.p AS a, b.p AS b FROM pts a JOIN pts b ON b.vehicle_id = a.vehicle_id + 1 WHERE len(a.p) > 1 AND len(b.p) > 1),
 dp AS (SELECT id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS r, list_transform(range(0, len(b) + 1), lambda j: j::INT) AS d FROM pr UNION ALL
  SELECT id, a, b, i + 1,
   list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN sqrt(pow(a[i + 1][1] - b[j][1], 2) + pow(a[i + 1][2] - b[j][2], 2)) <= 1.0 THEN r[j] + 1 ELSE greatest(r[j + 1], acc[-1]) END), [0]),
   list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(d[j] + CASE WHEN sqrt(pow(a[i + 1][1] - b[j][1], 2) + pow(a[i + 1][2] - b[j][2], 2)) <= 1.0 THEN 0 ELSE 1 END, d[j + 1] + 1, acc[-1] + 1)), [d[1] + 1])
  FROM dp WHERE i < len(a))
 SELECT id, round(1 - r[-1] / least(len(a), len(b)), 6) AS lcss, round(d[-1] / greatest(len(a), len(b)), 6) AS edr FROM dp WHERE i = len(a)""")
def lcss_edr(spark: SparkSession, sf: str) -> DataFrame:
    points = evaluation.points_along(_paths(spark, sf), nations(spark, sf), "vehicle_id", "path")
    other = points.select((F.col("vehicle_id") - 1).alias("vehicle_id"), F.col("points").alias("true_points"))
    pairs = points.join(other, "vehicle_id")
    d = evaluation.path_distances(pairs, "points", "true_points", 1.0)
    return d.select(F.col("vehicle_id").alias("id"), r6("lcss").alias("lcss"), r6("edr").alias("edr"))


@query(f"""WITH {SQL_RECORDS}, num AS (SELECT vehicle_id, string_agg(event_type[1:1], '' ORDER BY time, record_id) AS s FROM rec GROUP BY 1)
 SELECT a.vehicle_id AS id, round(levenshtein(a.s, b.s) / greatest(length(a.s), length(b.s)), 6) AS edr FROM num a JOIN num b ON b.vehicle_id = a.vehicle_id + 1""")
def edr_letters(spark: SparkSession, sf: str) -> DataFrame:
    code = F.ascii(F.substring("event_type", 1, 1)).cast("double")
    ordered = F.sort_array(F.collect_list(F.struct("time", "record_id", code.alias("c"))))
    p = records(spark, sf).groupBy("vehicle_id").agg(F.transform(ordered, lambda s: F.struct(s["c"].alias("x"), F.lit(0.0).alias("y"))).alias("p"))
    both = p.join(p.select((F.col("vehicle_id") - 1).alias("vehicle_id"), F.col("p").alias("q")), "vehicle_id")
    return both.select(F.col("vehicle_id").alias("id"), r6(trajectories.edr_distance(F.col("p"), F.col("q"), 0.0)).alias("edr"))


SQL_STLC_SIDE = "SELECT a.id, avg(exp(-s)) AS s, avg(exp(-t)) AS t FROM (SELECT a.id, a.k, min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) AS s, min(abs(a.t - b.t)) AS t FROM {a} a JOIN {b} b USING (id) GROUP BY 1, 2) a GROUP BY 1"


@query(f"""WITH {SQL_RECORDS}, {SQL_NATIONS}, p AS (SELECT vehicle_id, record_id AS k, x, y, time / 3600.0 AS t FROM rec JOIN node ON camera_id = node_id),
 a AS (SELECT vehicle_id AS id, k, x, y, t FROM p WHERE vehicle_id % 2 = 0), b AS (SELECT vehicle_id - 1 AS id, k, x, y, t FROM p WHERE vehicle_id % 2 = 1),
 f AS ({SQL_STLC_SIDE.format(a='a', b='b')}), g AS ({SQL_STLC_SIDE.format(a='b', b='a')})
 SELECT id AS pair_id, round(1 - (0.8 * (f.s + g.s) + 0.2 * (f.t + g.t)) / 2, 6) AS stlc FROM f JOIN g USING (id)""")
def stlc(spark: SparkSession, sf: str) -> DataFrame:
    p = records(spark, sf).join(nations(spark, sf), F.col("camera_id") == F.col("node_id")).select(F.col("vehicle_id").alias("id"), "x", "y", (F.col("time") / 3600.0).alias("t"))
    ids = p.select("id").distinct()
    pairs = ids.where("id % 2 = 0").select(F.col("id").alias("pair_id"), "id", (F.col("id") + 1).alias("true_id"))
    return evaluation.stlc(pairs, p, p).select("pair_id", r6("stlc").alias("stlc"))


@query(f"""WITH RECURSIVE {SQL_CLUSTERS}, {SQL_NATIONS}, hit AS (SELECT vehicle_id, cluster_id, count(*) AS n FROM mem GROUP BY 1, 2),
 bst AS (SELECT vehicle_id AS id, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY n DESC, cluster_id) AS k FROM hit) WHERE k = 1),
 a AS (SELECT id, record_id AS k, x, y, time AS t FROM bst JOIN mem USING (cluster_id) JOIN node ON camera_id = node_id), b AS (SELECT vehicle_id AS id, record_id AS k, x, y, time AS t FROM rec JOIN node ON camera_id = node_id),
 f AS ({SQL_STLC_SIDE.format(a='a', b='b')}), g AS ({SQL_STLC_SIDE.format(a='b', b='a')}),
 pa AS (SELECT id, list((x, y) ORDER BY t, k) AS a FROM a GROUP BY 1), pb AS (SELECT id, list((x, y) ORDER BY t, k) AS b FROM b GROUP BY 1), pr AS (SELECT * FROM pa JOIN pb USING (id) WHERE len(a) > 1 AND len(b) > 1),
 dp AS (SELECT id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS r, list_transform(range(0, len(b) + 1), lambda j: j::INT) AS d FROM pr UNION ALL
  SELECT id, a, b, i + 1,
   list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, CASE WHEN sqrt(pow(a[i + 1][1] - b[j][1], 2) + pow(a[i + 1][2] - b[j][2], 2)) <= 1.0 THEN r[j] + 1 ELSE greatest(r[j + 1], acc[-1]) END), [0]),
   list_reduce(range(1, len(b) + 1), lambda acc, j: list_append(acc, least(d[j] + CASE WHEN sqrt(pow(a[i + 1][1] - b[j][1], 2) + pow(a[i + 1][2] - b[j][2], 2)) <= 1.0 THEN 0 ELSE 1 END, d[j + 1] + 1, acc[-1] + 1)), [d[1] + 1])
  FROM dp WHERE i < len(a))
 SELECT round(avg(1 - r[-1] / least(len(a), len(b))), 6) AS lcss, round(avg(d[-1] / greatest(len(a), len(b))), 6) AS edr,
  round((SELECT avg(1 - (0.8 * (f.s + g.s) + 0.2 * (f.t + g.t)) / 2) FROM f JOIN g USING (id)), 6) AS stlc FROM dp WHERE i = len(a)""")
def trajectory_eval(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of a made-up clustering against each vehicle's own records as its true cluster, with paths from node to node."""
    columns = ("cluster_id", "record_id", F.col("camera_id").alias("node_id"), F.col("time").cast("double").alias("time"))
    of = members(spark, sf).select(*columns)
    true = records(spark, sf).withColumn("cluster_id", F.col("vehicle_id").cast("string")).select(*columns)
    path = F.transform(F.sort_array(F.collect_list(F.struct("time", "record_id", "node_id"))), lambda r: r["node_id"]).alias("node_path")
    r = records(spark, sf)
    out = evaluation.trajectories_against_clusters(of, of.groupBy("cluster_id").agg(path), true, true.groupBy("cluster_id").agg(path), r.select("vehicle_id"), r.select("record_id", "vehicle_id"), nations(spark, sf), 0.8, 1.0)
    return out.select(*(r6(c).alias(c) for c in ("lcss", "edr", "stlc")))


@query()
def match_points(spark: SparkSession, sf: str) -> DataFrame:
    """Each vehicle's records as points beside its cameras, matched to the roads between neighbours on the grid."""
    n = nations(spark, sf)
    off = lambda c: (F.col(c) + (F.col("record_id") % 7 - 3) * 0.05).alias(c)
    j = records(spark, sf).join(n, F.col("camera_id") == F.col("node_id"))
    traces = j.select("vehicle_id", "time", "record_id", off("x"), off("y")).groupBy("vehicle_id").agg(trajectories.trace(F.col("time"), F.col("record_id"), F.col("x"), F.col("y")).alias("trace"))
    m = n.select(F.col("node_id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy"))
    step = [m.join(n.select(F.col("node_id").alias("u"), (F.col("x") + dx).alias("vx"), (F.col("y") + dy).alias("vy")), ["vx", "vy"]) for dx, dy in ((0, 1), (1, 0), (0, -1), (-1, 0))]
    edges = step[0].union(step[1]).union(step[2]).union(step[3]).select("u", "v", F.lit(1.0).alias("length"))
    return mapmatching.match_points(traces, edges, n, distance=0.3, share=0.9).select("vehicle_id", F.size("trace").alias("n"), "node_path")


# --- graph and regions ---


@query(f"""WITH {SQL_TRADE}, {SQL_NATIONS} SELECT least(a.region, b.region)::VARCHAR || '-' || greatest(a.region, b.region)::VARCHAR AS region, CASE WHEN a.region < b.region THEN 'i_to_j' ELSE 'j_to_i' END AS direction, u, v
 FROM trade JOIN node a ON u = a.node_id JOIN node b ON v = b.node_id WHERE a.region <> b.region""")
def border_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.border_edges(trade(spark, sf), nations(spark, sf))


SQL_AUX = f"{SQL_RING}, {SQL_NATIONS}, bor AS (SELECT least(a.region, b.region)::VARCHAR || '-' || greatest(a.region, b.region)::VARCHAR AS region, CASE WHEN a.region < b.region THEN 'i_to_j' ELSE 'j_to_i' END AS direction, u, v FROM ring JOIN node a ON u = a.node_id JOIN node b ON v = b.node_id WHERE a.region <> b.region), aux AS (SELECT DISTINCT region, unnest([u, v]) AS node_id FROM bor)"


@query(f"WITH {SQL_AUX} SELECT region, node_id FROM aux")
def aux_regions(spark: SparkSession, sf: str) -> DataFrame:
    return graph.auxiliary_regions(graph.border_edges(ring(spark, sf), nations(spark, sf)))


@query(f"""WITH RECURSIVE {SQL_AUX}, und AS (SELECT u, v FROM ring UNION SELECT v, u FROM ring), bfs AS (SELECT region, node_id, 0 AS hop FROM aux UNION SELECT region, v, hop + 1 FROM bfs JOIN und ON node_id = u WHERE hop < 5),
 d AS (SELECT region, node_id, min(hop) AS hop FROM bfs GROUP BY 1, 2), c AS (SELECT region, k, count(*) AS n FROM d, range(1, 6) t(k) WHERE hop <= k GROUP BY 1, 2), s AS (SELECT region, min(k) AS cutoff FROM c WHERE n >= 16 GROUP BY 1)
 SELECT region, cutoff::INT AS cutoff, node_id FROM d JOIN s USING (region) WHERE hop <= cutoff""")
def aux_expansion(spark: SparkSession, sf: str) -> DataFrame:
    e, n = ring(spark, sf), nations(spark, sf)
    cams = n.select(F.col("node_id").alias("camera_id"), "node_id")
    return graph.expand_auxiliary(e, graph.auxiliary_regions(graph.border_edges(e, n)), cams, 16, 1, 5)


@query(f"""WITH {SQL_STEPS}, {SQL_AUX}, e AS (SELECT a.vehicle_id, a.camera_id AS u, b.camera_id AS v FROM num a JOIN num b ON a.vehicle_id = b.vehicle_id AND b.k = a.k + 1)
 SELECT DISTINCT vehicle_id AS cluster_id, region, direction FROM e JOIN bor USING (u, v)""")
def crossing_clusters(spark: SparkSession, sf: str) -> DataFrame:
    paths = _paths(spark, sf).select(F.col("vehicle_id").alias("cluster_id"), F.col("path").alias("node_path"))
    return merging.crossing(paths, graph.border_edges(ring(spark, sf), nations(spark, sf)))


@query(f"WITH {SQL_CLUSTERS}, {SQL_AUX} SELECT DISTINCT cluster_id, region FROM mem JOIN aux ON camera_id = node_id")
def overlap_clusters(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf).select("cluster_id", "record_id", F.col("camera_id").alias("node_id"))
    return merging.overlapping(m, graph.auxiliary_regions(graph.border_edges(ring(spark, sf), nations(spark, sf))))


SQL_SCORES = f"""{SQL_RECORDS}, l AS (SELECT vehicle_id % 40 AS left_id, record_id FROM rec), r AS (SELECT time // 86400 % 1000 * 1000 + vehicle_id % 40 AS right_id, record_id FROM rec),
 c AS (SELECT left_id, right_id, count(*) AS common FROM l JOIN r USING (record_id) GROUP BY 1, 2), na AS (SELECT left_id, count(*) AS na FROM l GROUP BY 1), nb AS (SELECT right_id, count(*) AS nb FROM r GROUP BY 1),
 sc AS (SELECT left_id, right_id, common, na + nb - 2 * common AS apart, pow(0.8, na + nb - 2 * common) / (1 + exp(-common::DOUBLE)) AS score FROM c JOIN na USING (left_id) JOIN nb USING (right_id))"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    left = r.select((F.col("vehicle_id") % 40).alias("cluster_id"), "record_id")
    right = r.select((F.floor(F.col("time") / 86400) % 1000 * 1000 + F.col("vehicle_id") % 40).alias("cluster_id"), "record_id")
    return merging.overlap_scores(left, right)


@query(f"WITH {SQL_SCORES} SELECT left_id, right_id, common, apart, round(score, 9) AS score FROM sc")
def merge_score(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).withColumn("score", F.round("score", 9))


@query(f"""WITH {SQL_RECORDS}, l AS (SELECT vehicle_id * 1000 + time // 432000 % 1000 AS left_id, record_id FROM rec), r AS (SELECT vehicle_id * 1000 + (time + 21600) // 432000 % 1000 AS right_id, record_id FROM rec),
 c AS (SELECT left_id, right_id, count(*) AS common FROM l JOIN r USING (record_id) GROUP BY 1, 2), na AS (SELECT left_id, count(*) AS na FROM l GROUP BY 1), nb AS (SELECT right_id, count(*) AS nb FROM r GROUP BY 1),
 sc AS (SELECT left_id, right_id, pow(0.8, na + nb - 2 * common) / (1 + exp(-common::DOUBLE)) AS score FROM c JOIN na USING (left_id) JOIN nb USING (right_id))
 SELECT left_id, right_id FROM (SELECT *, row_number() OVER (PARTITION BY left_id ORDER BY round(score, 12) DESC, right_id) AS k FROM sc) WHERE k = 1 AND score >= 0.6""")
def merge_pairs(spark: SparkSession, sf: str) -> DataFrame:
    r = records(spark, sf)
    cut = lambda late: r.select((F.col("vehicle_id") * 1000 + F.floor((F.col("time") + late) / 432000) % 1000).alias("cluster_id"), "record_id")
    scores = merging.overlap_scores(cut(0), cut(21600)).withColumn("score", F.round("score", 12))
    return merging.pairs_to_merge(scores).select("left_id", "right_id")


@query(f"""WITH RECURSIVE {SQL_UNIT}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a, emb b WHERE a.vec_id <> b.vec_id AND {SQL_COS} > 0.42),
 w AS (SELECT a AS node, a AS seen FROM e UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a) SELECT node, min(seen) AS component FROM w GROUP BY 1""")
def components(spark: SparkSession, sf: str) -> DataFrame:
    pairs = knn.similar_pairs(table(spark, sf, "embeddings"), 0.42, id_col="vec_id", vec="embedding")
    return connected_components(pairs, "a", "b")


@query(f"""WITH RECURSIVE {SQL_CENTROID}, cl AS (SELECT label::BIGINT AS cluster_id, list(x ORDER BY dim) AS v, 'p' || (label % 4)::VARCHAR AS t FROM c GROUP BY label), e AS (SELECT * FROM (VALUES (0, 3), (3, 5), (7, 8)) t(a, b)),
 g AS (SELECT cluster_id, v, t, CASE WHEN cluster_id IN (0, 3, 5) THEN 0 WHEN cluster_id IN (7, 8) THEN 7 ELSE cluster_id END AS m FROM cl),
 tx AS (SELECT m, t FROM (SELECT m, t, row_number() OVER (PARTITION BY m ORDER BY count(*) DESC, t) AS k FROM g GROUP BY 1, 2) WHERE k = 1)
 SELECT m AS cluster_id, tx.t AS plate_text, round(avg(v[1]), 6) AS first, round(avg(v[64]), 6) AS last, (SELECT count(*) FROM embeddings f JOIN g h ON f.label = h.cluster_id WHERE h.m = g.m) AS n FROM g JOIN tx USING (m) GROUP BY 1, 2""")
def merge_clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    c = aggregates.centroid(e, ["label"], "embedding").select(F.col("label").cast("long").alias("cluster_id"), F.col("centroid").alias("centroid_vehicle"), F.col("centroid").alias("centroid_plate"), F.concat(F.lit("p"), (F.col("label") % 4).cast("string")).alias("plate_text"))
    held = e.select(F.col("label").cast("long").alias("cluster_id"), F.col("vec_id").alias("record_id"))
    pairs = spark.createDataFrame([(0, 3), (3, 5), (7, 8)], "a long, b long")
    merged, moved = merging.merge(c, held, pairs)
    n = moved.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return merged.join(n, "cluster_id").select("cluster_id", "plate_text", r6(F.col("centroid_vehicle")[0]).alias("first"), r6(F.element_at("centroid_plate", -1)).alias("last"), "n")


@query(f"WITH {SQL_TRADE} SELECT u, v, n FROM trade WHERE u <> v")
def self_loop_removal(spark: SparkSession, sf: str) -> DataFrame:
    return graph.without_self_loops(trade(spark, sf))


@query(f"""WITH {SQL_TRADE}, e AS (SELECT u, v, n::DOUBLE AS length, CASE WHEN v % 3 <> 0 THEN 10.0 + v END AS speed, u % 4 AS class FROM trade), f AS (SELECT *, coalesce(speed, avg(speed) OVER (PARTITION BY class), (SELECT avg(speed) FROM e)) AS s FROM e)
 SELECT u, v, round(s, 6) AS speed_used, round(length / s, 6) AS travel_time FROM f""")
def edge_travel_time(spark: SparkSession, sf: str) -> DataFrame:
    e = trade(spark, sf).select("u", "v", F.col("n").cast("double").alias("length"), F.when(F.col("v") % 3 != 0, 10.0 + F.col("v")).alias("speed"), (F.col("u") % 4).alias("class"))
    t = graph.with_travel_time(e, "length", "speed", "class")
    return t.select("u", "v", r6("speed_used").alias("speed_used"), r6("travel_time").alias("travel_time"))


@query(f"WITH {SQL_TRADE}, {SQL_NATIONS} SELECT u, v, sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) AS length, 2::BIGINT AS points FROM trade JOIN node a ON u = a.node_id JOIN node b ON v = b.node_id")
def edge_geometry(spark: SparkSession, sf: str) -> DataFrame:
    none = F.lit(None).cast("array<struct<x:double,y:double>>")
    g = graph.with_geometry(trade(spark, sf).select("u", "v", none.alias("geometry")), nations(spark, sf))
    p, q = F.col("geometry")[0], F.col("geometry")[1]
    return g.select("u", "v", geo.euclidean(p["x"], p["y"], q["x"], q["y"]).alias("length"), F.size("geometry").cast("long").alias("points"))


@query("""WITH n AS (SELECT n_nationkey::BIGINT AS k, n_regionkey AS r, lead(n_nationkey::BIGINT) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS o FROM nation), e AS (SELECT k AS u, o AS v FROM n WHERE o IS NOT NULL)
 SELECT min(u) AS u, max(v) AS v, sum(v - u)::DOUBLE AS length FROM e JOIN n ON e.u = n.k GROUP BY r""")
def chain_contraction(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("u"), "n_regionkey")
    chains = n.withColumn("v", F.lead("u").over(Window.partitionBy("n_regionkey").orderBy("u"))).where("v IS NOT NULL")
    return graph.simplify(chains.select("u", "v", (F.col("v") - F.col("u")).cast("double").alias("length")))


@query(f"""WITH RECURSIVE {SQL_TRADE}, fwd AS (SELECT DISTINCT u AS a, u AS b FROM (SELECT u FROM trade UNION SELECT v FROM trade) UNION SELECT fwd.a, trade.v FROM fwd JOIN trade ON fwd.b = trade.u),
 scc AS (SELECT x.a AS node, min(x.b) AS root FROM fwd x JOIN fwd y ON x.a = y.b AND x.b = y.a GROUP BY 1), top AS (SELECT root FROM scc GROUP BY root ORDER BY count(*) DESC, root LIMIT 1) SELECT node FROM scc WHERE root IN (SELECT root FROM top)""")
def largest_scc(spark: SparkSession, sf: str) -> DataFrame:
    return graph.largest_scc(trade(spark, sf))


@query("""WITH p AS (SELECT event_id % 100 AS x, value AS y, 2.5 * (event_id % 100) - 0.75 * value + 114 + 0.01 * (event_id % 7) AS lon, -1.25 * (event_id % 100) + 0.5 * value + 22 + 0.01 * (event_id % 5) AS lat FROM events),
 s AS (SELECT var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, lon) AS xu, covar_pop(y, lon) AS yu, covar_pop(x, lat) AS xv, covar_pop(y, lat) AS yv, avg(x) AS mx, avg(y) AS my, avg(lon) AS mu, avg(lat) AS mv FROM p),
 t AS (SELECT *, (xu * yy - yu * xy) / (xx * yy - xy * xy) AS a, (yu * xx - xu * xy) / (xx * yy - xy * xy) AS b, (xv * yy - yv * xy) / (xx * yy - xy * xy) AS c, (yv * xx - xv * xy) / (xx * yy - xy * xy) AS d FROM s),
 f AS (SELECT a, b, c, d, mu - a * mx - b * my AS e, mv - c * mx - d * my AS f FROM t)
 SELECT round(a, 6) AS a, round(b, 6) AS b, round(c, 6) AS c, round(d, 6) AS d, round(e, 6) AS e, round(f, 6) AS f, round(avg(sqrt(pow(a * x + b * y + e - lon, 2) + pow(c * x + d * y + f - lat, 2))), 6) AS mean_error FROM p, f GROUP BY ALL""")
def affine_fit(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    x, y, k = (F.col("event_id") % 100).cast("double"), F.col("value"), F.col("event_id")
    p = e.select(x.alias("x"), y.alias("y"), (2.5 * x - 0.75 * y + 114 + 0.01 * (k % 7)).alias("lon"), (-1.25 * x + 0.5 * y + 22 + 0.01 * (k % 5)).alias("lat"))
    return regions.fit_affine(p).select(*(r6(c).alias(c) for c in ("a", "b", "c", "d", "e", "f", "mean_error")))


@query(f"""WITH {SQL_UNIT}, d AS (SELECT a.vec_id AS id, a.label AS own, b.label AS l, sum(CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_distance(a.v, b.v) END) AS s, count(*) AS n FROM emb a, emb b GROUP BY 1, 2, 3),
 m AS (SELECT id, max(CASE WHEN own = l AND n > 1 THEN s / (n - 1) END) AS a, min(CASE WHEN own <> l THEN s / n END) AS b FROM d GROUP BY 1) SELECT round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM m""")
def silhouette(spark: SparkSession, sf: str) -> DataFrame:
    return regions.silhouette(table(spark, sf, "embeddings"), "vec_id", "embedding", "label").select(r6("silhouette").alias("silhouette"))


@query()
def kmeans_regions(spark: SparkSession, sf: str) -> DataFrame:
    n = nations(spark, sf)
    weights = records(spark, sf).groupBy("camera_id").agg(F.count("*").cast("double").alias("n"))
    cams = n.drop("region").join(weights, F.col("node_id") == F.col("camera_id"))
    return regions.kmeans_regions(cams, n.drop("region"), 4)


@query()
def pca_project(spark: SparkSession, sf: str) -> DataFrame:
    return sources.project(table(spark, sf, "embeddings"), "embedding", 16).select("vec_id", "embedding")


# --- evaluation ---


SQL_EVAL = """known AS (SELECT record_id, vehicle_id FROM rec WHERE record_id % 3 = 0), siz AS (SELECT cluster_id, count(*) AS in_cluster FROM mem GROUP BY 1), hit AS (SELECT known.vehicle_id, cluster_id, count(*) AS common FROM mem JOIN known USING (record_id) GROUP BY 1, 2),
 par AS (SELECT vehicle_id, count(*) AS parts FROM hit GROUP BY 1), top AS (SELECT vehicle_id, cluster_id, common FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY common DESC, cluster_id) AS k FROM hit) WHERE k = 1), ev AS (SELECT vehicle_id, count(*) AS of_vehicle FROM known GROUP BY 1)"""


@query(f"""WITH {SQL_CLUSTERS}, {SQL_EVAL}, s AS (SELECT avg(coalesce(common / in_cluster, 0)) AS p, avg(coalesce(common / of_vehicle, 0)) AS r, avg(coalesce(parts, 0)) AS x FROM ev LEFT JOIN top USING (vehicle_id) LEFT JOIN siz USING (cluster_id) LEFT JOIN par USING (vehicle_id))
 SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(x, 6) AS expansion FROM s""")
def eval_records_gt(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    truth = m.where("record_id % 3 = 0").select("record_id", "vehicle_id")
    return evaluation.against_records(m.select("cluster_id", "record_id"), truth).select(*(r6(c).alias(c) for c in ("precision", "recall", "f1", "expansion")))


@query(f"""WITH {SQL_CLUSTERS}, {SQL_EVAL}, tm AS (SELECT vehicle_id % 30 AS true_id, record_id FROM rec), ts AS (SELECT true_id, count(*) AS in_true FROM tm GROUP BY 1),
 th AS (SELECT vehicle_id, true_id, count(*) AS common FROM tm JOIN known USING (record_id) GROUP BY 1, 2), tt AS (SELECT vehicle_id, true_id FROM (SELECT *, row_number() OVER (PARTITION BY vehicle_id ORDER BY common DESC, true_id) AS k FROM th) WHERE k = 1),
 sh AS (SELECT cluster_id, true_id, count(*) AS both_n FROM mem JOIN tm USING (record_id) GROUP BY 1, 2), u AS (SELECT i AS vehicle_id FROM range(0, 173) t(i)),
 s AS (SELECT avg(coalesce(both_n / in_cluster, 0)) AS p, avg(coalesce(both_n / in_true, 0)) AS r, avg(coalesce(parts, 0)) AS x FROM u LEFT JOIN tt USING (vehicle_id) LEFT JOIN top USING (vehicle_id) LEFT JOIN siz USING (cluster_id) LEFT JOIN ts USING (true_id) LEFT JOIN par USING (vehicle_id) LEFT JOIN sh ON sh.cluster_id = top.cluster_id AND sh.true_id = tt.true_id)
 SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1, round(x, 6) AS expansion FROM s""")
def eval_clusters_gt(spark: SparkSession, sf: str) -> DataFrame:
    m = members(spark, sf)
    truth = m.where("record_id % 3 = 0").select("record_id", "vehicle_id")
    true_members = m.select((F.col("vehicle_id") % 30).alias("cluster_id"), "record_id")
    universe = spark.range(173).select(F.col("id").alias("vehicle_id"))
    return evaluation.against_clusters(m.select("cluster_id", "record_id"), true_members, universe, truth).select(*(r6(c).alias(c) for c in ("precision", "recall", "f1", "expansion")))


# --- clustering, map matching, files, streams ---


def _camera_records(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    i = F.col("vec_id")
    text = F.concat(F.lit("P"), (i % 17).cast("string"))
    plate = F.when(i % 3 != 0, F.slice("embedding", 33, 32))
    return e.select((F.col("label") % 4).cast("string").alias("region"), i.alias("record_id"), (i % 50).alias("vehicle_id"), (i % 25).alias("camera_id"), (i * 37 % 1000).alias("time"), F.slice("embedding", 1, 32).alias("vehicle_feature"), plate.alias("plate_feature"), F.when(plate.isNotNull(), text).alias("plate_text"))


@query()
def greedy_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_records(_camera_records(spark, sf), 20, 0.3).select("region", "record_id", "cluster_id")


@query(f"""WITH RECURSIVE {SQL_UNIT}, e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM emb a, emb b WHERE a.vec_id <> b.vec_id AND {SQL_COS.replace("a.v", "a.v[1:32]").replace("b.v", "b.v[1:32]")} > 0.62),
 w AS (SELECT vec_id AS node, vec_id AS seen FROM emb UNION SELECT w.node, e.b FROM w JOIN e ON w.seen = e.a) SELECT node AS record_id, min(seen) AS cluster_id FROM w GROUP BY 1""")
def threshold_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return clustering.cluster_by_threshold(_camera_records(spark, sf), 0.62)


@query()
def stream_clusters(spark: SparkSession, sf: str) -> DataFrame:
    from waymark.streaming.clusters import cluster_stream

    path = scratch_path(spark, "camera-records")
    _camera_records(spark, sf).repartition(2).write.parquet(path)
    return streams.run_available(cluster_stream(streams.stream_table(spark, path), 0.3), "stream-clusters")


@query()
def map_match(spark: SparkSession, sf: str) -> DataFrame:
    edges = trade(spark, sf).select("u", "v", F.col("n").cast("double").alias("length"))
    return mapmatching.map_match(_paths(spark, sf), edges, "path")


@query()
def reconstruct_centralized(spark: SparkSession, sf: str) -> DataFrame:
    from waymark.plans.reconstruct import centralized

    cams = nations(spark, sf).select(F.col("node_id").alias("camera_id"), "node_id")
    edges = ring(spark, sf).withColumn("length", F.lit(1.0))
    return centralized(_camera_records(spark, sf).drop("region"), cams, edges, 20, 0.3).select("cluster_id", "n", "plate_text", "node_path")


@query()
def reconstruct_distributed(spark: SparkSession, sf: str) -> DataFrame:
    from waymark.plans.reconstruct import distributed, partition

    n = nations(spark, sf)
    cams = n.select(F.col("node_id").alias("camera_id"), "node_id")
    edges = ring(spark, sf).withColumn("length", F.lit(1.0))
    region_nodes, region_cameras, borders = partition(n, edges, cams, n, 8, 1, 5)
    clusters, _ = distributed(_camera_records(spark, sf).drop("region"), cams, edges, region_nodes, region_cameras, borders, 20, 0.3)
    return clusters.select("cluster_id", "n", "plate_text", "node_path")


@query(f"""WITH {SQL_CLUSTERS} SELECT cluster_id, count(*) AS n, min(time) AS start, max(time) AS stop, sum(record_id)::BIGINT AS ids, NULL::VARCHAR AS plate FROM mem GROUP BY 1""")
def cluster_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    member = F.struct(F.col("record_id").cast("string").alias("record_id"), "vehicle_id", "camera_id", "time")
    none, text = F.lit(None).cast("array<float>"), F.lit(None).cast("string")
    c = members(spark, sf).groupBy("cluster_id").agg(F.array_sort(F.collect_list(member)).alias("records"))
    c = c.select("cluster_id", F.array(F.lit(0.5).cast("float")).alias("centroid_vehicle_feature"), none.alias("centroid_license_plate_feature"), text.alias("centroid_license_plate_text"), F.array().cast("array<long>").alias("node_path"), "records")
    path = scratch_path(spark, "clusters")
    sources.write_clusters(c, path)
    back = sources.read_clusters(spark, path)
    times = F.transform("records", lambda r: r["time"])
    ids = F.aggregate("records", F.lit(0).cast("long"), lambda s, r: s + r["record_id"].cast("long"))
    return back.select("cluster_id", F.size("records").cast("long").alias("n"), F.array_min(times).alias("start"), F.array_max(times).alias("stop"), ids.alias("ids"), F.col("centroid_license_plate_text").alias("plate"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = streams.windowed_counts(streams.stream_table(spark, f"{sf}/events.parquet"), "ts", "event_type")
    return streams.run_available(counts, "stream-counts", "complete")


@query(f"WITH {SQL_RECORDS} SELECT vehicle_id, count(*) AS n, min(time) AS first, max(time) AS last FROM rec GROUP BY 1")
def stream_tracks(spark: SparkSession, sf: str) -> DataFrame:
    e = streams.stream_table(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("vehicle_id"), F.expr(SECONDS).alias("time"))
    every = streams.run_available(streams.running_tracks(e, "vehicle_id", "time"), "stream-tracks", "update")
    return aggregates.best(every, ["vehicle_id"], "n", ["vehicle_id"])
