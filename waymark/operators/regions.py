"""Partitioning of the road network, and fits on its points."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kmeans_regions(cameras: DataFrame, nodes: DataFrame, k: int, weight: str = "n", seed: int = 666) -> DataFrame:
    """``(node_id, region)``: nodes by the nearest of k centres, fitted on cameras (x, y) weighted by their records."""
    assemble = VectorAssembler(inputCols=["x", "y"], outputCol="features")
    fitted = KMeans(k=k, seed=seed, weightCol=weight, featuresCol="features", predictionCol="region").fit(assemble.transform(cameras))
    return fitted.transform(assemble.transform(nodes)).select("node_id", "region")


def region_tables(node_regions: DataFrame, aux_nodes: DataFrame, cameras: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``region_nodes`` (region, is_auxiliary, node_id) and ``region_cameras`` (region, is_auxiliary, camera_id)."""
    main = node_regions.select(F.col("region").cast("string").alias("region"), F.lit(False).alias("is_auxiliary"), "node_id")
    nodes = main.unionByName(aux_nodes.select("region", F.lit(True).alias("is_auxiliary"), "node_id"))
    return nodes, nodes.join(cameras.select("camera_id", "node_id"), "node_id").select("region", "is_auxiliary", "camera_id")


def silhouette(points: DataFrame, id_col: str, vec: str, label: str) -> DataFrame:
    """``silhouette``: mean silhouette with Euclidean distances, every point against every point in tiles.

    A point alone in its label counts 0; with one label there is no value.
    """
    import numpy as np
    import pyarrow as pa

    from waymark.operators.knn import matrix

    n = max(1, -(-points.count() // 4096))
    base = points.select(F.col(id_col).alias("id"), F.col(vec).cast("array<double>").alias("v"), F.col(label).cast("long").alias("l"))
    block = F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    q = base.withColumn("qb", block).withColumn("bb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    b = base.withColumn("bb", block).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds = {"id": pa.int64(), "own": pa.int64(), "l": pa.int64(), "total": pa.float64(), "n": pa.int64()}
        if not left.num_rows or not right.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        x, y = matrix(left.column("v")), matrix(right.column("v"))
        ids, own, labels = left.column("id").to_numpy(), left.column("l").to_numpy(), right.column("l").to_numpy()
        out = []
        for s in range(0, len(x), 256):
            part = x[s : s + 256]
            d = np.sqrt(np.maximum(0, (part * part).sum(1)[:, None] - 2 * part @ y.T + (y * y).sum(1)))
            d[ids[s : s + 256, None] == right.column("id").to_numpy()[None, :]] = 0.0
            for k in np.unique(labels):
                at = labels == k
                m = len(part)
                out.append((ids[s : s + 256], own[s : s + 256], np.full(m, k), d[:, at].sum(1), np.full(m, int(at.sum()))))
        return pa.table(dict(zip(kinds, map(np.concatenate, zip(*out, strict=True)), strict=True)))

    sums = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(work, "id long, own long, l long, total double, n long")
    each = sums.groupBy("id", "own", "l").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    inner = F.max(F.when(F.col("l") == F.col("own"), F.when(F.col("n") > 1, F.col("total") / (F.col("n") - 1)))).alias("a")
    outer = F.min(F.when(F.col("l") != F.col("own"), F.col("total") / F.col("n"))).alias("b")
    s = each.groupBy("id").agg(inner, outer)
    value = F.when(F.col("b").isNull(), None).when(F.col("a").isNull(), 0.0).otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b"))
    return s.agg(F.avg(value).alias("silhouette"))


def fit_affine(pairs: DataFrame) -> DataFrame:
    """``(a, b, c, d, e, f, mean_error)`` of the least-squares map lon = a x + b y + e, lat = c x + d y + f.

    Normal equations on centred sums: one aggregation over pairs (x, y, lon, lat).
    """
    m = pairs.agg(*(F.avg(c).alias(f"m_{c}") for c in ("x", "y", "lon", "lat")))
    z = pairs.crossJoin(F.broadcast(m)).select(*(F.col(c) - F.col(f"m_{c}") for c in ("x", "y", "lon", "lat"))).toDF("x", "y", "u", "v")
    s = z.agg(*(F.sum(F.col(p) * F.col(q)).alias(p + q) for p, q in ("xx", "yy", "xy", "xu", "yu", "xv", "yv")))
    det = F.col("xx") * F.col("yy") - F.col("xy") * F.col("xy")
    solve = lambda p, q: ((F.col(p) * F.col("yy") - F.col(q) * F.col("xy")) / det, (F.col(q) * F.col("xx") - F.col(p) * F.col("xy")) / det)
    (a, b), (c, d) = solve("xu", "yu"), solve("xv", "yv")
    fit = s.crossJoin(m).select(a.alias("a"), b.alias("b"), c.alias("c"), d.alias("d"), "m_x", "m_y", "m_lon", "m_lat")
    fit = fit.select("a", "b", "c", "d", (F.col("m_lon") - F.col("a") * F.col("m_x") - F.col("b") * F.col("m_y")).alias("e"), (F.col("m_lat") - F.col("c") * F.col("m_x") - F.col("d") * F.col("m_y")).alias("f"))
    off = F.sqrt(F.pow(F.col("a") * F.col("x") + F.col("b") * F.col("y") + F.col("e") - F.col("lon"), F.lit(2)) + F.pow(F.col("c") * F.col("x") + F.col("d") * F.col("y") + F.col("f") - F.col("lat"), F.lit(2)))
    return pairs.crossJoin(F.broadcast(fit)).groupBy("a", "b", "c", "d", "e", "f").agg(F.avg(off).alias("mean_error"))
