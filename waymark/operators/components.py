"""Connected components of an undirected graph given as an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.storage import Written

#: Edges that one task of a round writes at least: small graphs are not spread over as many files as there are shuffle partitions.
LEAST_EDGES = 1 << 18


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every node of an edge; component: its smallest node.

    Large-star and small-star rounds: each round hangs every node's neighbours on
    its smallest neighbour, so the depth shrinks geometrically and no node's
    neighbourhood is ever collected. Minima combine before the shuffle, and the
    joins on a node with very many edges can be split by adaptive execution.
    Each round is written to the shared folder, so a lost executor costs one round,
    in a file for LEAST_EDGES edges or more: without Hadoop's native library, a local
    file system starts two processes for each file.

    Rows with a null end are left out; self loops make a component of one node;
    repeated edges count once; no edges give no rows.
    """
    clean = edges.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    now = Written(clean.distinct(), "components")
    loops = Written(now.df.where("u = v").select(F.col("u").alias("node")), "loops")
    now_df = now.df.where("u <> v")
    mark = _mark(now_df)
    while mark[0]:
        written = lambda df, name, files=-(-mark[0] // LEAST_EDGES): Written(df.coalesce(files), name)
        both = now_df.select("u", "v").union(now_df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are written, so that both sides of the join are shuffled and hot nodes can be split
        least = written(both.groupBy("u").agg(F.min("v").alias("n")).select("u", F.least("u", "n").alias("m")), "minima")
        large = both.join(least.df, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        step = written(large, "components")
        lower = written(step.df.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = step.df.join(lower.df, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(lower.df.select("u", F.col("m").alias("v"))).distinct()
        after = written(small, "components")
        for done in (least, step, lower, now):
            done.drop()
        now, now_df = after, after.df
        seen, mark = mark, _mark(now_df)
        if seen == mark:
            break
    stars = now_df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now_df.select(F.col("v").alias("node"), F.col("v").alias("component"))
    alone = loops.df.select("node", F.col("node").alias("component"))
    return stars.union(roots).union(alone).groupBy("node").agg(F.min("component").alias("component"))
