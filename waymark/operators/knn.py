"""Exact nearest neighbours and similarity pairs of vectors, in tiles.

Both sides are cut into blocks of bounded size; a tile, a block of queries
against a block of the base, is a matrix product in a task, and only each
query's best hits leave it, as one row. A second step merges the tiles' hits of
a few queries at a time. No side is broadcast and no task holds more than two
blocks, at any input size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Vectors of a block of queries, and of a block of the base.
BLOCK = 4096
BASE_BLOCK = 32768
#: Groups in which a block's queries are merged.
MERGES = 16

_LISTS = "g string, id long, neighbors array<long>, similarities array<double>"


def _clean(df: DataFrame, id_col: str, vector_col: str, by: str | None) -> DataFrame:
    group = (F.col(by) if by else F.lit("")).cast("string").alias("g")
    return df.select(group, F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))


def _count(df: DataFrame, block: int) -> int:
    return max(1, -(-df.count() // block))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of equal length as the rows of a matrix."""
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    v = matrix(table.column("v"))
    return table.column("id").to_numpy(), v / np.linalg.norm(v, axis=1, keepdims=True)


def _tiles(queries: DataFrame, base: DataFrame, ids: tuple[str, str], features: tuple[str, str], by: str | None, work, schema: str) -> DataFrame:
    """``work`` over each block of queries and block of the base of a group; a group has as many blocks as its own rows need."""
    q, b = _clean(queries, ids[0], features[0], by), _clean(base, ids[1], features[1], by)
    blocks = lambda df, n, name: df.groupBy("g").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    counts = blocks(q, BLOCK, "_nq").join(blocks(b, BASE_BLOCK, "_nb"), "g")
    block = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    q = q.join(counts, "g").select("g", "id", "v", block("_nq").alias("qb"), every("_nb").alias("bb"))
    b = b.join(counts, "g").select("g", "id", "v", block("_nb").alias("bb"), every("_nq").alias("qb"))
    return q.groupBy("g", "qb", "bb").cogroup(b.groupBy("g", "qb", "bb")).applyInArrow(work, schema)


def _lists(g: str | None, ids: np.ndarray, count: np.ndarray, neighbors: np.ndarray, sims: np.ndarray) -> pa.Table:
    off = pa.array(np.r_[0, np.cumsum(count)].astype(np.int32))
    columns = [pa.array([g] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.ListArray.from_arrays(off, pa.array(neighbors, pa.int64())), pa.ListArray.from_arrays(off, pa.array(sims, pa.float64()))]
    return pa.table(columns, names=["g", "id", "neighbors", "similarities"])


def knn_lists(queries: DataFrame, base: DataFrame, k: int, *, q_id: str = "id", b_id: str = "id", q_vec: str = "feature", b_vec: str = "feature", by: str | None = None) -> DataFrame:
    """``(g, id, neighbors, similarities)``: the k vectors of ``base`` with the greatest cosine to each query, best first.

    by: a column of both sides; neighbours are sought among rows with an equal
    value, which comes back as ``g`` (empty without ``by``); a null is none. A vector that is in both is its own
    neighbour; lists are shorter than k if ``base`` is. Ties go to the smaller
    neighbor. Null and zero vectors are in neither side. Ids are integers.
    """

    def tile(q: pa.Table, b: pa.Table) -> pa.Table:
        none = np.zeros(0, np.int64)
        if not q.num_rows or not b.num_rows:
            return _lists(None, none, none, none, none.astype(float))
        (qi, qv), (bi, bv) = _unit(q), _unit(b)
        count, out = [], []
        for s in range(0, len(qi), 128):
            sim = qv[s : s + 128] @ bv.T
            # of those that reach the k-th similarity, the k best leave the tile, ties by the smaller neighbour as over all tiles
            least = np.partition(sim, len(bi) - k, axis=1)[:, len(bi) - k] if len(bi) > k else np.full(len(sim), -np.inf)
            i, j = np.nonzero(sim >= least[:, None])
            order = np.lexsort((bi[j], -sim[i, j], i))
            i, j = i[order], j[order]
            first = np.searchsorted(i, np.arange(len(sim)))
            kept = np.arange(len(i)) - first[i] < k
            i, j = i[kept], j[kept]
            count.append(np.bincount(i, minlength=len(sim)))
            out.append((bi[j], sim[i, j]))
        neighbors, sims = map(np.concatenate, zip(*out, strict=True))
        return _lists(q.column("g")[0].as_py(), qi, np.concatenate(count), neighbors, sims)

    def merge(table: pa.Table) -> pa.Table:
        lists = table.column("neighbors").combine_chunks()
        ids = np.repeat(table.column("id").to_numpy(), np.diff(lists.offsets.to_numpy()))
        neighbors, sims = lists.flatten().to_numpy(), table.column("similarities").combine_chunks().flatten().to_numpy()
        order = np.lexsort((neighbors, -sims, ids))
        ids, neighbors, sims = ids[order], neighbors[order], sims[order]
        new = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
        size = np.diff(np.r_[new, len(ids)])
        kept = np.arange(len(ids)) - np.repeat(new, size) < k
        return _lists(table.column("g")[0].as_py(), ids[new], np.minimum(size, k), neighbors[kept], sims[kept])

    hits = _tiles(queries, base, (q_id, b_id), (q_vec, b_vec), by, tile, _LISTS)
    part = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(MERGES * _count(queries, BLOCK)))
    return hits.withColumn("_p", part).groupBy("g", "_p").applyInArrow(lambda t: merge(t.drop(["_p"])), _LISTS)


def knn_join(queries: DataFrame, base: DataFrame, k: int, *, q_id: str = "id", b_id: str = "id", q_vec: str = "feature", b_vec: str = "feature", by: str | None = None) -> DataFrame:
    """``(id, neighbor, similarity, rank)``, with ``g`` if ``by``: knn_lists as rows, rank from 1."""
    lists = knn_lists(queries, base, k, q_id=q_id, b_id=b_id, q_vec=q_vec, b_vec=b_vec, by=by)
    each = lists.select("g", "id", F.posexplode(F.arrays_zip("neighbors", "similarities")).alias("p", "h"))
    rows = each.select("g", "id", F.col("h.neighbors").alias("neighbor"), F.col("h.similarities").alias("similarity"), (F.col("p") + 1).alias("rank"))
    return rows if by else rows.drop("g")


def similar_pairs(vectors: DataFrame, threshold: float, *, id_col: str = "id", vec: str = "feature", spanning: bool = False) -> DataFrame:
    """``(a, b, similarity)`` with a < b of all pairs with a cosine above ``threshold``.

    spanning: only as many of them as join what the pairs of a tile join, for
    components: no more rows than vectors leave a tile, however dense it is.
    """

    def work(q: pa.Table, b: pa.Table) -> pa.Table:
        if not q.num_rows or not b.num_rows:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64()), "similarity": pa.array([], pa.float64())})
        (qi, qv), (bi, bv) = _unit(q), _unit(b)
        sim = qv @ bv.T
        i, j = np.nonzero((sim > threshold) & (qi[:, None] < bi[None, :]))
        if spanning:
            some = _forest(qi[i], bi[j])
            i, j = i[some], j[some]
        return pa.table({"a": qi[i], "b": bi[j], "similarity": sim[i, j]})

    return _tiles(vectors, vectors, (id_col, id_col), (vec, vec), None, work, "a long, b long, similarity double")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of edges that form a spanning forest of all of them, by rounds of hooking each component on its smallest neighbour."""
    names, ends = np.unique(np.r_[a, b], return_inverse=True)
    u, v = ends[: len(a)], ends[len(a) :]
    label, chosen = np.arange(len(names)), [np.zeros(0, np.int64)]
    while (open_ := np.flatnonzero(label[u] != label[v])).size:
        x, y = label[u[open_]], label[v[open_]]
        high, low = np.maximum(x, y), np.minimum(x, y)
        # of each component's edges to smaller ones, that to the smallest
        order = np.lexsort((open_, low, high))
        one = order[np.r_[True, high[order][1:] != high[order][:-1]]]
        chosen.append(open_[one])
        label_of = np.arange(len(names))
        label_of[high[one]] = low[one]
        while (label_of[label_of] != label_of).any():
            label_of = label_of[label_of]
        label = label_of[label]
    return np.sort(np.concatenate(chosen))


def candidate_lists(records: DataFrame, k: int, features: tuple[str, ...], id_col: str = "id", by: str | None = None) -> DataFrame:
    """``(g, id, candidates)``: the union over features of each record's k nearest, without itself, in ascending order."""
    kinds = F.explode(F.array(*(F.struct(F.lit(f"{i}|").alias("kind"), F.col(f).cast("array<double>").alias("feature")) for i, f in enumerate(features))))
    group = F.col(by).cast("string") if by else F.lit("")
    long = records.select(group.alias("g"), F.col(id_col).alias("id"), kinds.alias("k")).select(F.concat("k.kind", "g").alias("kg"), "id", "k.feature")
    hits = knn_lists(long, long, k, by="kg").select(F.regexp_replace("g", r"^\d+\|", "").alias("g"), "id", "neighbors")
    together = hits.groupBy("g", "id").agg(F.flatten(F.collect_list("neighbors")).alias("n"))
    return together.select("g", "id", F.array_sort(F.array_remove(F.array_distinct("n"), F.col("id"))).alias("candidates"))


def candidates(records: DataFrame, k: int, features: tuple[str, ...], id_col: str = "id", by: str | None = None) -> DataFrame:
    """``(id, candidate)``, with ``g`` if ``by``: candidate_lists as rows."""
    found = candidate_lists(records, k, features, id_col, by).select("g", "id", F.explode("candidates").alias("candidate"))
    return found if by else found.drop("g")
