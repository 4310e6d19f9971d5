"""Traces, node paths and distances between them, as column expressions.

The two distances that fill a table for each pair of paths run over Arrow batches;
everything else is SQL functions.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

Point = "struct<x:double,y:double>"


def trace(time: Column, record_id: Column, x: Column, y: Column) -> Column:
    """Aggregate: the points of a group of records in order of (time, record_id)."""
    ordered = F.sort_array(F.collect_list(F.struct(time.alias("t"), record_id.alias("id"), x.alias("x"), y.alias("y"))))
    return F.transform(ordered, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))


def node_path(edges: Column) -> Column:
    """The nodes along an array of edges struct<u, v>; null if it is empty or two edges do not join."""
    joins = F.forall(
        F.zip_with(F.slice(edges, F.lit(1), F.size(edges) - 1), F.slice(edges, F.lit(2), F.size(edges) - 1), lambda a, b: a["v"] == b["u"]),
        lambda same: same,
    )
    nodes = F.concat(F.transform(edges, lambda e: e["u"]), F.array(F.element_at(edges, -1)["v"]))
    return F.when((F.size(edges) > 0) & F.when(F.size(edges) > 1, joins).otherwise(True), nodes)


def path_edges(path: Column) -> Column:
    """The edges struct<u, v> along an array of nodes; empty for fewer than two."""
    n = F.size(path) - 1
    pairs = F.zip_with(F.slice(path, F.lit(1), n), F.slice(path, F.lit(2), n), lambda a, b: F.struct(a.alias("u"), b.alias("v")))
    return F.when(F.size(path) > 1, pairs).otherwise(F.filter(F.zip_with(path, path, lambda a, b: F.struct(a.alias("u"), b.alias("v"))), lambda _: F.lit(False)))


def is_valid_path(path: Column) -> Column:
    return F.coalesce(F.size(path) > 1, F.lit(False))


#: The number of points of each path, and their coordinates one after another.
Paths = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Cells of the tables that are filled together.
CELLS = 1 << 22
#: Points of a path whose column is kept as bits; longer ones fill a table.
MOST_BITS = 512


def _tables(a: pa.Array, b: pa.Array, epsilon: float, kind: str) -> np.ndarray:
    """The last cell of a dynamic program over the points of each pair of paths, many pairs at a time.

    Rows are points of a, columns points of b. What a cell takes from its left
    neighbour is a running maximum (kind lcss) or minimum (edr) along the row, so a
    row is filled at once. Shorter paths are padded; their cells are not read.
    """
    return _fill(_points(a), _points(b), epsilon, kind)


def _fill(a: Paths, b: Paths, epsilon: float, kind: str) -> np.ndarray:
    (na, ax, ay), (nb, bx, by) = a, b
    out = np.zeros(len(na))
    begin = 0
    order = np.argsort(np.maximum(na, nb), kind="stable")
    while begin < len(order):
        end = len(order)
        while end - begin > 1 and (end - begin) * (nb[order[begin:end]].max() + 1) > CELLS:
            end = (begin + end) // 2
        some, begin = order[begin:end], end
        m = int(nb[some].max(initial=0))
        column = np.arange(m + 1)
        ends = np.minimum(column[:-1], np.maximum(nb[some] - 1, 0)[:, None])
        first = (np.cumsum(nb) - nb)[some]
        qx, qy = (v[np.minimum(first[:, None] + ends, len(v) - 1)] if len(v) else np.zeros(ends.shape) for v in (bx, by))
        old = np.tile(column if kind == "edr" else np.zeros(m + 1, np.int64), (len(some), 1))
        start = (np.cumsum(na) - na)[some]
        for i in range(int(na[some].max(initial=0))):
            live = np.flatnonzero(na[some] > i)
            px, py = ax[start[live] + i][:, None], ay[start[live] + i][:, None]
            near = np.sqrt((px - qx[live]) ** 2 + (py - qy[live]) ** 2) <= epsilon
            was, row = old[live], np.empty((len(live), m + 1), np.int64)
            if kind == "lcss":
                row[:, 0] = 0
                row[:, 1:] = np.maximum(was[:, 1:], was[:, :-1] + near)
                old[live] = np.maximum.accumulate(row, axis=1)
            else:
                row[:, 0] = i + 1
                row[:, 1:] = np.minimum(was[:, 1:] + 1, was[:, :-1] + ~near)
                old[live] = np.minimum.accumulate(row - column, axis=1) + column
        out[some] = old[np.arange(len(some)), nb[some]]
    return out


def _points(paths: pa.Array) -> Paths:
    flat = paths.flatten()
    x, y = (pc.struct_field(flat, n).cast(pa.float64()).to_numpy(zero_copy_only=False) for n in ("x", "y"))
    return pc.list_value_length(paths).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), x, y


def ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... for each range, one after another."""
    return np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)


def places(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct places, and the number of each point's."""
    (xs, i), (ys, j) = np.unique(x, return_inverse=True), np.unique(y, return_inverse=True)
    code, which = np.unique(i * max(len(ys), 1) + j, return_inverse=True)
    return xs[code // max(len(ys), 1)], ys[code % max(len(ys), 1)], which


def _ripple(total: np.ndarray, over: np.ndarray) -> None:
    """Carry what each word of a sum (rows, the lowest first) ran over into the next."""
    for k in range(1, len(total)):
        total[k] += over[k - 1]
        if k + 1 < len(total):
            over[k] |= total[k] < over[k - 1]


def _bits(x: np.ndarray, y: np.ndarray, paths: Paths, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """The longest common subsequence and the edit distance of one path with each of ``paths``, as of ``_tables``.

    A column of each table is kept by the differences of its neighbours, a bit for
    each point of a short path (Hyyrö; Myers), and all short paths take a step along
    the long one together. Words of bits are rows, the lowest first.
    """
    n, px, py = paths
    words = -(-int(n.max(initial=1)) // 64)
    inside = np.arange(64 * words) < n[:, None]
    qx, qy = np.full(inside.shape, np.nan), np.full(inside.shape, np.nan)
    qx[inside], qy[inside] = px, py
    pack = lambda b: np.packbits(b, axis=-1, bitorder="little").view("<u8").swapaxes(-1, -2)
    shape, one, top = (words, len(n)), np.uint64(1), np.uint64(63)
    v, up, down = np.full(shape, ~np.uint64(0)), np.full(shape, ~np.uint64(0)), np.zeros(shape, np.uint64)
    u, s, xh, ph, over = np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, np.uint64), np.empty(shape, bool)
    # steps whose distinct places are compared together
    some = max(1, CELLS // max(inside.size, 1))
    begin = 0
    while begin < len(x):
        tx, ty, which = places(x[begin : begin + 64 * some], y[begin : begin + 64 * some])
        first = np.full(len(tx), len(which))
        np.minimum.at(first, which, np.arange(len(which)))
        # up to the step at which the place after the last of ``some`` is first met
        end = len(which) if len(tx) <= some else int(np.partition(first, some)[some])
        used, which = np.unique(which[:end], return_inverse=True)
        masks = np.ascontiguousarray(pack(np.sqrt((qx - tx[used, None, None]) ** 2 + (qy - ty[used, None, None]) ** 2) <= epsilon))
        for k in which.tolist():
            m = masks[k]
            np.bitwise_and(v, m, out=u)
            np.add(v, u, out=s)
            if words > 1:
                np.less(s, u, out=over)
                _ripple(s, over)
            v ^= u
            v |= s
            np.bitwise_and(up, m, out=u)
            np.add(u, up, out=s)
            if words > 1:
                np.less(s, u, out=over)
                _ripple(s, over)
            np.bitwise_xor(s, up, out=xh)
            xh |= m
            np.bitwise_or(xh, up, out=ph)
            np.invert(ph, out=ph)
            ph |= down
            xh &= up
            # m | down is kept in u, as down is made anew; a cell's left neighbour of the first row is one less
            np.bitwise_or(m, down, out=u)
            np.left_shift(ph, one, out=s)
            np.left_shift(xh, one, out=up)
            if words > 1:
                s[1:] |= ph[:-1] >> top
                up[1:] |= xh[:-1] >> top
            s[0] |= one
            np.bitwise_and(s, u, out=down)
            u |= s
            np.invert(u, out=u)
            up |= u
        begin += end
    ones = lambda b: np.bitwise_count(b & pack(inside)).sum(0, dtype=np.int64)
    return ones(~v), len(x) + ones(up) - ones(down)


def against_one(x: np.ndarray, y: np.ndarray, paths: Paths, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """LCSS and EDR distances, as ``lcss_distance`` and ``edr_distance``, of one path with each of many; NaN where either is empty."""
    n, px, py = paths
    common, edits = np.zeros(len(n)), np.zeros(len(n))
    first = np.cumsum(n) - n

    def chosen(at: np.ndarray) -> Paths:
        points = ranges(first[at], n[at])
        return n[at], px[points], py[points]

    width = np.where(n > 0, np.ceil(np.log2(np.maximum(n, 64) / 64)), -1)
    width[n > MOST_BITS] = -2
    for w in np.unique(width[width >= 0]):
        at = np.flatnonzero(width == w)
        common[at], edits[at] = _bits(x, y, chosen(at), epsilon)
    long = np.flatnonzero(width == -2)
    each = max(1, CELLS // max(len(x), 1))
    for k in range(0, len(long), each):
        at = long[k : k + each]
        sides = [(np.full(len(at), len(x)), np.tile(x, len(at)), np.tile(y, len(at))), chosen(at)]
        # steps go along the shorter one
        sides.sort(key=lambda p: int(p[0].max()))
        common[at], edits[at] = _fill(*sides, epsilon, "lcss"), _fill(*sides, epsilon, "edr")
    empty = np.minimum(n, len(x)) == 0
    shorter, longer = np.where(empty, np.nan, np.minimum(n, len(x))), np.where(empty, np.nan, np.maximum(n, len(x)))
    return 1 - common / shorter, edits / longer


#: Beyond this distance exp(-distance) is 0.
FAR = 746.0


def similarity_in_time(a: np.ndarray, b: np.ndarray) -> float:
    """The sum over ``a`` of exp(-distance to the nearest of ``b``); both ascending."""
    if not len(a) or not len(b):
        return 0.0
    if len(a) <= len(b):
        at = np.searchsorted(b, a)
        return float(np.exp(-np.minimum(np.abs(a - b[np.maximum(at - 1, 0)]), np.abs(a - b[np.minimum(at, len(b) - 1)]))).sum())
    # the part of ``a`` that each of ``b`` is nearest to, as far as it counts
    middle = (b[1:] + b[:-1]) / 2
    begin = np.searchsorted(a, np.maximum(np.r_[-np.inf, middle], b - FAR))
    size = np.maximum(np.searchsorted(a, np.minimum(np.r_[middle, np.inf], b + FAR)) - begin, 0)
    return float(np.exp(-np.abs(a[ranges(begin, size)] - np.repeat(b, size))).sum())


def similarity_in_space(a: Paths, b: Paths) -> tuple[float, float]:
    """For places with the number of points at each: the sum over points of ``a`` of exp(-distance to the nearest of ``b``), and the reverse."""
    (na, ax, ay), (nb, bx, by) = a, b
    to_a, to_b, each = np.full(len(na), np.inf), np.full(len(nb), np.inf), max(1, CELLS // max(len(nb), 1))
    if len(nb):
        for k in range(0, len(na), each):
            far = np.sqrt((ax[k : k + each, None] - bx) ** 2 + (ay[k : k + each, None] - by) ** 2)
            to_a[k : k + each] = np.fmin.reduce(far, axis=1)
            to_b = np.fmin(to_b, np.fmin.reduce(far, axis=0))
    # a point without a place (NaN) is near to none
    return tuple(float((n * np.exp(-np.where(np.isnan(d), np.inf, d))).sum()) for n, d in ((na, to_a), (nb, to_b)))


def _distance(kind: str, epsilon: float) -> Callable[[Column, Column], Column]:
    @F.arrow_udf("double")
    def distance(a: pa.Array, b: pa.Array) -> pa.Array:
        n, m = (pc.list_value_length(v).fill_null(0).to_numpy(zero_copy_only=False) for v in (a, b))
        last, real = _tables(a, b, epsilon, kind), (n > 0) & (m > 0)
        size = np.where(real, np.minimum(n, m) if kind == "lcss" else np.maximum(n, m), 1)
        return pa.array(1 - last / size if kind == "lcss" else last / size, mask=~real)

    return distance


def lcss_distance(a: Column, b: Column, epsilon: float) -> Column:
    """1 - longest common subsequence / shorter length; points within epsilon match. Null if either is null or empty."""
    return _distance("lcss", epsilon)(a, b)


def edr_distance(a: Column, b: Column, epsilon: float) -> Column:
    """Edit distance on real sequences / longer length; points within epsilon are equal. Null if either is null or empty."""
    return _distance("edr", epsilon)(a, b)
