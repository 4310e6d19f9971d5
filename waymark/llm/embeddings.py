"""Near-duplicate vectors by an inverted multi-index.

Two codebooks, learned apart on the two halves of the vectors, form a product
grid of cells; a vector is a member of the cell of its two nearest codewords. A
query orders the codewords of each half by its squared distance to their regions'
borders (0 for its own) and traverses the two sequences together: cells come in
the order of the sum, nearest first, and the visit stops after as many cells as
reach the target recall. That number is measured when the index is fitted, on
pairs of sampled vectors that are as similar as asked: a pair counts as found if
either visits the other's cell. What is visited is verified exactly.

The codebooks are fitted on SAMPLE vectors at most; every vector is indexed and
every vector is a query. Vectors that are equal are one entry with a weight. Both
codebooks grow with the number of vectors, so that a cell holds about CELL of them,
and a query is sent to the cells it visits and to no others. Cells with many members
are cut into chunks, and so are their queries, so no group gets more than CHUNK of
either. Vectors of different widths have indexes of their own; those of a width with
INDEXED vectors or fewer are a single cell. Vectors travel as they came, at single precision
if they came so; lengths and cosines are computed in double.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from waymark.llm.flat import give_back
from waymark.operators.components import connected_components
from waymark.storage import Written

SAMPLE = 8192
CHUNK = 8192
INDEXED = 512
RECALL = 0.999
#: Codewords of a half, at most: with it the driver's table of crowded cells has a bound, too.
MOST_CODEWORDS = 1024
#: Vectors of a cell, about.
CELL = 128
#: Cells that a query visits at least, and at most.
LEAST_VISITS, MOST_VISITS = 8, 512
#: Pairs in the sample below which recall is measured on made-up pairs at exactly the threshold.
ENOUGH_PAIRS = 100

_log = logging.getLogger(__name__)
_UNIT = "vec_id long, unit binary"
_MESSAGE = "w int, cell int, m int, q int, kind int, head long, weight long, unit binary"


def _units(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a valid vector, as bytes; vectors whose length can't be told in double precision are scaled."""
        for b in batches:
            vectors = b.column("embedding")
            size = pc.list_value_length(vectors).fill_null(0).to_numpy()
            v = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            row = np.repeat(np.arange(len(size)), size)
            good = (size > 0) & b.column("vec_id").is_valid().to_numpy(zero_copy_only=False)
            good &= np.bincount(row[~np.isfinite(v)], minlength=len(size)) == 0
            good &= np.bincount(row[v != 0], minlength=len(size)) > 0
            v, size, ids = v[good[row]], size[good], b.column("vec_id").filter(pa.array(good))
            row = np.repeat(np.arange(len(size)), size)
            first = np.cumsum(size) - size
            most = np.maximum.reduceat(np.abs(v), first) if len(size) else np.zeros(0)
            with np.errstate(over="ignore", under="ignore"):
                far = np.sqrt(np.bincount(row, weights=v * v, minlength=len(size)))
            scale = np.where((far > 1e-150) & (far < np.inf), 1.0, most)
            data = (v / scale[row]).astype(kind)
            at = np.r_[0, np.cumsum(size)].astype(np.int32) * data.itemsize
            unit = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(data.tobytes())])
            yield pa.RecordBatch.from_arrays([ids, unit], names=["vec_id", "unit"])

    return run


def _stack(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Vectors of one width as rows, scaled to length 1 in double precision."""
    parts = column.to_pylist()
    x = np.frombuffer(b"".join(parts), kind).reshape(len(parts), -1).astype(np.float64) if parts else np.zeros((0, 1))
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1))


def _codebook(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(12):
        own = _distances(x, c).argmin(1)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


@dataclass
class Index:
    books: tuple[np.ndarray, np.ndarray]
    #: Cells that a query visits.
    visits: int
    #: Share of the measured pairs that are found with it.
    recall: float = 1.0

    def borders(self, x: np.ndarray) -> list[np.ndarray]:
        """Of each half: the squared distance to every codeword's region, 0 for the own one."""
        cut, out = self.books[0].shape[1], []
        for half, c in zip((x[:, :cut], x[:, cut:]), self.books, strict=True):
            d = _distances(half, c)
            k = d.argmin(1)
            between = np.sqrt(_distances(c, c))[k]
            gap = d - d[np.arange(len(d)), k][:, None]
            border = np.divide(gap, 2 * between, out=np.zeros_like(gap), where=between > 1e-12) ** 2
            # rounded, so that the order does not hang on the batch that a vector is in; the own region comes first
            border = np.round(border, 9)
            border[np.arange(len(d)), k] = -1.0
            out.append(border)
        return out

    def traverse(self, x: np.ndarray, visits: int) -> np.ndarray:
        """The nearest cells of each vector, its own first: the start of a multi-sequence traversal.

        A cell at places i and j of the two sequences comes after the (i + 1) * (j + 1) - 1
        cells at no later ones, so the first ``visits`` are among few.
        """
        sequences, gaps = [], []
        for border in self.borders(x):
            near = np.argsort(border, axis=1, kind="stable")[:, :visits]
            sequences.append(near)
            gaps.append(np.maximum(np.take_along_axis(border, near, 1), 0))
        i, j = (k.ravel() for k in np.indices((sequences[0].shape[1], sequences[1].shape[1])))
        some = (i + 1) * (j + 1) <= visits
        i, j = i[some], j[some]
        order = np.argsort(gaps[0][:, i] + gaps[1][:, j], axis=1, kind="stable")[:, :visits]
        return np.take_along_axis(sequences[0][:, i] * len(self.books[1]) + sequences[1][:, j], order, 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros((0, min(self.visits, len(self.books[0]) * len(self.books[1]))), np.int64), *(self.traverse(x[i : i + 1024], self.visits) for i in range(0, len(x), 1024))])

    @staticmethod
    def single(width: int) -> Index:
        return Index((np.zeros((1, width // 2)), np.zeros((1, width - width // 2))), 1)

    @staticmethod
    def fit(sample: np.ndarray, codewords: int, cosine: float, recall: float) -> Index:
        rng = np.random.default_rng(11)
        sample = sample[np.lexsort(sample.T[::-1])]
        cut = sample.shape[1] // 2
        k = max(1, min(codewords, len(np.unique(sample, axis=0))))
        index = Index((_codebook(sample[:, :cut], k, rng), _codebook(sample[:, cut:], k, rng)), 1)
        most = min(MOST_VISITS, k * k)
        # a partner of each sampled vector that has one
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for s in range(0, len(sample), 1024):
            near = sample[s : s + 1024] @ sample.T >= cosine
            near[np.arange(len(near)), np.arange(s, s + len(near))] = False
            some = np.flatnonzero(near.any(1))
            a.append(some + s)
            b.append((near[some] * rng.random((len(some), len(sample)))).argmax(1))
        x, y = sample[np.concatenate(a)], sample[np.concatenate(b)]
        if len(x) < ENOUGH_PAIRS:
            z = sample[rng.choice(len(sample), 4096)]
            r = rng.normal(size=z.shape)
            r -= (r * z).sum(1)[:, None] * z
            long = np.linalg.norm(r, axis=1, keepdims=True)
            x, y = np.r_[x, z], np.r_[y, np.where(long > 1e-12, cosine * z + np.sqrt(1 - cosine**2) * r / np.maximum(long, 1e-12), z)]
        # the place of each partner's cell in the other's traversal, whichever comes first
        place = np.full(len(x), most)
        for s in range(0, len(x), 1024):
            u, v = (index.traverse(z[s : s + 1024], most) for z in (x, y))
            for one, other in ((u, v), (v, u)):
                hit = one == other[:, :1]
                place[s : s + 1024] = np.minimum(place[s : s + 1024], np.where(hit.any(1), hit.argmax(1), most))
        index.visits = int(min(most, max(LEAST_VISITS, np.quantile(place, recall, method="higher") + 1)))
        index.recall = float((place < index.visits).mean())
        return index


def _by_width(batch: pa.RecordBatch, kind: type) -> Iterator[tuple[int, pa.RecordBatch]]:
    width = pc.binary_length(batch.column("unit")).to_numpy() // np.dtype(kind).itemsize
    for w in np.unique(width):
        yield int(w), batch.filter(pa.array(width == w))


def _count(shared, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Members and queries of each cell."""
        for b in batches:
            for w, part in _by_width(b, kind):
                index = shared.value.get(w) or Index.single(w)
                visits = index.cells(_stack(part.column("unit"), kind))
                cell, which = np.unique(visits, return_inverse=True)
                which = which.reshape(visits.shape)
                members, queries = np.bincount(which[:, 0], minlength=len(cell)), np.bincount(which.ravel(), minlength=len(cell))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), w), pa.int32()), pa.array(cell, pa.int32()), pa.array(members, pa.int64()), pa.array(queries, pa.int64())], names=["w", "cell", "members", "queries"])

    return run


def _deal(shared, crowded, kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as a member, and as a query of each cell it visits; once for each chunk of the other kind."""
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                for w, part in _by_width(b.slice(i, 1024), kind):
                    index = shared.value.get(w) or Index.single(w)
                    visits = index.cells(_stack(part.column("unit"), kind))
                    cell = np.r_[visits[:, 0], visits.ravel()]
                    who = np.r_[np.arange(len(visits)), np.repeat(np.arange(len(visits)), visits.shape[1])]
                    asks = np.r_[np.zeros(len(visits), np.int64), np.ones(visits.size, np.int64)]
                    names, counts = crowded.value.get(w, (np.zeros(1, np.int64) - 1, np.ones((2, 1), np.int64)))
                    at = np.minimum(np.searchsorted(names, cell), len(names) - 1)
                    chunks = np.where(names[at] == cell, counts[:, at], 1)
                    head = part.column("head").to_numpy()
                    spread = (head.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)[who]
                    # a member has its own chunk of members and meets all chunks of queries; a query the other way round
                    own, times = np.where(asks == 0, chunks[0], chunks[1]), np.where(asks == 0, chunks[1], chunks[0])
                    copy = np.repeat(np.arange(len(cell)), times)
                    other = np.arange(len(copy)) - np.repeat(np.cumsum(times) - times, times)
                    mine = (spread % own)[copy]
                    m, q = np.where(asks[copy] == 0, mine, other), np.where(asks[copy] == 0, other, mine)
                    take = pa.array(who[copy])
                    columns = [np.full(len(copy), w), cell[copy], m, q, asks[copy]]
                    yield pa.RecordBatch.from_arrays([*(pa.array(v, pa.int32()) for v in columns), *(part.column(n).take(take) for n in ("head", "weight", "unit"))], names=["w", "cell", "m", "q", "kind", "head", "weight", "unit"])

    return run


def _verify(shared, kind: type, cosine: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of a cell's members with its queries, counted, and the components of these links here, by a star each."""
        give_back()
        index: Index = shared.value.get(table.column("w")[0].as_py()) or Index.single(1)
        cell = table.column("cell")[0].as_py()
        asks = table.column("kind").to_numpy()
        head, weight, x = table.column("head").to_numpy(), table.column("weight").to_numpy(), _stack(table.column("unit"), kind)
        q, m = np.flatnonzero(asks == 1), np.flatnonzero(asks == 0)
        q, m = q[np.argsort(head[q])], m[np.argsort(head[m])]
        many = len(index.books[0]) * len(index.books[1]) > 1
        # the cells that queries come from, and whether each member visits them
        home, own = np.unique(index.cells(x[q])[:, 0], return_inverse=True) if many else (np.full(1, cell), np.zeros(len(q), np.int64))
        visited = np.full((len(m), len(home)), not many)
        for s in range(0, len(m) if many else 0, 1024):
            cells = index.cells(x[m[s : s + 1024]])
            k = np.minimum(np.searchsorted(home, cells), max(len(home) - 1, 0))
            row, column = np.nonzero(home[k] == cells) if len(home) else (k[:0, 0], k[:0, 0])
            visited[s + row, k[row, column]] = True
        total = np.zeros(len(head), np.int64)
        name, first = np.unique(head, return_inverse=True)
        pairs = []
        for s in range(0, len(q), 512):
            some = q[s : s + 512]
            a, b = np.nonzero(x[some] @ x[m].T >= cosine)
            # the other way round is found by the member's own visit, unless that does not reach the query's cell
            unseen = ~visited[b, own[s + a]]
            a, b = some[a], m[b]
            other = head[a] != head[b]
            a, b, unseen = a[other], b[other], unseen[other]
            np.add.at(total, a, weight[b])
            np.add.at(total, b[unseen], weight[a[unseen]])
            # a spanning forest of the links so far is enough
            pairs.append(np.stack([first[a], first[b]]))
            if sum(p.shape[1] for p in pairs) > 1 << 20:
                pairs = [_stars(np.concatenate(pairs, axis=1), len(name))]
        stars = _stars(np.concatenate(pairs, axis=1), len(name)) if pairs else np.zeros((2, 0), np.int64)
        some = total > 0
        out = pa.table({"a": head[some], "b": pa.nulls(int(some.sum()), pa.int64()), "n": total[some]})
        ends = pa.table({"a": name[stars[0]], "b": name[stars[1]], "n": np.zeros(stars.shape[1], np.int64)})
        return pa.concat_tables([out, ends])

    return run


def _stars(pairs: np.ndarray, nodes: int) -> np.ndarray:
    """Each node of the pairs with the smallest of its component."""
    a, b = pairs
    label = np.arange(nodes)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    touched = np.unique(pairs)
    return np.stack([touched, label[touched]])


def fit_indexes(classes: DataFrame, kind: type, cosine: float, recall: float) -> dict[int, Index]:
    """An index for each width that more than INDEXED distinct vectors have; a job each, and a table has few."""
    width = (F.octet_length("unit") / np.dtype(kind).itemsize).cast("int")
    out = {}
    for w, n in classes.groupBy(width.alias("w")).count().where(F.col("count") > INDEXED).orderBy("w").collect():
        sample = _stack(classes.where(width == w).orderBy(F.xxhash64("unit")).limit(SAMPLE).select("unit").toArrow().column(0), kind)
        if w > 1:
            out[w] = Index.fit(sample, int(min(MOST_CODEWORDS, len(sample) // 8, max(2, round((n / CELL) ** 0.5)))), cosine, recall)
            _log.info("width %d: %d vectors, %d codewords a half, %d cells visited, recall %.4f", w, n, len(out[w].books[0]), out[w].visits, out[w].recall)
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.9, recall: float = RECALL) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors`` (vec_id, embedding; other columns are not read).

    n_links: other rows of the same width with a cosine of ``cosine`` or more that were
    found, equal vectors included; component_id: the smallest vec_id reachable by
    links. Null or empty vectors, vectors with null or non-finite components, and
    zero vectors link with nothing, nor do rows without a vec_id (kept, without a
    component). Vectors of one component link if their signs agree. Repeated rows are
    links of each other, and get equal results. No rows give none.
    """
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType == ArrayType(FloatType(), vectors.schema["embedding"].dataType.containsNull)
    kind = np.float32 if single else np.float64
    units = Written(vectors.select("vec_id", "embedding").mapInArrow(_units(kind), _UNIT), "units")
    valid = units.df
    everyone = vectors.select("vec_id")
    classes = Written(valid.groupBy("unit").agg(F.min("vec_id").alias("head"), F.count("*").alias("weight")), "classes")
    indexes = spark.sparkContext.broadcast(fit_indexes(classes.df, kind, cosine, recall))
    sizes = classes.df.mapInArrow(_count(indexes, kind), "w int, cell int, members long, queries long").groupBy("w", "cell").agg(F.sum("members").alias("m"), F.sum("queries").alias("q"))
    crowded: dict[int, list] = {}
    for r in sizes.where((F.col("m") > CHUNK) | (F.col("q") > CHUNK)).orderBy("w", "cell").collect():
        crowded.setdefault(r["w"], []).append((r["cell"], -(-r["m"] // CHUNK), -(-r["q"] // CHUNK)))
    chunks = spark.sparkContext.broadcast({w: (np.array(rows).T[0], np.maximum(np.array(rows).T[1:], 1)) for w, rows in crowded.items()})
    dealt = classes.df.mapInArrow(_deal(indexes, chunks, kind), _MESSAGE)
    found = Written(dealt.groupBy("w", "cell", "m", "q").applyInArrow(_verify(indexes, kind, cosine), "a long, b long, n long"), "links")
    of = connected_components(found.df.where("b IS NOT NULL AND a <> b"), "a", "b")
    links = found.df.groupBy("a").agg(F.sum("n").alias("n"))
    told = classes.df.join(links, F.col("head") == F.col("a"), "left").join(of, F.col("head") == F.col("node"), "left")
    told = told.select("unit", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "head").alias("component_id"))
    # a row's own vector says which class it is of; only rows with links need to ask
    asked = Written(told.where("n_links > 0"), "told")
    linked = Written(valid.join(asked.df, "unit").groupBy("vec_id").agg(F.max("n_links").alias("n_links"), F.min("component_id").alias("component_id")), "linked")
    for done in (units, classes, found, asked):
        done.drop()
    out = everyone.join(linked.df, "vec_id", "left")
    root = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), root.alias("component_id"), F.coalesce(root == F.col("vec_id"), F.lit(True)).alias("kept"))
