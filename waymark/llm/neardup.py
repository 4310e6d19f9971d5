"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

1. One pass over the texts makes, per document, its set of distinct word
   shingles, MinHash samples of it, band keys of the samples, and an odd sketch:
   the samples folded into a parity bitmap. The XOR of two sketches estimates
   the similarity, most precisely where it is high.
2. Documents with equal sets become one class; only its smallest goes on.
3. In each band bucket, documents are paired with the bucket's smallest and its
   largest member; no bucket is ever gathered. Pairs whose sketches show that
   they cannot be similar enough go; the others are confirmed on their full sets.
4. Buckets whose members these links leave in several components are looked at
   once more: members outside a bucket's main component are compared with all its
   members, in tiles of bounded size, by sketches first and then on full sets; a
   tile gives out one link at most for each member and component. With that,
   every link between two members of a bucket that matters to the components is
   found.
5. Components of the confirmed links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.flat import buffers, give_back, mix, pieces, ranges, windows, words
from waymark.operators.components import connected_components
from waymark.storage import materialize, release

BANDS, ROWS = 20, 4
SKETCH_BITS = 256
#: A pair whose estimate is this far below the threshold is dropped unconfirmed: over five standard errors of BANDS * ROWS samples.
MARGIN = 0.25
#: Rows of a tile: members outside the main component, and members they are compared with.
TILE = (256, 1024)

_RNG = np.random.default_rng(4171)
_A = _RNG.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TAG = _RNG.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_FOLD = _RNG.integers(0, 2**63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHORT = np.uint64(0xA0761D6478BD642F)

SIGNATURES = "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch array<long>"


def shingle_sets(raw: np.ndarray, off: np.ndarray, size: int) -> list[np.ndarray]:
    """Each row's distinct shingles, hashed and sorted; the whole sequence where a row has fewer words."""
    w = words(raw, off, lower=True)
    h, at = windows(w, size)
    row = w.row[at]
    first = np.searchsorted(row, np.arange(len(off)))
    out = []
    for i in range(len(off) - 1):
        a, b = first[i], first[i + 1]
        if a < b:
            out.append(np.unique(h[a:b]))
        elif (n := w.first[i + 1] - w.first[i]) > 0:
            one = np.array([n], np.uint64) * _SHORT
            for x in w.hash[w.first[i] : w.first[i + 1]]:
                one = mix(one ^ x)
            out.append(one)
        else:
            out.append(h[:0])
    return out


def _bands(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and odd sketch of one set."""
    least = np.concatenate([(s[None, :] * a[:, None]).min(1) for a in np.array_split(_A, max(1, len(s) * len(_A) >> 20))])
    tagged = mix(least ^ _TAG)
    keys = mix((tagged.reshape(BANDS, ROWS) * _FOLD).sum(1, dtype=np.uint64))
    odd = np.bincount((tagged >> np.uint64(40)) % np.uint64(SKETCH_BITS), minlength=SKETCH_BITS) & 1
    return keys.view(np.int64), np.packbits(odd.astype(np.uint8)).view(np.int64)


def _signatures(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for b in pieces(batches):
            sets = shingle_sets(*buffers(b.column("text")), size)
            with np.errstate(over="ignore"):
                marks = [_bands(s) if len(s) else (none, none) for s in sets]
                k1 = np.array([mix(s).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
                k2 = np.array([np.bitwise_xor.reduce(mix(s ^ _SHORT)) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lists = [pa.ListArray.from_arrays(np.cumsum([0, *(len(m[j]) for m in marks)]).astype(np.int32), np.concatenate([none, *(m[j] for m in marks)])) for j in (0, 1)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(k1), pa.array(k2), *lists], names=["doc_id", "n_shingles", "k1", "k2", "bands", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            sets = shingle_sets(*buffers(b.column("text")), size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "shingles"])

    return run


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "sa", 8 << 20):
            keep = []
            for x, y in zip(b.column("sa"), b.column("sb"), strict=True):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate([p, q]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(both) - common))
            t = b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            if t.num_rows:
                yield t

    return run


def _tile(percent: int, most_apart: int):
    """Members outside the main component against members of its buckets: one confirmed link to each other component."""

    def run(table: pa.Table) -> pa.Table:
        give_back()
        asks = table.column("asks").to_numpy()
        doc, part = table.column("doc_id").to_numpy(), table.column("part").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        sketch = np.array(table.column("sketch").to_pylist(), np.int64).view(np.uint64)
        size = np.array([len(x) for x in sets])
        others = np.flatnonzero(~asks)
        flat = np.concatenate([np.zeros(0, np.uint64), *(sets[i] for i in others)])
        begin = np.cumsum(size[others]) - size[others]
        a, b = [], []
        for i in np.flatnonzero(asks):
            near = np.bitwise_count(sketch[others] ^ sketch[i]).sum(1) <= most_apart
            near &= (part[others] != part[i]) & (100 * np.minimum(size[others], size[i]) >= percent * np.maximum(size[others], size[i]))
            k = np.flatnonzero(near)
            if not len(k):
                continue
            n = size[others[k]]
            with_ = flat[ranges(begin[k], n)]
            at = np.minimum(np.searchsorted(sets[i], with_), len(sets[i]) - 1)
            common = np.add.reduceat((sets[i][at] == with_).astype(np.int64), np.cumsum(n) - n)
            linked = others[k[100 * common >= percent * (n + size[i] - common)]]
            _, one = np.unique(part[linked], return_index=True)
            a.append(np.full(len(one), doc[i]))
            b.append(doc[linked[one]])
        none = np.zeros(0, np.int64)
        return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})

    return run


def _most_apart(similarity: float) -> int:
    """Differing sketch bits that do not rule the similarity out: 1 + n / 4k * ln(1 - 2d / n) >= similarity - MARGIN."""
    least = similarity - MARGIN
    return int(np.ceil(SKETCH_BITS / 2 * (1 - np.exp((least - 1) * 4 * BANDS * ROWS / SKETCH_BITS))))


def _alike(similarity: float, x: str, y: str) -> F.Column:
    """The sketches' estimate does not rule the similarity out."""
    apart = sum((F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i])) for i in range(1, SKETCH_BITS // 64)), F.bit_count(F.col(x)[0].bitwiseXOR(F.col(y)[0])))
    return apart <= _most_apart(similarity)


def links(docs: DataFrame, size: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """``(signatures, edges)``: edges (a, b) between classes' smallest doc_ids, enough for the exact components."""
    percent = round(similarity * 100)
    texts = docs.select("doc_id", "text")
    signed = materialize(texts.mapInArrow(_signatures(size), SIGNATURES), "signatures")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("doc_id"))
    heads = real.join(classes, ["doc_id", "k1", "k2", "n_shingles"]).select("doc_id", "bands", "sketch")
    member = heads.select("doc_id", "sketch", F.explode("bands").alias("bucket"))
    shared = materialize(member.groupBy("bucket").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high"), "shared")
    inside = materialize(member.join(shared, "bucket"), "buckets")

    near = inside.select(F.col("doc_id").alias("a"), F.explode(F.array("low", "high")).alias("b")).where("a <> b")
    near = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    sketch = real.select("doc_id", "sketch")
    near = near.join(sketch.toDF("a", "x"), "a").join(sketch.toDF("b", "y"), "b")
    tried = materialize(near.where(_alike(similarity, "x", "y")).select("a", "b"), "pairs")

    taking_part = inside.select("doc_id").distinct()
    sets = materialize(texts.join(taking_part, "doc_id").mapInArrow(_sets(size), "doc_id long, shingles binary"), "sets")

    release(docs.sparkSession)

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        with_sets = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
        return materialize(with_sets.mapInArrow(_confirm(percent), "a long, b long"), name)

    first = confirmed(tried, "links")
    of = connected_components(first, "a", "b")
    placed = inside.join(of.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    placed = materialize(placed.select("bucket", "doc_id", "sketch", "part"), "placed")
    sizes = placed.groupBy("bucket", "part").agg(F.count("*").alias("n"))
    main = sizes.groupBy("bucket").agg(F.max_by("part", F.struct("n", -F.col("part"))).alias("main"), F.count("*").alias("parts"), F.sum("n").alias("n"))
    main = materialize(main.where("parts > 1 AND n > 2").select("bucket", "main"), "main")
    torn = materialize(placed.join(main, "bucket"), "torn")
    again = torn.groupBy("main", "doc_id").agg(F.min("part").alias("part"), F.first("sketch").alias("sketch")).join(sets, "doc_id")
    again = materialize(again.withColumn("outside", F.col("part") != F.col("main")), "again")
    size_of = F.octet_length("shingles")
    chunks = lambda some, rows, mb: F.greatest(F.ceil(F.count_if(some) / rows), F.ceil(F.sum(F.when(some, size_of)) / (mb << 20))).cast("int")
    cut = again.groupBy("main").agg(chunks(F.col("outside"), TILE[0], 2).alias("no"), chunks(F.lit(True), TILE[1], 8).alias("nm"))
    cut = again.join(materialize(cut, "tiles"), "main")
    spread = F.xxhash64("doc_id")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    asked = cut.where("outside").select("*", F.pmod(spread, "no").cast("int").alias("o"), F.explode(each("nm")).alias("m"), F.lit(True).alias("asks"))
    asked = asked.union(cut.select("*", F.explode(each("no")).alias("o"), F.pmod(spread, "nm").cast("int").alias("m"), F.lit(False).alias("asks")))
    rest = asked.select("main", "o", "m", "asks", "doc_id", "part", "sketch", "shingles").groupBy("main", "o", "m").applyInArrow(_tile(percent, _most_apart(similarity)), "a long, b long")
    return signed, first.union(materialize(rest, "links"))


def near_duplicates(docs: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)`` for every row of ``docs``.

    Shingles are ``size`` words of the text, A-Z lower-cased; documents are linked
    where the Jaccard similarity of their sets is ``similarity`` or more, and
    component_id is the smallest doc_id reachable by links. A document with fewer
    words has one shingle, its whole sequence; one without words or text has none
    and is linked with nothing. A null doc_id has no component and is kept.
    Repeated rows each come out, all with their document's component. Texts are
    read whole, however long; only doc_id and text are read, whatever other columns
    are named. No rows give none.

    A link is found if its documents share a band and their sketches do not rule it
    out: at a similarity of exactly 0.8 all bands miss with probability 3e-5, and the
    sketch's estimate is over MARGIN too low with less than 1e-5.
    """
    signed, edges = links(docs, size, similarity)
    of = connected_components(edges, "a", "b")
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = real.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("head"), F.count("*").alias("n"))
    named = classes.join(of, F.col("head") == F.col("node"), "left").select("k1", "k2", "n_shingles", F.coalesce("component", "head").alias("component_id"), "n", "head")
    # only classes of several documents, or with links, say anything that a document does not know itself
    # they are written, so that both sides of the join are shuffled and the copies of one document can be split, however few components there are
    named = materialize(named.where("n > 1 OR component_id <> head").drop("n", "head"), "named")
    out = signed.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    root = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", root.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
