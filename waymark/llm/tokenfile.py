"""Token-id files: bit-plane shuffled blocks under zstandard, with a chunk index.

A file holds the ids of documents in ascending doc_id order. Ids are cut into
blocks of ``BLOCK``; the bytes (or bits) of a block's ids are transposed, so that
each plane holds the bytes (bits) of one significance, and each plane is
compressed by itself. High planes are nearly constant and all but vanish.

Layout, little-endian:

    magic        8 bytes, b"WMPLANE1"
    planes       each block's planes, compressed, one after another
    chunk index  for each block: position, ids (u64), then the planes' sizes (u32)
    documents    doc_id (i64), null flag (u8), ids (u64): three compressed columns
    footer       position of the chunk index, blocks, position of the documents,
                 documents, ids, and planes a block (u64 each), then the magic
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.flat import buffers
from waymark.llm.flat import pieces as cut
from waymark.llm.vocab import encoder
from waymark.storage import materialize, scratch_path

MAGIC = b"WMPLANE1"
BLOCK = 1 << 16
LEVEL = 3
#: Bytes of text, and documents, of a file, about; the writer's document table is in memory.
SHARD_BYTES, SHARD_DOCS = 16 << 20, 500_000
LEAST_SHARDS = 24
_FOOTER = struct.Struct("<6Q8s")


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The byte planes (4) or bit planes (32) of unsigned 32-bit ids, lowest first."""
    octets = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [octets[:, k].tobytes() for k in range(4)]
    flags = np.unpackbits(octets, axis=1, bitorder="little")
    return [np.packbits(flags[:, k]).tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 4:
        octets = np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1) if n else np.zeros((0, 4), np.uint8)
    else:
        flags = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n) for p in planes], axis=1) if n else np.zeros((0, 32), np.uint8)
        octets = np.packbits(flags, axis=1, bitorder="little")
    return np.ascontiguousarray(octets).view("<u4").ravel()


def _system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class Writer:
    """Writes one file; memory holds one block and the document table."""

    def __init__(self, path: str, bits: bool = False, block: int = BLOCK) -> None:
        self.system, self.path = _system(path)
        self.out = self.system.open_output_stream(self.path)
        self.out.write(MAGIC)
        self.at, self.bits, self.block = len(MAGIC), bits, block
        self.index: list[tuple[int, int, list[int]]] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.held: list[np.ndarray] = []
        self.waiting = 0
        self.zip = zstandard.ZstdCompressor(level=LEVEL)

    def add(self, doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> None:
        """More documents: their ids one after another, and how many each has."""
        self.docs += doc_ids
        self.sizes += sizes.tolist()
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= self.block:
            flat = np.concatenate(self.held)
            whole = len(flat) // self.block * self.block
            for k in range(0, whole, self.block):
                self._block(flat[k : k + self.block])
            self.held, self.waiting = [flat[whole:]], len(flat) - whole

    def _put(self, data: bytes) -> int:
        self.out.write(data)
        self.at += len(data)
        return len(data)

    def _block(self, ids: np.ndarray) -> None:
        at = self.at
        self.index.append((at, len(ids), [self._put(self.zip.compress(p)) for p in to_planes(ids, self.bits)]))

    def close(self) -> tuple[int, int]:
        if self.waiting:
            self._block(np.concatenate(self.held))
        index_at, planes = self.at, 32 if self.bits else 4
        for at, n, sizes in self.index:
            self._put(struct.pack(f"<2Q{planes}I", at, n, *sizes))
        docs_at = self.at
        columns = (np.array([d or 0 for d in self.docs], "<i8"), np.array([d is None for d in self.docs], np.uint8), np.array(self.sizes, "<u8"))
        for c in columns:
            data = self.zip.compress(c.tobytes())
            self._put(struct.pack("<Q", len(data)))
            self._put(data)
        self._put(_FOOTER.pack(index_at, len(self.index), docs_at, len(self.docs), sum(self.sizes), planes, MAGIC))
        self.out.close()
        return len(self.docs), sum(self.sizes)


class Reader:
    """Reads a file by its chunk index: only the blocks that a range needs are decoded."""

    def __init__(self, path: str) -> None:
        system, at = _system(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        index_at, blocks, docs_at, n_docs, self.n_ids, planes, magic = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        row = struct.Struct(f"<2Q{planes}I")
        table = self._get(index_at, blocks * row.size)
        self.index = [(r[0], r[1], r[2:]) for r in row.iter_unpack(table)]
        self.first = np.cumsum([0, *(n for _, n, _ in self.index)])
        self.unzip = zstandard.ZstdDecompressor()
        columns, at = [], docs_at
        for kind in ("<i8", np.uint8, "<u8"):
            n = struct.unpack("<Q", self._get(at, 8))[0]
            columns.append(np.frombuffer(self.unzip.decompress(self._get(at + 8, n)), kind) if n_docs else np.zeros(0, kind))
            at += 8 + n
        self.null = columns[1].astype(bool)
        self.doc_ids, self.sizes = columns[0], columns[2].astype(np.int64)

    def _get(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.index[k]
        data, planes, p = self._get(at, sum(sizes)), [], 0
        for s in sizes:
            planes.append(self.unzip.decompress(data[p : p + s]))
            p += s
        return from_planes(planes, n)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids number start to stop of the file."""
        lo = int(np.searchsorted(self.first, start, "right")) - 1
        hi = int(np.searchsorted(self.first, stop, "left"))
        parts = [self.block(k) for k in range(lo, hi)] if stop > start else []
        return np.concatenate(parts)[start - self.first[lo] : stop - self.first[lo]] if parts else np.zeros(0, "<u4")

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """Documents in order; memory holds a block and the document that is being read."""
        k, held = 0, np.zeros(0, "<u4")
        for doc, null, n in zip(self.doc_ids.tolist(), self.null, self.sizes.tolist(), strict=True):
            parts, have = [held], len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            flat = np.concatenate(parts) if len(parts) > 1 else held
            yield None if null else doc, flat[:n]
            held = flat[n:]

    def close(self) -> None:
        self.file.close()


def _write(folder: str, vocabulary, end_id: int, bits: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, shard = encoder(vocabulary.value), TaskContext.get().partitionId()
        out, path = None, f"{folder}/shard-{shard:06d}-{uuid.uuid4().hex}.planes"
        for b in cut(batches):
            if out is None:
                out = Writer(path, bits)
            flat, count = codes.encode(*buffers(b.column("text")))
            out.add(b.column("doc_id").to_pylist(), np.insert(flat, np.cumsum(count), end_id), count + 1)
        if out is not None:
            docs, ids = out.close()
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([ids], pa.int64())})

    return run


def write_tokens(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None, bits: bool = False) -> DataFrame:
    """Write all documents' ids in ascending doc_id order; the manifest: ``(shard, path, n_docs, n_ids, start)``.

    Texts, not ids, are dealt out by ranges of doc_id, so the shuffle carries the
    smaller form. Each task writes one file of its own name, and the manifest
    names the files of the attempts that counted: a lost executor's half-written
    files are never read. start: ids in all shards before. A null text counts as
    empty (its end id alone); null doc_ids come first; rows with equal doc_ids stand
    in order of a hash of their texts, and may fall into several files; long texts are
    encoded whole; other columns are not read; no rows make an empty manifest.
    """
    spark = docs.sparkSession
    folder = folder or scratch_path(spark, "tokens")
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(folder)
    system.create_dir(at, recursive=True)
    shared = spark.sparkContext.broadcast(vocabulary)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_tie"))
    size, rows = docs.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    files = max(LEAST_SHARDS, -(-(size or 0) // SHARD_BYTES), -(-rows // SHARD_DOCS))
    dealt = texts.repartitionByRange(files, "doc_id", "_tie").sortWithinPartitions("doc_id", "_tie", "text").drop("_tie")
    shards = materialize(dealt.mapInArrow(_write(folder, shared, end_id, bits), "shard long, path string, n_docs long, n_ids long"), "manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
            file, rows = Reader(path), []
            for doc, ids in file.documents():
                rows.append((doc, start, len(ids), ids.tobytes()))
                start += len(ids)
                if sum(len(r[3]) for r in rows[-1:]) > 1 << 20 or len(rows) >= 256:
                    yield _documents(rows)
                    rows = []
            file.close()
            if rows:
                yield _documents(rows)


def _documents(rows: list[tuple]) -> pa.RecordBatch:
    doc, start, n, ids = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files; ids: little-endian unsigned 32-bit."""
    shards = max(1, manifest.count())
    return manifest.select("shard", "path", "start").repartitionByRange(shards, "shard").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids binary")
