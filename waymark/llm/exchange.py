"""Questions and answers between document buckets and hash blocks.

Operators that must look every word or window of the corpus up in a table built
from all of it would, row by row, shuffle a row for each. Here a bucket of
documents (a few MB of text, by a hash of doc_id and text) sends each block of the
hash space one message with all its keys for it, each distinct key once and in
ascending order; a block answers each message with one of equal order. A key that
is frequent in the corpus is one entry for each bucket, not one for each use: no
hot key gathers rows.

Buckets grow with the input, blocks only once a block would hold the keys of more
than BLOCK_BYTES of text: messages are LEAST_BLOCKS a bucket up to LEAST_BLOCKS *
BLOCK_BYTES of text, and never more than there are distinct keys in the buckets.
Keys go at KEY_BYTES: with the block they are in, collisions stay as rare at every size.

Buckets are made of documents alone, in the order of (doc_id, text), so a
recomputed task sends the same message. Rows without a doc_id are spread by their text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.flat import give_back

BUCKET_BYTES = 4 << 20
BLOCK_BYTES = 32 << 20
LEAST_BUCKETS = 24
LEAST_BLOCKS = 64
KEY_BYTES = 5


def deal_counts(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Buckets of about BUCKET_BYTES of text, and blocks for the keys of about BLOCK_BYTES of text each."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return max(LEAST_BUCKETS, -(-size // BUCKET_BYTES)), max(LEAST_BLOCKS, -(-size // BLOCK_BYTES))


def bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    return docs.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int"))


def ordered(table: pa.Table) -> pa.Table:
    """A bucket's rows by (doc_id, text), null doc_ids last."""
    give_back()
    if table.num_rows < 2:
        return table
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]).combine_chunks()


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of each hash: equal ranges of its upper half."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def cuts(h: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ascending hashes: the blocks that occur, and the bounds of each."""
    block = block_of(h, blocks)
    first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(block) else np.zeros(0, np.int64)
    return block[first], np.r_[first, len(block)]


def keys(h: np.ndarray) -> np.ndarray:
    """The lower KEY_BYTES of hashes, a row each; the block tells most of the rest."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES]


def read_keys(parts: list[bytes]) -> np.ndarray:
    """Keys of messages, one after another, as numbers."""
    five = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, KEY_BYTES)
    out = np.zeros((len(five), 8), np.uint8)
    out[:, :KEY_BYTES] = five
    return out.view("<u8").ravel()


def binary(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def pack(numbers: np.ndarray) -> bytes:
    """Mostly small numbers at a byte each; those of 255 or more follow as (place, value)."""
    large = np.flatnonzero(numbers >= 255)
    head = np.array([len(large)], "<u4").tobytes() + large.astype("<u4").tobytes() + numbers[large].astype("<i8").tobytes()
    return head + np.minimum(numbers, 255).astype(np.uint8).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, "<u4", 1)[0])
    out = np.frombuffer(data, np.uint8, offset=4 + 12 * n).astype(np.int64)
    out[np.frombuffer(data, "<u4", n, 4)] = np.frombuffer(data, "<i8", n, 4 + 4 * n)
    return out


def unpack_all(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all rows, one after another, and how many each has; a null has none."""
    parts = [unpack(x) if x is not None else np.zeros(0, np.int64) for x in column.to_pylist()]
    return np.concatenate([np.zeros(0, np.int64), *parts]), np.array([len(p) for p in parts], np.int64)
