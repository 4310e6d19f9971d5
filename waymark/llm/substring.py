"""Removal of passages that occur in an earlier document, by relative Lempel-Ziv parsing.

The reference is the corpus itself, in blocks of documents of a few MB. A document
is parsed against every block that an index names for it:

1. Anchors. Of the runs of ``size - SPREAD`` words in each window of ``size`` words,
   the one with the least hash is an anchor: equal windows have equal anchors, and
   about a third of all words start one. The index holds each anchor with the
   SPREAD words on either side, by the hash of the anchor, and names, for every
   place that the window may have around the anchor, the block whose document is the
   smallest with these words. It only names blocks; what matches is found there.
2. Parse. The documents that were named are gathered by block, and so are the
   stretches of text around the anchors that named it. A block indexes its
   sequences of size, 2 size, 4 size, ... words; at a position of a stretch the
   longest of them that a smaller document has is taken and extended, word by word,
   to a factor (source, position, length), within a factor of two of the longest
   match there or longer. The parse is greedy: it goes on at the factor's end.
3. Boundaries. Windows that straddle a factor's end may be found elsewhere in the
   block: each is looked up, and the next factor starts at the first that is found.
   So factors cover exactly the words of windows that a smaller document has.

A passage that very many documents share is one entry of each block in the index,
and they are all parsed against the one block that has it first, whose stretches
are cut into chunks of CHUNK_BYTES, each beside a copy of the block's documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from waymark.llm.exchange import KEY_BYTES, binary, bucketed, cuts, deal_counts, keys, ordered, read_keys
from waymark.llm.flat import Words, buffers, give_back, mix, ranges, span_hashes, windows, words
from waymark.storage import materialize, release

WINDOW = 13
#: Words of a window beside its anchor, at most; 12 bits of each word on either side travel with an anchor.
SPREAD = 4
CHUNK_BYTES = 8 << 20
#: Entries of a block that are looked through at a time, with all that share their anchors: it bounds the memory of a block's task.
TURN = 1 << 18
_BITS = 12
_SIDE = 6
_LENGTHS = 0x9E3779B97F4A7C15
_L, _R = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)

MESSAGE = "block int, _bucket int, anchors binary, left binary, right binary, docs binary"
#: Entries of a bucket's message to a block, and the bucket to parse against (-1: the entry's first document is a source).
ANSWER = "_bucket int, block int, entries binary, targets binary"
REFERENCE, STRETCH = range(2)
PART = "kind int, target int, _bucket int, doc long, row int, start long, text binary"
FACTORS = "_bucket int, rows binary, starts binary, lengths binary, sources binary, places binary"
SPANS = ArrayType(StructType().add("start", LongType()).add("stop", LongType()))
FACTOR = ArrayType(StructType().add("start", LongType()).add("length", LongType()).add("source", LongType()).add("position", LongType()))


def _anchors(w: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each anchor: its first word, its hash, and SPREAD words to the left and right, the nearest lowest; 0 where the text ends."""
    spread = min(SPREAD, size - 1)
    length = size - spread
    h, at = windows(w, length)
    run = np.full(len(w.hash) + spread, np.iinfo(np.uint64).max, np.uint64)
    run[at] = h
    start = np.flatnonzero(w.row[: len(w.row) - size + 1] == w.row[size - 1 :]) if len(w.row) >= size else np.zeros(0, np.int64)
    best, place = run[start], start.copy()
    for j in range(1, spread + 1):
        other = run[start + j]
        less = other < best
        best[less], place[less] = other[less], start[less] + j
    chosen = np.zeros(len(w.hash), bool)
    chosen[place] = True
    at = np.flatnonzero(chosen)
    some = np.maximum(w.hash >> np.uint64(64 - _BITS), np.uint64(1))
    sides = []
    for step, edge in ((-1, w.first[w.row[at]]), (1, w.first[w.row[at] + 1])):
        side = np.zeros(len(at), np.uint64)
        for j in range(1, spread + 1):
            k = at - j if step < 0 else at + length - 1 + j
            there = k >= edge if step < 0 else k < edge
            side |= np.where(there, some[np.where(there, k, 0)], np.uint64(0)) << np.uint64(_BITS * (j - 1)) if len(at) else side
        sides.append(side)
    return at, run[at], *sides


class _Bucket:
    """A bucket's documents, its anchors, and its entries of the index: distinct anchors with their sides, ascending by anchor."""

    def __init__(self, table: pa.Table, size: int, lower: bool) -> None:
        self.table = ordered(table)
        self.raw, self.off = buffers(self.table.column("text"))
        self.words = words(self.raw, self.off, lower)
        ids = self.table.column("doc_id")
        self.known, self.doc = ids.is_valid().to_numpy(), ids.fill_null(0).to_numpy()
        at, h, left, right = _anchors(self.words, size)
        real = self.known[self.words.row[at]]
        at, h, left, right = at[real], h[real], left[real], right[real]
        # rows are in order of doc_id, so the first occurrence is that of the smallest
        _, first, which = np.unique(mix(mix(h + left * _L) + right * _R), return_index=True, return_inverse=True)
        order = np.argsort(h[first], kind="stable")
        first = first[order]
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.at, self.entry, self.first = at, place[which], at[first]
        self.hash, self.left, self.right, self.least = h[first], left[first], right[first], self.doc[self.words.row[at[first]]]


def _name(table: pa.Table) -> int:
    return table.column("_bucket")[0].as_py() if table.num_rows else 0


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of numbers, the lowest of all first: high ones are alike and compress well."""
    return numbers.astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _send(size: int, blocks: int, lower: bool):
    def run(table: pa.Table) -> pa.Table:
        b = _Bucket(table, size, lower)
        names, bounds = cuts(b.hash, blocks)
        anchor = keys(b.hash)
        left, right = (x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_SIDE] for x in (b.left, b.right))
        parts = [(anchor[x:y].tobytes(), left[x:y].tobytes(), right[x:y].tobytes(), _planes(b.least[x:y])) for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        columns = [binary([p[k] for p in parts]) for k in range(4)]
        return pa.table([pa.array(names, pa.int32()), pa.array([_name(table)] * len(parts), pa.int32()), *columns], names=["block", "_bucket", "anchors", "left", "right", "docs"])

    return run


def _repeated(anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the numbers that occur more than once."""
    ascending = np.sort(anchor)
    twice = ascending[1:][ascending[1:] == ascending[:-1]]
    del ascending
    if not len(twice):
        return np.zeros(0, np.int64), anchor[:0]
    at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, anchor), len(twice) - 1)] == anchor)
    return at, anchor[at]


def _sides(parts: list[np.ndarray]) -> np.ndarray:
    six = np.concatenate([np.zeros((0, _SIDE), np.uint8), *parts])
    out = np.zeros((len(six), 8), np.uint8)
    out[:, :_SIDE] = six
    return out.view("<u8").ravel()


def _named(spread: int, at: np.ndarray, anchor: np.ndarray, left: np.ndarray, right: np.ndarray, doc: np.ndarray, home: np.ndarray) -> np.ndarray:
    """Of entries with all that share their anchors: the entry and the bucket to look in, as one number, ascending."""
    found = []
    for l in range(spread + 1):
        r = spread - l
        there = np.ones(len(at), bool)
        for side, n in ((left, l), (right, r)):
            if n:
                there &= side >> np.uint64(_BITS * (n - 1)) != 0
        some = np.flatnonzero(there)
        mask = [np.uint64((1 << (_BITS * n)) - 1) for n in (l, r)]
        window = mix(mix(anchor[some] + (left[some] & mask[0]) * _L) + (right[some] & mask[1]) * _R)
        order = np.lexsort((doc[some], window))
        some, window = some[order], window[order]
        new = np.r_[True, window[1:] != window[:-1]] if len(some) else np.zeros(0, bool)
        source = some[np.flatnonzero(new)[np.cumsum(new) - 1]] if len(some) else some
        other = (doc[source] < doc[some]) & (home[source] != home[some])
        some, source = some[other], source[other]
        found.append((at[some] << 32) | home[source])
        # names the source's own entry: -1, shifted like a bucket
        found.append((at[np.unique(source)] << 32) | 0xFFFFFFFF)
    return np.unique(np.concatenate(found))


def _index(size: int):
    spread = min(SPREAD, size - 1)

    def run(table: pa.Table) -> pa.Table:
        """A block's answers: for each entry, the buckets that hold the smallest document with some window around its anchor."""
        give_back()
        sent = {k: [np.frombuffer(x.as_buffer(), np.uint8) for x in table.column(k)] for k in ("anchors", "left", "right", "docs")}
        each = np.array([len(x) // KEY_BYTES for x in sent["anchors"]])
        base = np.cumsum(each) - each
        # most anchors are in one message only: of the rest of it, what belongs to the others is unpacked
        at, anchor = _repeated(read_keys(sent["anchors"]))
        cut = np.searchsorted(at, np.r_[base, each.sum()])
        local = [at[x:y] - z for x, y, z in zip(cut[:-1].tolist(), cut[1:].tolist(), base.tolist(), strict=True)]
        left, right = (_sides([x.reshape(-1, _SIDE)[i] for x, i in zip(sent[k], local, strict=True)]) for k in ("left", "right"))
        doc = np.concatenate([np.ascontiguousarray(x.reshape(8, -1)[:, i].T).view("<i8").ravel() for x, i in zip(sent["docs"], local, strict=True)])
        home = np.repeat(table.column("_bucket").to_numpy(), np.diff(cut))
        del sent, local
        turns = 1 + len(at) // TURN
        turn = anchor % np.uint64(turns)
        found = np.sort(np.concatenate([_named(spread, *(x[i] for x in (at, anchor, left, right, doc, home))) for i in (np.flatnonzero(turn == k) for k in range(turns))]))
        entry, target = found >> 32, (found & 0xFFFFFFFF).astype(np.uint32).view(np.int32)
        message = np.searchsorted(base, entry, "right") - 1
        # a message without entries has the base of the next
        bounds = np.searchsorted(entry, np.r_[base, each.sum()])
        some = [i for i in range(len(each)) if bounds[i + 1] > bounds[i]]
        local = (entry - base[message]).astype("<i4") if len(entry) else entry.astype("<i4")
        kept = table.select(["_bucket", "block"]).take(pa.array(some, pa.int64()))
        for name, values in (("entries", local), ("targets", target.astype("<i4"))):
            kept = kept.append_column(name, binary([values[bounds[i] : bounds[i + 1]].tobytes() for i in some]))
        return kept

    return run


def _route(size: int, blocks: int, lower: bool):
    spread = min(SPREAD, size - 1)

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        """The rows of PART of a bucket: documents that are sources, and stretches of text for the blocks they are parsed against."""
        b, own = _Bucket(table, size, lower), _name(table)
        w = b.words
        names, bounds = cuts(b.hash, blocks)
        base = dict(zip(names.tolist(), bounds[:-1].tolist(), strict=True))
        entry, target = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for k, e, t in zip(answers.column("block").to_pylist(), answers.column("entries").to_pylist(), answers.column("targets").to_pylist(), strict=True):
            entry.append(np.frombuffer(e, "<i4") + base[k])
            target.append(np.frombuffer(t, "<i4"))
        entry, target = np.concatenate(entry), np.concatenate(target)
        source = np.zeros(len(b.off) - 1, bool)
        source[w.row[b.first[entry[target < 0]]]] = True
        entry, target = entry[target >= 0], target[target >= 0]
        # all places of each named entry
        order = np.argsort(b.entry, kind="stable")
        count = np.bincount(b.entry, minlength=len(b.hash))
        place = b.at[order[ranges((np.cumsum(count) - count)[entry], count[entry])]]
        target = np.repeat(target, count[entry])
        row = w.row[place]
        begin, end = np.maximum(place - spread, w.first[row]), np.minimum(place + size, w.first[row + 1])
        # windows that the bucket itself has in a smaller document
        h, at = windows(w, size)
        real = b.known[w.row[at]]
        h, at = h[real], at[real]
        _, first, which = np.unique(h, return_index=True, return_inverse=True)
        first = at[first[which]]
        later = b.doc[w.row[first]] < b.doc[w.row[at]]
        source[w.row[first[later]]] = True
        begin, end = np.r_[begin, at[later]], np.r_[end, at[later] + size]
        target = np.r_[target, np.full(int(later.sum()), own)]
        # overlapping ones of one row and target are one stretch
        order = np.lexsort((begin, target))
        begin, end, target = begin[order], end[order], target[order]
        new = np.r_[True, (target[1:] != target[:-1]) | (begin[1:] > end[:-1]) | (w.row[begin[1:]] != w.row[begin[:-1]])] if len(begin) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        begin, target = begin[head], target[head]
        end = np.maximum.reduceat(end, head) if len(head) else end
        row = w.row[begin]
        refs = np.flatnonzero(source)
        data = memoryview(b.raw.tobytes())
        texts = [bytes(data[x:y]) for x, y in zip(b.off[refs].tolist(), b.off[refs + 1].tolist(), strict=True)]
        texts += [bytes(data[x:y]) for x, y in zip(w.start[begin].tolist(), w.end[end - 1].tolist(), strict=True)]
        rows = np.r_[refs, row]
        return pa.table({
            "kind": pa.array(np.r_[np.full(len(refs), REFERENCE), np.full(len(row), STRETCH)], pa.int32()), "target": pa.array(np.r_[np.full(len(refs), own), target], pa.int32()),
            "_bucket": pa.array(np.full(len(rows), own), pa.int32()), "doc": pa.array(b.doc[rows], pa.int64()), "row": pa.array(rows, pa.int32()),
            "start": pa.array(np.r_[np.zeros(len(refs), np.int64), begin - w.first[row]], pa.int64()), "text": binary(texts),
        })

    return run


def longest_factors(reference: Words, ref_doc: np.ndarray, query: Words, query_doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The greedy parse of ``query`` against documents of ``reference`` with smaller numbers: each factor's first word, its source's first word, its length.

    ref_doc, query_doc: the document of each row; rows of the reference are in its order.
    Between factors, and in texts without any, no window of ``size`` words is found.
    """
    none = np.zeros(0, np.int64)
    (rh, rat), (qh, qat) = windows(reference, size), windows(query, size)
    if not len(rh) or not len(qh):
        return none, none, none
    length, at, source, rpos, qpos = size, none, none, rat, qat
    matched = np.zeros(len(query.hash), np.int64)
    start = np.zeros(len(query.hash), np.int64)
    while len(rpos) and len(qpos):
        distinct, first, which = np.unique(rh, return_index=True, return_inverse=True)
        k = np.minimum(np.searchsorted(distinct, qh), len(distinct) - 1)
        # the first of equal sequences is in the smallest document
        hit = (distinct[k] == qh) & (ref_doc[reference.row[rpos[first[k]]]] < query_doc[query.row[qpos]])
        used = np.zeros(len(distinct), bool)
        used[k[hit]] = True
        matched[qpos[hit]], start[qpos[hit]] = length, rpos[first[k[hit]]]
        rpos, qpos, length = rpos[used[which]], qpos[hit], 2 * length
        rpos = rpos[rpos + length <= reference.first[reference.row[rpos] + 1]]
        qpos = qpos[qpos + length <= query.first[query.row[qpos] + 1]]
        rh, qh = (mix(span_hashes(x.hash, p, p + length, _LENGTHS)) for x, p in ((reference, rpos), (query, qpos)))
    at = np.flatnonzero(matched)
    if not len(at):
        return none, none, none
    source, low = start[at], matched[at]
    high = np.minimum(query.first[query.row[at] + 1] - at, reference.first[reference.row[source] + 1] - source)
    # how much longer each goes on: running sums of words times powers tell whether two spans are equal
    power = np.cumprod(np.r_[np.ones(1, np.uint64), np.full(max(len(query.hash), len(reference.hash)), _LENGTHS, np.uint64)])
    sums = [np.r_[np.zeros(1, np.uint64), np.cumsum(x.hash * power[: len(x.hash)], dtype=np.uint64)] for x in (query, reference)]
    while (open_ := np.flatnonzero(low < high)).size:
        a, s, middle = at[open_], source[open_], (low[open_] + high[open_] + 1) // 2
        same = (sums[0][a + middle] - sums[0][a]) * power[s] == (sums[1][s + middle] - sums[1][s]) * power[a]
        low[open_[same]], high[open_[~same]] = middle[same], middle[~same] - 1
    # greedy: on at the first window across the factor's end that is found too, or at the next beyond it
    follow = np.searchsorted(at, np.maximum(at + 1, at + low - size + 1)).tolist()
    chosen, k = [], 0
    while k < len(follow):
        chosen.append(k)
        k = follow[k]
    return at[chosen], source[chosen], low[chosen]


def _parse(size: int, lower: bool):
    def run(table: pa.Table) -> pa.Table:
        """Factors of the stretches in a block, a row for each bucket they come from."""
        give_back()
        kind = table.column("kind").to_numpy()
        ref, some = table.filter(pa.array(kind == REFERENCE)), table.filter(pa.array(kind == STRETCH))
        ref = ref.sort_by([("doc", "ascending"), ("row", "ascending")])
        some = some.sort_by([("_bucket", "ascending"), ("row", "ascending"), ("start", "ascending")])
        r, q = (words(*buffers(t.column("text")), lower) for t in (ref, some))
        at, source, length = longest_factors(r, ref.column("doc").to_numpy(), q, some.column("doc").to_numpy(), size)
        row = q.row[at]
        begin = some.column("start").to_numpy()[row] + at - q.first[row]
        bucket, rows = some.column("_bucket").to_numpy()[row], some.column("row").to_numpy()[row]
        docs, place = ref.column("doc").to_numpy()[r.row[source]], source - r.first[r.row[source]]
        head = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
        bounds = list(zip(head.tolist(), np.r_[head[1:], len(bucket)].tolist() if len(bucket) else [], strict=True))
        columns = {n: binary([v[x:y].astype(k).tobytes() for x, y in bounds]) for n, v, k in (("rows", rows, "<i4"), ("starts", begin, "<i8"), ("lengths", length, "<i8"), ("sources", docs, "<i8"), ("places", place, "<i8"))}
        return pa.table({"_bucket": pa.array(bucket[head], pa.int32()), **columns})

    return run


def _cut(lower: bool, names: list[str], join_all: bool):
    def run(table: pa.Table, factors: pa.Table) -> pa.Table:
        t = ordered(table)
        raw, off = buffers(t.column("text"))
        w = words(raw, off, lower, hashed=False)
        row, start, length, source, place = (np.frombuffer(b"".join(factors.column(n).to_pylist()), k) for n, k in (("rows", "<i4"), ("starts", "<i8"), ("lengths", "<i8"), ("sources", "<i8"), ("places", "<i8")))
        order = np.lexsort((place, source, length, start, row))
        row, start, length, source, place = row[order], start[order], length[order], source[order], place[order]
        at = w.first[row] + start
        change = np.zeros(len(w.start) + 1, np.int64)
        np.add.at(change, at, 1)
        np.add.at(change, at + length, -1)
        gone = np.cumsum(change[:-1]) > 0
        per_row = np.diff(w.first)
        removed = np.bincount(w.row[gone], minlength=len(per_row))
        begin = gone & np.r_[True, ~gone[:-1] | (w.row[1:] != w.row[:-1])] if len(gone) else gone
        stop = gone & np.r_[~gone[1:] | (w.row[1:] != w.row[:-1]), True] if len(gone) else gone
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        base = w.first[w.row[s]] if len(s) else s

        def lists(rows: np.ndarray, columns: dict[str, np.ndarray]) -> pa.Array:
            each = pa.StructArray.from_arrays([pa.array(v, pa.int64()) for v in columns.values()], names=list(columns))
            return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(rows, minlength=len(per_row)))], pa.int32()), each)

        added = {
            "text": _kept_text(t.column("text"), raw, w, gone, removed, join_all), "n_words": pa.array(per_row, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "spans": lists(w.row[s], {"start": s - base, "stop": e - base}), "factors": lists(row, {"start": start, "length": length, "source": source, "position": place}),
        }
        columns = {n: t.column(n) for n in t.column_names} | added
        return pa.table({n: columns[n] for n in names})

    return run


def _kept_text(text: pa.ChunkedArray, raw: np.ndarray, w: Words, gone: np.ndarray, removed: np.ndarray, join_all: bool) -> pa.Array:
    """Kept words joined by one blank; unless join_all, texts that lose nothing stay as they are."""
    rows = len(removed)
    joined = np.ones(rows, bool) if join_all else removed > 0
    keep = ~gone & joined[w.row]
    s, e, row = w.start[keep], w.end[keep], w.row[keep]
    last = np.r_[row[1:] != row[:-1], True] if len(row) else np.zeros(0, bool)
    # texts stand side by side, so one word may end where the next begins; of the bytes, those of kept words, and the one after each but the last of its row, as a blank
    change = np.zeros(len(raw) + 1, np.int8)
    change[s] += 1
    change[e] -= 1
    kept = np.cumsum(change[:-1], dtype=np.int8).view(bool)
    gap = e[~last]
    kept[gap] = True
    data = raw.copy()
    data[gap] = 32
    data = data[kept]
    length = np.bincount(row, weights=e - s + ~last, minlength=rows).astype(np.int64)
    if join_all:
        off = np.r_[0, np.cumsum(length)].astype(np.int32)
        return pa.Array.from_buffers(pa.string(), rows, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
    new, at, old = data.tobytes(), np.r_[0, np.cumsum(length)].tolist(), text.to_pylist()
    return pa.array([new[at[i] : at[i + 1]].decode() if joined[i] else old[i] for i in range(rows)], pa.string())


def remove_repeats(docs: DataFrame, size: int = WINDOW, lower: bool = False, join_all: bool = False) -> DataFrame:
    """``docs`` with repeated passages cut from ``text``, and ``n_words``, ``n_removed``, ``spans``, ``factors``.

    A word goes if some window of ``size`` words that covers it also starts in a
    document with a smaller doc_id; windows are judged on the input. Kept words
    are joined by one blank (texts that lose nothing stay unchanged unless
    join_all). spans: the removed runs, as word numbers from start to before stop.
    factors: the parses that removed them: the words from start on, length of them,
    are those of document source from its word position on; factors may overlap.

    A null text counts as empty, and so do texts shorter than a window: they lose
    nothing. Very long texts are parsed whole; one is held by one task. A null
    doc_id is smaller than none, so its row loses nothing and makes no other lose
    anything; rows of equal doc_id do not count against each other, and of equal
    passages in them the first in the order of texts is named. No rows give none.
    Other columns are carried along under their names; those named like an added
    column, or ``_bucket``, are replaced or left out: rename them before.
    """
    kept = docs.drop("n_words", "n_removed", "spans", "factors", "_bucket")
    n, blocks = deal_counts(kept)
    texts = bucketed(kept.select("doc_id", "text"), n)
    sent = texts.groupBy("_bucket").applyInArrow(_send(size, blocks, lower), MESSAGE)
    answers = sent.groupBy("block").applyInArrow(_index(size), ANSWER)
    parts = materialize(texts.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(_route(size, blocks, lower), PART), "parts")
    release(docs.sparkSession)
    bytes_ = F.sum(F.octet_length("text"))
    chunks = parts.where(F.col("kind") == STRETCH).groupBy("target").agg(F.ceil(bytes_ / CHUNK_BYTES).cast("int").alias("_chunks"))
    own = F.array(F.pmod(F.xxhash64("_bucket", "row", "start"), F.col("_chunks")).cast("int"))
    each = F.when(F.col("kind") == STRETCH, own).otherwise(F.sequence(F.lit(0), F.col("_chunks") - 1))
    dealt = parts.join(chunks, "target").withColumn("_chunk", F.explode(each)).drop("_chunks")
    factors = dealt.groupBy("target", "_chunk").applyInArrow(_parse(size, lower), FACTORS)
    schema = StructType([*kept.schema]).add("n_words", "long").add("n_removed", "long").add("spans", SPANS).add("factors", FACTOR)
    return bucketed(kept, n).groupBy("_bucket").cogroup(factors.groupBy("_bucket")).applyInArrow(_cut(lower, schema.names, join_all), schema)
