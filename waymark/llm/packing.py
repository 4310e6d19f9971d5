"""Best-fit packing of token pieces into sequences of a fixed capacity.

The plan is made from the histogram of lengths alone, which has at most
``capacity`` rows whatever the size of the input. The configuration linear program
has a variable for each way to fill one sequence and asks that every length is
covered as often as it occurs. It is solved by multiplicative weights: a length's
weight grows with the share of it that is still uncovered; each round prices the
configuration of most weight by a knapsack dynamic program over sizes and steps
along it, half of the way to where it would cover some length completely. Steps
are rounded to whole sequences as they are taken, as far as the demand left allows,
so rounding loses nothing; the last REST of the tokens is packed best fit
decreasing. The averaged weights are a solution of the dual program and bound from
below how many sequences any packing needs. Pieces then take their places by their
rank among the pieces of equal length, which needs one shuffle of (id, length) rows
and no driver data.
"""

from __future__ import annotations

import logging
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.flat import buffers, ranges
from waymark.llm.flat import pieces as cut
from waymark.llm.vocab import encoder
from waymark.storage import materialize

CAPACITY = 4096
#: Share of the tokens left to best fit.
REST = 0.1
#: Lengths that a round prices: half of them those least covered, half spread over all.
PRICED = 64
#: How fast weights grow.
RATE = 0.1

_log = logging.getLogger(__name__)
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_GOLDEN, _PLASTIC = 0.6180339887498949, 0.7548776662466927


#: Places of the lengths in a sequence, the copies of each, and how many sequences are filled like that.
Configuration = tuple[np.ndarray, np.ndarray, int]


@dataclass
class Plan:
    """Configurations that cover the demand exactly."""

    configurations: list[Configuration]
    #: Share of the tokens that configurations of the linear program place; best fit places the others.
    share: float
    #: What the dual program shows that any packing needs.
    bound: int

    @property
    def sequences(self) -> int:
        return sum(n for _, _, n in self.configurations)

    @property
    def gap(self) -> float:
        return self.sequences / self.bound - 1 if self.bound else 0.0


def knapsack(size: np.ndarray, value: np.ndarray, capacity: int, told: bool = True) -> tuple[float, list[int]]:
    """The most value that items, each once at most, have within the capacity, and (if told) which they are."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(size), capacity + 1), bool) if told else None
    for i, (s, v) in enumerate(zip(size.tolist(), value.tolist(), strict=True)):
        new = best[: capacity + 1 - s] + v
        better = new > best[s:]
        if told:
            took[i, s:] = better
        np.copyto(best[s:], new, where=better)
    chosen, c = [], int(best.argmax())
    top = float(best[c])
    if told:
        for i in range(len(size) - 1, -1, -1):
            if took[i, c]:
                chosen.append(i)
                c -= int(size[i])
    return top, chosen


def best_configuration(lengths: np.ndarray, value: np.ndarray, most: np.ndarray, capacity: int, told: bool = True) -> tuple[float, np.ndarray]:
    """The most value of one sequence, and the copies of each length in it, ``most`` of each at most."""
    most, which, times = np.minimum(most, capacity // lengths), [], []
    # copies in powers of two, so that any number of them can be chosen
    k = 1
    while (most > 0).any():
        now = np.minimum(k, most)
        which.append(np.flatnonzero(now))
        times.append(now[which[-1]])
        most, k = most - now, 2 * k
    which, times = np.concatenate(which), np.concatenate(times)
    top, chosen = knapsack(lengths[which] * times, value[which] * times, capacity, told)
    copies = np.zeros(len(lengths), np.int64)
    np.add.at(copies, which[chosen], times[chosen])
    return top, copies


def solve(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> Plan:
    """The plan for ``demand`` pieces of each of ``lengths`` (ascending, from 1 to capacity).

    A round ends some length or halves what is left of it, so rounds grow with the
    lengths (capacity at most) and, by a logarithm, with the demand.
    """
    if not len(lengths):
        return Plan([], 0.0, 0)
    share, left, total = lengths / capacity, demand.copy(), int((demand * lengths).sum())
    out: list[Configuration] = []
    weights, rounds = np.zeros(len(lengths)), 0
    while (behind := (left * lengths).sum() / total) >= REST:
        at = np.flatnonzero(left)
        need = left / demand
        weight = share * np.exp(RATE * (need - behind))
        weights, rounds = weights + weight, rounds + 1
        if len(at) > PRICED:
            spread = (at * _GOLDEN + rounds * _PLASTIC) % 1
            least = np.lexsort((spread, -np.round(8 * need[at])))[: PRICED // 2]
            at = np.unique(np.r_[at[least], at[np.argsort(spread)[: PRICED // 2]]])
        _, copies = best_configuration(lengths[at], weight[at], left[at], capacity)
        at, copies = at[copies > 0], copies[copies > 0]
        times = (int((left[at] // copies).min()) + 1) // 2
        left[at] -= copies * times
        out.append((at, copies, times))
    # any weights are a dual solution once divided by the most that one sequence can hold of them
    bound = max(float((y * demand).sum()) / best_configuration(lengths, y, demand, capacity, told=False)[0] for y in (share, weights / max(rounds, 1)) if y.any())
    placed = 1 - float((left * lengths).sum()) / total
    return Plan(out + best_fit(lengths, left, capacity), placed, math.ceil(bound - 1e-6))


def best_fit(lengths: np.ndarray, demand: np.ndarray, capacity: int) -> list[Configuration]:
    """Best fit decreasing over counts: sequences of equal content are handled together."""
    room: dict[int, dict[tuple, int]] = {}
    for j in range(len(lengths) - 1, -1, -1):
        size, n = int(lengths[j]), int(demand[j])
        while n > 0:
            free = min((r for r in room if r >= size), default=None)
            if free is None:
                each = capacity // size
                whole, part = divmod(n, each)
                for times, k in ((whole, each), (1, part)):
                    if times and k:
                        held = room.setdefault(capacity - k * size, {})
                        held[((j, k),)] = held.get(((j, k),), 0) + times
                break
            held = room[free]
            content, times = held.popitem()
            each = min(free // size, n)
            whole = min(times, n // each)
            if times > whole:
                held[content] = times - whole
            if not held:
                del room[free]
            fuller = room.setdefault(free - each * size, {})
            key = (*content, (j, each))
            fuller[key] = fuller.get(key, 0) + whole
            n -= each * whole
    out = []
    for held in room.values():
        for content, times in held.items():
            copies: dict[int, int] = {}
            for j, k in content:
                copies[j] = copies.get(j, 0) + k
            out.append((np.array(sorted(copies)), np.array([copies[j] for j in sorted(copies)]), times))
    return out


def places(lengths: np.ndarray, plan: list[Configuration]) -> dict[str, np.ndarray]:
    """For each length and configuration: the first rank it serves, and where those ranks go."""
    rows, base = [], 0
    for at, copies, times in plan:
        offset = 0
        for size, n in zip(lengths[at[::-1]].tolist(), copies[::-1].tolist(), strict=True):
            rows.append((size, n, times, base, offset))
            offset += n * size
        base += times
    rows.sort(key=lambda r: (r[0], r[3], r[4]))
    t = np.array(rows, np.int64).reshape(-1, 5)
    size = t[:, 1] * t[:, 2]
    before = np.cumsum(size) - size
    new = np.r_[True, t[1:, 0] != t[:-1, 0]] if len(t) else np.zeros(0, bool)
    before = before - np.maximum.accumulate(np.where(new, before, 0)) if len(t) else before
    return {"length": t[:, 0], "rank": before, "each": t[:, 1], "base": t[:, 3], "offset": t[:, 4]}


def _place(at: dict[str, np.ndarray]):
    key = (at["length"] << 40) + at["rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length = b.column("length").to_numpy(zero_copy_only=False)
            rank = b.column("_rank").to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, (length << 40) + rank, "right") - 1
            nth = rank - at["rank"][k]
            seq = at["base"][k] + nth // at["each"][k]
            off = at["offset"][k] + nth % at["each"][k] * length
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq), pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (the columns of PIECES, lengths 1 to capacity) with ``sequence_id`` and ``offset``.

    ``parts`` is read three times: give a written table. Ranks are numbers within
    (length, salt), plus the sizes of the salts before; a salt holds about
    500,000 rows at most, so a length that most pieces share is still spread.
    Equal pieces are told apart by nothing but their rank, so repeated rows get
    places of their own. Lengths beyond the capacity are refused; no rows give none.
    """
    rows = parts.groupBy("length").count().orderBy("length").collect()
    lengths = np.array([r[0] for r in rows], np.int64)
    demand = np.array([r[1] for r in rows], np.int64)
    if len(lengths) and (lengths[0] < 1 or lengths[-1] > capacity):
        raise ValueError(f"lengths must be from 1 to {capacity}, found {lengths[0]} to {lengths[-1]}")
    plan = solve(lengths, demand, capacity)
    _log.info("%d sequences, at least %d needed, %.3f of the tokens placed by configurations", plan.sequences, plan.bound, plan.share)
    at = places(lengths, plan.configurations)
    salts = int(max(64, -(-demand.sum() // 500_000)))
    salted = parts.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    size = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    by = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = size.select("length", "_salt", F.coalesce(F.sum("_n").over(by), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("length", "_salt").orderBy("doc_id", "piece"))
    ranked = salted.withColumn("_nth", nth).join(base, ["length", "_salt"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_base") + F.col("_nth") - 1).alias("_rank"))
    return ranked.mapInArrow(_place(at), f"{PIECES}, sequence_id long, offset long")


def _encode(vocabulary, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = encoder(vocabulary.value)
        for b in cut(batches):
            flat, count = codes.encode(*buffers(b.column("text")))
            flat = np.insert(flat.astype("<u4"), np.cumsum(count), end_id)
            count = count + 1
            parts = -(-count // capacity)
            row = np.repeat(np.arange(len(count)), parts)
            piece = ranges(np.zeros(len(parts), np.int64), parts)
            start = piece * capacity
            length = np.minimum(capacity, count[row] - start)
            at = 4 * ((np.cumsum(count) - count)[row] + start)
            raw = memoryview(flat.tobytes())
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            doc = b.column("doc_id").take(pa.array(row))
            yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of PIECES of each document's ids and end id, cut only beyond ``capacity``.

    vocabulary: the content of a ``tokenizers`` file. A null text counts as
    empty and gives the end id alone; a null doc_id stays null; other columns
    are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return docs.select("doc_id", "text").mapInArrow(_encode(shared, end_id, capacity), PIECES)


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """All documents' pieces with the sequence and place of each."""
    return pack(materialize(token_pieces(docs, vocabulary, end_id, capacity), "pieces"), capacity)
