"""SentencePiece BPE by vectorised merge rounds.

Texts become flat arrays of symbols. Each distinct word of a batch is merged
once: in every round each word finds its pair of least rank (a segmented
minimum over the flat array), all words merge together, leftmost first, and the
array is compacted; words without a pair leave it. Only the vocabulary is taken
from the library, none of its encoding.
"""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from waymark.llm.flat import give_back, mix, pieces, ranges, span_hashes

SPACE = 0x2581
_NONE = np.int64(2**40)
_P = 0xC2B2AE3D27D4EB4F


class PieceModel:
    """The vocabulary of a BPE model with byte fallback, as arrays."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.text = [sp.id_to_piece(i) for i in range(n)]
        self.bytes = np.full(256, -1, np.int64)
        control = np.zeros(n, bool)
        normal: dict[str, int] = {}
        for i, p in enumerate(self.text):
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
            elif sp.is_control(i) or sp.is_unknown(i):
                control[i] = True
            else:
                normal[p] = i
        if (self.bytes < 0).any():
            raise ValueError("only models with byte fallback are supported")
        probe = "ﬁ Ａ  é é \t\n x "
        if sp.normalize(probe) not in (probe.replace(" ", "▁"), "▁" + probe.replace(" ", "▁")):
            raise ValueError("only models that leave the text as it is are supported")
        score = [sp.get_score(i) for i in range(n)]
        #: Symbols of single characters; those of merges only get numbers from n on.
        chars = sorted({c for p in normal for c in p} - normal.keys())
        symbol = normal | {c: n + k for k, c in enumerate(chars)}
        self.extra = np.array([ord(c) for c in chars], np.int64)
        self.n = n
        self.char = np.full(0x110000, -1, np.int32)
        for c, i in symbol.items():
            if len(c) == 1:
                self.char[ord(c)] = i
        self.splits = not any("▁" in p.lstrip("▁") for p in normal)
        order = {s: k for k, s in enumerate(sorted({score[i] for i in normal.values()}, reverse=True))}
        rank = {i: order[score[i]] for i in normal.values()}
        rows = [(symbol[p[:k]] * (1 << 20) + symbol[p[k:]], rank[i], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol]
        rows.sort()
        self.key = np.array([r[0] for r in rows], np.int64)
        self.rank = np.array([r[1] for r in rows], np.int64)
        self.made = np.array([r[2] for r in rows], np.int64)
        #: Merges after which a pair of no more rank may arise.
        careful = {x for key, r, _ in rows for x in (key >> 20, key & ((1 << 20) - 1)) if x in rank and r <= rank[x]}
        self.careful = np.zeros(n + len(chars), bool)
        self.careful[list(careful)] = True
        #: Neighbouring characters within some piece: no merge spans any others, so texts are cut there.
        self.inside = np.unique(np.array([ord(a) << 21 | ord(b) for p in normal for a, b in zip(p, p[1:], strict=False)], np.int64))
        low = self.inside[(self.inside >> 21 < 256) & (self.inside & 0x1FFFFF < 256)]
        self.inside_low = np.zeros((256, 256), bool)
        self.inside_low[low >> 21, low & 0x1FFFFF] = True
        surface = [b"" if control[i] else bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(self.text)]
        surface[self.unk] = " ⁇ ".encode()
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        self.lead = np.array([p.startswith("▁") and not control[i] for i, p in enumerate(self.text)])
        self.control = control
        give_back()

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and index of each pair; _NONE where there is no such merge."""
        key = left.astype(np.int64) * (1 << 20) + right
        at = np.searchsorted(self.key, key)
        at[at == len(self.key)] = 0
        found = (self.key[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], _NONE), at

    def merge(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge rounds over words of ``count`` symbols each (1 at least): symbols and their counts after the last."""
        words = len(count)
        word = np.repeat(np.arange(words), count)
        out_sym, out_word = [], []
        rank, at = np.full(len(sym), _NONE), np.zeros(len(sym), np.int64)
        inner = np.flatnonzero(word[:-1] == word[1:])
        rank[inner], at[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(word)])
            least = np.repeat(np.minimum.reduceat(rank, first), size)
            over = least == _NONE
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
                keep = ~over
                sym, word, rank, at, least = sym[keep], word[keep], rank[keep], at[keep], least[keep]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == least)
            made = self.made[at[hit]]
            # of pairs that overlap, the first, third, ... of each run
            k = np.arange(len(hit))
            run = np.maximum.accumulate(np.where(np.r_[True, np.diff(hit) != 1], k, 0))
            take = (k - run) % 2 == 0
            hit, made = hit[take], made[take]
            # and of each word those up to the first that opens a pair of no more rank, which comes before the next
            some = np.flatnonzero(self.careful[made])
            if len(some):
                opens = np.zeros(len(hit), bool)
                opens[some] = self._opens(sym, word, rank, hit, made, some)
                if opens.any():
                    own = word[hit]
                    start = np.maximum.accumulate(np.where(np.r_[True, own[1:] != own[:-1]], np.arange(len(hit)), 0))
                    before = np.cumsum(opens) - opens
                    take = before == before[start]
                    hit, made = hit[take], made[take]
            sym[hit] = made
            keep = np.ones(len(sym), bool)
            keep[hit + 1] = False
            spot = np.cumsum(keep) - 1
            sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
            hit = spot[hit]
            anew = np.unique(np.r_[hit, hit[hit > 0] - 1])
            rank[anew] = _NONE
            anew = anew[anew + 1 < len(sym)]
            anew = anew[word[anew] == word[anew + 1]]
            rank[anew], at[anew] = self._pairs(sym[anew], sym[anew + 1])
        if not out_sym:
            return np.zeros(0, np.int64), np.zeros(words, np.int64)
        sym, word = np.concatenate(out_sym), np.concatenate(out_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int64), np.bincount(word, minlength=words)

    def _opens(self, sym: np.ndarray, word: np.ndarray, rank: np.ndarray, hit: np.ndarray, made: np.ndarray, some: np.ndarray) -> np.ndarray:
        """Whether each of ``some`` merges, made in order of their places, opens a pair of no more rank with a neighbour."""
        at, new, least = hit[some], made[some], rank[hit[some]]
        out = np.zeros(len(some), bool)
        # on the left the merge before may have been made; on the right none has
        left = np.where(at > 0, sym[at - 1], 0)
        touches = (some > 0) & (hit[some - 1] + 2 == at)
        left[touches] = made[some[touches] - 1]
        there = (at > 0) & (word[at - 1] == word[at])
        out[there] = self._pairs(left[there], new[there])[0] <= least[there]
        end = at + 2
        there = end < len(sym)
        there[there] = word[end[there]] == word[at[there]]
        out[there] |= self._pairs(new[there], sym[end[there]])[0] <= least[there]
        return out

    def _cuts(self, code: np.ndarray) -> np.ndarray:
        """Whether no piece spans each character and the one before it."""
        a, b = code[:-1], code[1:]
        out = np.ones(len(code), bool)
        low = (a < 256) & (b < 256)
        out[1:][low] = ~self.inside_low[a[low], b[low]]
        high = np.flatnonzero(~low)
        key = a[high] << 21 | b[high]
        k = np.minimum(np.searchsorted(self.inside, key), len(self.inside) - 1)
        out[1:][high] = self.inside[k] != key
        return out

    def _fallback(self, sym: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols without a piece (below 0: a character; from n on: one of merges only) become their bytes."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.n))
        if not len(odd):
            return sym, count
        word = np.repeat(np.arange(len(count)), count)
        code = np.where(sym[odd] < 0, -sym[odd] - 1, self.extra[np.maximum(sym[odd] - self.n, 0)] if len(self.extra) else 0)
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in code.tolist()]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(r) for r in raw]
        out = np.repeat(sym, size)
        begin = (np.cumsum(size) - size)[odd]
        out[ranges(begin, size[odd])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.bincount(np.repeat(word, size), minlength=len(count))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, with begin and end ids, one after another, and their counts."""
        texts = [t or "" for t in texts]
        full = np.array([len(t) > 0 for t in texts], bool)
        code = np.frombuffer("".join(" " + t for t in texts if t).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        code[code == 32] = SPACE
        length = np.array([len(t) + 1 for t in texts if t], np.int64)
        total = np.zeros(len(texts), np.int64)
        if len(code):
            begin = np.cumsum(length) - length
            edge = np.zeros(len(code), bool)
            if self.splits:
                blank = code == SPACE
                edge[1:] = blank[1:] & ~blank[:-1]
            edge |= self._cuts(code)
            edge[begin] = True
            s = np.flatnonzero(edge)
            size = np.diff(np.r_[s, len(code)])
            h = mix(span_hashes(mix(code.astype(np.uint64) + np.uint64(1)), s, s + size, _P) + size.astype(np.uint64))
            _, one, which = np.unique(h, return_index=True, return_inverse=True)
            c = code[ranges(s[one], size[one])]
            sym = self.char[c].astype(np.int64)
            sym = np.where(sym < 0, -c - 1, sym)
            ids, count = self._fallback(*self.merge(sym, size[one]))
            at = np.cumsum(count) - count
            flat = ids[ranges(at[which], count[which])]
            of = np.searchsorted(begin, s, "right") - 1
            total[full] = np.bincount(of, weights=count[which], minlength=len(length)).astype(np.int64)
        else:
            flat = np.zeros(0, np.int64)
        out = np.empty(len(flat) + 2 * len(texts), np.int64)
        first = np.cumsum(total + 2) - (total + 2)
        out[first] = self.bos
        out[first + total + 1] = self.eos
        out[ranges(first + 1, total)] = flat
        return out, total + 2

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[str]:
        """The texts of ids, one text after another: pieces' surfaces joined, without the blank in front of the first."""
        size = self.surface_len[ids]
        data = self.surface[ranges(self.surface_at[ids], size)]
        raw = data.tobytes()
        ends = np.concatenate([[0], np.cumsum(size)])
        last = np.cumsum(count)
        real = np.flatnonzero(~self.control[ids])
        out = []
        for a, b in zip((last - count).tolist(), last.tolist(), strict=True):
            k = int(np.searchsorted(real, a))
            cut = int(k < len(real) and real[k] < b and self.lead[ids[real[k]]])
            out.append(raw[ends[a] + cut : ends[b]].decode("utf-8", "replace"))
        return out


_made: dict[int, PieceModel] = {}


def _model(data: bytes) -> PieceModel:
    key = hash(data)
    if key not in _made:
        _made[key] = PieceModel(data)
    return _made[key]


def _encode(model, text: str, schema_names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for b in pieces(batches, text, 1 << 20):
            ids, count = m.encode(b.column(b.schema.get_field_index(text)).to_pylist())
            raw = ids.astype("<u4").tobytes()
            at = np.concatenate([[0], np.cumsum(count) * 4]).astype(np.int32)
            coded = pa.Array.from_buffers(pa.binary(), len(count), [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw)])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(count, pa.int64()), coded], names=schema_names)

    return run


def encode(docs: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` and ``ids`` (little-endian unsigned 32-bit, begin and end ids included).

    Same ids as the library's encoder without sampling. A null or empty text has
    the begin and end ids only. Columns named n_tokens or ids are replaced.
    """
    kept = docs.drop("n_tokens", "ids")
    schema = StructType([*kept.schema]).add("n_tokens", "long").add("ids", "binary")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(_encode(shared, text, schema.names), schema)


def _decode(model, ids: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model.value)
        for b in pieces(batches, ids, 2 << 20):
            rows = b.column(b.schema.get_field_index(ids)).to_pylist()
            flat = np.frombuffer(b"".join(r or b"" for r in rows), "<u4").astype(np.int64)
            count = np.array([len(r or b"") // 4 for r in rows], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns)), pa.array(m.decode(flat, count), pa.string())], names=names)

    return run


def decode(coded: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """``coded`` with ``decoded``, the text of its ids; null ids: empty."""
    kept = coded.drop("decoded")
    schema = StructType([*kept.schema]).add("decoded", "string")
    shared = coded.sparkSession.sparkContext.broadcast(model)
    return kept.mapInArrow(_decode(shared, ids, schema.names), schema)


def read_model(path: str) -> bytes:
    return Path(path).read_bytes()
