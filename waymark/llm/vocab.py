"""Exact and quick encoding with the ``tokenizers`` library, a segment at a time.

The bytes of a whole batch are cut, by masks, where the tokenizer itself always
cuts. The library encodes each segment that is not remembered, and the ids of
a batch are gathered from what is remembered. Texts with a character at which
the cuts might not hold, or with the content of an added token, are given to the
library whole. Files are read by the driver, and their content broadcast: each is a vocabulary of a few MB.
"""

from __future__ import annotations

import itertools
import os
from pathlib import Path

import numpy as np

from waymark.llm.flat import lower_case, mix, ranges, span_hashes

_P = 0xA24BAED4963EE407

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".,!?;:")] = True
_BYTE = np.random.default_rng(77003).integers(1, 2**64, 256, dtype=np.uint64)

#: White space that is not ASCII, and separators that libraries treat unlike.
_ODD = "\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff"
_ODD_CODES = np.array(sorted(int.from_bytes(c.encode(), "big") for c in _ODD), np.int64)
_ODD_LEAD = np.zeros(256, np.int64)
for _c in _ODD:
    _ODD_LEAD[_c.encode()[0]] = len(_c.encode())


def _odd_places(data: np.ndarray) -> np.ndarray:
    """Positions of the characters of _ODD."""
    at = np.flatnonzero(_ODD_LEAD[data])
    size = _ODD_LEAD[data[at]]
    code = np.zeros(len(at), np.int64)
    for k in range(3):
        more = size > k
        code[more] = (code[more] << 8) | data[np.minimum(at[more] + k, len(data) - 1)]
    return at[np.isin(code, _ODD_CODES)]


class Encoder:
    """Ids of texts. Remembers segments in a table of SLOTS places; a newer one takes the place of an older."""

    SLOTS = 1 << 21
    #: Ids kept for remembered segments; beyond them the table is emptied.
    IDS = 12_000_000

    def __init__(self, vocabulary: str, added: bool = False) -> None:
        """added: whether the content of an added token is that token, the library's default; else it is text like other."""
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.encode_special_tokens = not added
        # the tokenizer that drops space also lower-cases, so letters A-Z may be lower-cased at once
        self.drops_space = '"Removed"' in vocabulary[:4000] and '"Lowercase"' in vocabulary[:4000]
        # sought in what is cut, which may be lower-cased: the library decides on the text itself
        contents = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if added else []
        self.contents = sorted({lower_case(np.frombuffer(c, np.uint8)).tobytes() if self.drops_space else c for c in contents})
        self._forget()

    def _added_places(self, data: np.ndarray) -> np.ndarray:
        """Positions of added tokens' content."""
        out, text = [], data.tobytes() if self.contents else b""
        for content in self.contents:
            at = text.find(content)
            while at >= 0:
                out.append(at)
                at = text.find(content, at + 1)
        return np.array(out, np.int64)

    def _forget(self) -> None:
        self.key = np.zeros(self.SLOTS, np.uint64)
        self.at = np.zeros(self.SLOTS, np.int32)
        self.size = np.zeros(self.SLOTS, np.int32)
        self.ids = np.zeros(1 << 20, np.uint32)
        self.used = 0

    def _library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        rows = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, rows), np.int64, len(rows))
        return np.fromiter(itertools.chain.from_iterable(rows), np.uint32, int(size.sum())), size

    def _segments(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where segments start and end, in order."""
        n = len(data)
        solid = ~_SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        cut = np.zeros(n, bool)
        cut[1:] = _STOP[data[1:]] & _LETTER[data[:-1]]
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:n] | cut[1:]
        stop[:-1] &= ~solid[1:] | edge[1:n] | cut[1:]
        s, e = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        if self.drops_space:
            return s, e
        # a blank goes with the word after it
        blank = (s > 0) & (data[s - 1] == 0x20) & ~edge[s] if len(s) else np.zeros(0, bool)
        s = s - blank
        # of the space that is left, a run before a word is cut before its last character, unless that was the blank
        loose = ~solid
        loose[s[blank]] = False
        first, final = loose.copy(), loose.copy()
        first[1:] &= ~loose[:-1] | edge[1:n]
        final[:-1] &= ~loose[1:] | edge[1:n]
        a, b = np.flatnonzero(first), np.flatnonzero(final) + 1
        if not len(a):
            return s, e
        # a run that a word follows at once, without a blank between, gives its last character up
        split = (b < n) & ~edge[b] & solid[np.minimum(b, n - 1)] & (b - a > 1)
        s, e = np.concatenate([s, a, b[split] - 1]), np.concatenate([e, np.where(split, b - 1, b), b[split]])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows, one after another, and how many each has; from the bytes and offsets of a string column."""
        data, rows = lower_case(raw) if self.drops_space else raw, len(off) - 1
        n = len(data)
        s, e = self._segments(data, off)
        places = np.concatenate([_odd_places(raw), self._added_places(data)])
        odd = np.unique(np.searchsorted(off[1:], places, "right")) if n else np.zeros(0, np.int64)
        if len(odd):
            keep = ~np.isin(np.searchsorted(off[1:], s, "right"), odd)
            s, e = s[keep], e[keep]
        h = mix(span_hashes(data, s, e, _P, _BYTE) + (e - s).astype(np.uint64)) | np.uint64(1)
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.SLOTS - 1)
        miss = np.flatnonzero(self.key[slot] != h)
        at, size = self.at[slot].astype(np.int64), self.size[slot].astype(np.int64)
        if len(miss):
            distinct, first, which = np.unique(h[miss], return_index=True, return_inverse=True)
            where, text = miss[first], data.tobytes()
            fresh, count = self._library([text[x:y].decode() for x, y in zip(s[where].tolist(), e[where].tolist(), strict=True)])
            if self.used + len(fresh) > self.IDS:
                # places of this batch's hits must stay valid: they are copied in front
                hit = np.flatnonzero(self.key[slot] == h)
                some, one, again = np.unique(h[hit], return_index=True, return_inverse=True)
                old, place, long = self.ids, at[hit][one], size[hit][one]
                self._forget()
                self._keep(some, old[ranges(place, long)], long)
                at[hit] = (np.cumsum(long) - long)[again]
            base = self._keep(distinct, fresh, count)
            at[miss] = (base + np.cumsum(count) - count)[which]
            size[miss] = count[which]
        flat = self.ids[ranges(at, size)]
        total = np.bincount(np.searchsorted(off[1:], s, "right"), weights=size, minlength=rows).astype(np.int64)
        if len(odd):
            more, count = self._library([raw[off[i] : off[i + 1]].tobytes().decode() for i in odd])
            where = np.repeat((np.cumsum(total) - total)[odd], count)
            flat = np.insert(flat, where, more)
            total[odd] = count
        return flat, total

    def _keep(self, h: np.ndarray, ids: np.ndarray, size: np.ndarray) -> int:
        """Remember segments; where their ids start."""
        base, need = self.used, self.used + len(ids)
        if need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(need - len(self.ids), len(self.ids) // 2), np.uint32)])
        self.ids[base:need] = ids
        self.used = need
        slot = (h >> np.uint64(20)).astype(np.int64) & (self.SLOTS - 1)
        self.key[slot] = h
        # of hashes with one slot the last is kept, by each of the three assignments
        self.at[slot] = base + np.cumsum(size) - size
        self.size[slot] = size
        return base


_made: dict[int, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder for a worker process and vocabulary."""
    key = hash(vocabulary)
    if key not in _made:
        _made[key] = Encoder(vocabulary, added=True)
    return _made[key]


def read_vocabulary(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")
