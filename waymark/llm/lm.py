"""Scoring texts with a probabilistic suffix tree learned from the corpus.

A document is its words, A-Z lower-cased, and an end. The tree has two storeys.

Words: the contexts of a word are the one to WORDS words before it, back to the
start of its document at most, which counts as a word of its own. A context is
examined if it occurs twice or more in training, and not always after the same
word (then it says nothing that its suffix doesn't say). It stays in the tree if
its next-word distribution diverges from its suffix's: if, each use left out in
turn, the others predict it better than the suffix does, by LEAST_GAIN nats in
all. A context that stays is smoothed towards the next shorter one that stays, in
the end towards the corpus's shares of words, and these towards spellings; of
two degrees of smoothing it takes the one that predicts the left-out uses best.

Spellings: the symbols of a word are its bytes and a closing blank, the contexts
up to DEPTH symbols that reach back to the word's start at most. A context with
an empirical probability of P_MIN or more stays if its distribution diverges
from its longest suffix's (or if a longer one that stays needs it). This storey
learns from each distinct word once, as it is needed for rare ones, and knows all
bytes, so every text has a probability.

A text is scored by the longest suffix that stays, symbol by symbol. All counts
are those of the whole training corpus, whatever the dealing: buckets of documents
ask blocks of hashes (see exchange). The counts of sequences of one and two words
come first; those of n + 1 words are asked where the n before the last are examined
as a context. Once a bucket knows them, it sums the test's terms over its own uses
of each context, and a block adds up these sums: one entry a bucket for each
context, however often it is used. The word storey grows with the corpus and stays
distributed; the spelling storey has DEPTH / P_MIN contexts at most, whatever the
corpus, and that bound is why it may be collected and broadcast.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm.exchange import KEY_BYTES, binary, bucketed, cuts, deal_counts, keys, ordered, pack, read_keys, unpack_all
from waymark.llm.flat import buffers, give_back, ranges, spellings, unique, words
from waymark.storage import Written, materialize, release

#: Words of a context.
WORDS = 3
#: Nats by which a context must predict its left-out uses better than its suffix does.
LEAST_GAIN = 1.0
#: The test's terms are rounded to this part of a nat, so that sums do not depend on their order.
GRAIN = 64
#: Weights of the suffix in a context of N uses: these shares of N, LEAST_WEIGHT at least.
SHARES = (1 / 32, 1 / 2)
LEAST_WEIGHT = 0.5
#: Probabilities below 10 to this are kept as logarithms alone.
LEAST_LOG = -200.0
DEPTH = 6
P_MIN = 4e-6
#: Words whose spelling a worker remembers, at 16 bytes each.
REMEMBERED = 1 << 21
BLANK = 0x20
SYMBOLS = 256
_BITS = 9

#: From a bucket to a block: distinct words, their bytes and uses; keys of longer sequences and their uses; keys of contexts and the test's sums, for each degree of smoothing.
MESSAGE = "block int, _bucket int, sizes binary, words binary, uses binary, keys binary, key_uses binary, contexts binary, gains binary"
#: Answers of equal order; rows without a bucket are the block's part of the vocabulary.
ANSWER = "_bucket int, block int, counts binary, key_counts binary, degrees binary, sizes binary, words binary, n long, total long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_VOID = spellings(np.zeros(0, np.uint8), np.zeros(1, np.int64), np.zeros(1, np.int64))
_A = np.uint64(0xA24BAED4963EE407)


def weights(n: np.ndarray, degree: int | np.ndarray) -> np.ndarray:
    """The suffix's weight in contexts of n uses."""
    return np.maximum(LEAST_WEIGHT, np.array(SHARES)[degree] * n)


class _Bucket:
    """The tokens of a bucket's documents, and what is known of the sequences of words that end at each.

    The empty word stands for the start of a document and, as a next word, for its
    end. Place 0 is a start; each row has its words and an end, which is the start
    for the next row.
    """

    def __init__(self, table: pa.Table) -> None:
        self.table = ordered(table)
        w = words(*buffers(self.table.column("text")), lower=True, hashed=False)
        self.train = self.table.column("_train").to_numpy().astype(bool)
        rows = len(self.train)
        self.n = np.diff(w.first)
        self.hash = np.r_[_VOID, np.insert(spellings(w.data, w.start, w.end - w.start), w.first[1:], _VOID[0])]
        self.row = np.r_[-1, np.repeat(np.arange(rows), self.n + 1)]
        #: Words that the longest sequence ending at a place may have, the start counted.
        self.reach = np.r_[1, ranges(np.full(rows, 2), self.n + 1)]
        self.trained = np.r_[False, np.repeat(self.train, self.n + 1)]
        self.sequence = [self.hash]
        #: By sequence length from 1: ascending distinct hashes, the number of each place's (-1: not asked), the corpus counts by place.
        self.distinct: list[np.ndarray] = []
        self.which: list[np.ndarray] = []
        self.count: list[np.ndarray] = []
        #: By depth, what ``examined`` has given.
        self.seen: dict[int, np.ndarray] = {}
        self._ask(np.ones(len(self.hash), bool))
        # the bytes of the distinct words; the empty one has none
        self.data, word = w.data, np.full(len(self.distinct[0]), -1)
        word[self.which[0].take(np.arange(len(w.start)) + 1 + w.row)] = np.arange(len(w.start))
        self.begin = np.where(word >= 0, w.start[word] if len(w.start) else 0, 0)
        self.size = np.where(word >= 0, w.end[word] - w.start[word] if len(w.start) else 0, 0)

    def _ask(self, places: np.ndarray) -> None:
        n = len(self.distinct)
        if n:
            longer = np.zeros(len(self.hash), np.uint64)
            # words' hashes are mixed, so a polynomial of them needs no more
            np.multiply(self.sequence[-1][n:], _A, out=longer[n:])
            longer[n:] += self.hash[: len(self.hash) - n]
            self.sequence.append(longer)
        at = np.flatnonzero(places)
        distinct, own = unique(self.sequence[-1][at])
        which = np.full(len(self.hash), -1, np.int32)
        which[at] = own
        self.distinct.append(distinct)
        self.which.append(which)

    def ask(self) -> None:
        """Ask for the sequences one word longer: all of two words, else those whose context is examined."""
        n = len(self.distinct) + 1
        self._ask((self.reach >= n) & (self.examined(n - 1) if n > 2 else True) & (self.row >= 0))

    def told(self, counts: np.ndarray) -> None:
        known, which = np.r_[counts, 0], self.which[len(self.count)]
        # places that were not asked take the last, 0
        self.count.append((known.astype(np.int32) if known.max() < 1 << 31 else known).take(which, mode="wrap"))

    def uses(self, n: int) -> np.ndarray:
        """Uses of the distinct sequences of n words in training documents here."""
        which = self.which[n - 1]
        return np.bincount(which[self.trained & (which >= 0)], minlength=len(self.distinct[n - 1]))

    def before(self, values: np.ndarray) -> np.ndarray:
        """Values of the place before each."""
        return np.r_[values[:1], values[:-1]]

    def examined(self, depth: int) -> np.ndarray:
        """Places whose context of ``depth`` words is examined."""
        if depth not in self.seen:
            n = self.before(self.count[depth - 1])
            out = (self.reach > depth) & (n >= 2) & (self.row >= 0)
            self.seen[depth] = out & (n != self.before(self.count[depth - 2])) if depth > 1 else out
        return self.seen[depth]

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places where a context of ``depth`` is examined, the distinct contexts, and the number of each place's among them."""
        at = np.flatnonzero(self.examined(depth))
        which, distinct = self.which[depth - 1][at - 1], self.distinct[depth - 1]
        there = np.zeros(len(distinct), bool)
        there[which] = True
        return at, distinct[there], (np.cumsum(there) - 1)[which]

    def torn(self, depth: int, at: np.ndarray, own: np.ndarray, contexts: int) -> np.ndarray:
        """Contexts with two uses in training, one of them here, whose next words differ: leaving either out tells against them."""
        out = np.zeros(contexts, bool)
        out[own[self.trained[at] & (self.count[depth - 1][at - 1] == 2) & (self.count[depth][at] == 1)]] = True
        return out

    def asked(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As ``contexts``, without those that are torn."""
        at, distinct, own = self.contexts(depth)
        whole = ~self.torn(depth, at, own, len(distinct))
        number = np.cumsum(whole) - 1
        return at[whole[own]], distinct[whole], number[own[whole[own]]]

    def gains(self, depth: int, tokens: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Contexts of ``depth`` to ask for, and the test's sums over their uses in training here, for each degree of smoothing.

        The suffix's distribution is smoothed by one use of its own suffix's. A sum
        is left at 0 where the degree before it has the same weight.
        """
        q = self.count[0] / max(tokens, 1)
        for d in range(1, depth):
            at = np.flatnonzero(self.examined(d) & self.trained)
            q[at] = (self.count[d][at] + q[at]) / (self.count[d - 1][at - 1] + 1)
        places, distinct, own = self.asked(depth)
        used = self.trained[places]
        at, own = places[used], own[used]
        n, c, q = self.count[depth - 1][at - 1], self.count[depth][at], q[at]
        out, last = [], np.zeros(len(at))
        for degree in range(len(SHARES)):
            w = weights(n, degree)
            term = np.round(GRAIN * np.log((c - 1 + w * q) / (n - 1 + w) / q))
            out.append(np.bincount(own, weights=np.where(w == last, 0, term), minlength=len(distinct)))
            last = w
        return distinct, out


def _recall(table: pa.Table, answers: pa.Table | None, rounds: int) -> tuple[_Bucket, list[np.ndarray]]:
    """The bucket with the counts of all rounds so far, and the degrees of smoothing by depth (0: the context is not in the tree)."""
    b = _Bucket(table)
    b.ask()
    degrees = []
    for r in range(1, rounds + 1):
        some = answers.filter(pa.array(answers.column("round").to_numpy() == r))
        some = some.take(pa.array(np.argsort(some.column("block").to_numpy(), kind="stable")))
        if r == 1:
            b.told(unpack_all(some.column("counts"))[0])
        else:
            degrees.append(np.frombuffer(b"".join(x or b"" for x in some.column("degrees").to_pylist()), np.uint8))
        if r <= WORDS:
            b.told(unpack_all(some.column("key_counts"))[0])
            if r < WORDS:
                b.ask()
    return b, degrees


def _send(round: int, blocks: int, tokens: int):
    """Messages of a round: the first asks for words and pairs, round r for r + 1 words and for the contexts of r - 1."""

    def send(table: pa.Table, answers: pa.Table | None) -> pa.Table:
        b, _ = _recall(table, answers, round - 1)
        bucket = table.column("_bucket")[0].as_py() if table.num_rows else 0
        parts: dict[int, dict[str, bytes]] = {}

        def put(h: np.ndarray, name: str, make) -> None:
            names, bounds = cuts(h, blocks)
            for k, x, y in zip(names.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                parts.setdefault(k, {})[name] = make(x, y)

        if round == 1:
            h, uses, size = b.distinct[0], b.uses(1), b.size
            data, at = b.data[ranges(b.begin, size)], np.r_[0, np.cumsum(size)]
            put(h, "sizes", lambda x, y: pack(size[x:y]))
            put(h, "words", lambda x, y: data[at[x] : at[y]].tobytes())
            put(h, "uses", lambda x, y: pack(uses[x:y]))
        if round <= WORDS:
            h, more = b.distinct[round], b.uses(round + 1)
            key = keys(h)
            put(h, "keys", lambda x, y: key[x:y].tobytes())
            put(h, "key_uses", lambda x, y: pack(more[x:y]))
        if round > 1:
            h, sums = b.gains(round - 1, tokens)
            seen, sums = keys(h), np.array(sums).astype(np.int64)
            put(h, "contexts", lambda x, y: seen[x:y].tobytes())
            put(h, "gains", lambda x, y: _write_sums(sums[:, x:y]))
        names = [f.split()[0] for f in MESSAGE.split(", ")][2:]
        return pa.table({"block": pa.array(list(parts), pa.int32()), "_bucket": pa.array([bucket] * len(parts), pa.int32()), **{n: binary([p.get(n) for p in parts.values()]) for n in names}})

    if round == 1:
        return lambda table: send(table, None)
    return lambda table, answers: send(table, answers)


def _write_sums(sums: np.ndarray) -> bytes:
    """Rows of whole numbers of either sign, by byte planes: the upper ones are mostly zeros."""
    unsigned = ((sums << 1) ^ (sums >> 63)).astype("<u4")
    return unsigned[:, :, None].view(np.uint8).transpose(0, 2, 1).tobytes()


def _read_sums(data: bytes) -> np.ndarray:
    unsigned = np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(len(SHARES), 4, -1).transpose(0, 2, 1)).view("<u4")[:, :, 0].astype(np.int64)
    return (unsigned >> 1) ^ -(unsigned & 1)


def _total(key: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum of the values of each distinct key, and the key's number at each entry."""
    distinct, which = unique(key)
    return np.bincount(which, weights=values, minlength=len(distinct)), which


def _answer(table: pa.Table) -> pa.Table:
    """A block's answers, in the order of each message: the corpus counts of words and sequences, and the degree of smoothing of contexts that stay (0: none)."""
    give_back()
    table = table.take(pa.array(np.argsort(table.column("_bucket").to_numpy())))
    out = {"_bucket": table.column("_bucket").to_pylist()}
    messages = table.num_rows

    def split(values: np.ndarray, each: np.ndarray) -> list[np.ndarray]:
        return np.split(values, np.cumsum(each)[:-1])

    size, each = unpack_all(table.column("sizes"))
    data = np.frombuffer(b"".join(x or b"" for x in table.column("words").to_pylist()), np.uint8)
    word = spellings(data, np.cumsum(size) - size, size)
    _, which, seen = unique(word, first=True)
    total = np.bincount(which, weights=unpack_all(table.column("uses"))[0], minlength=len(seen)).astype(np.int64)
    out["counts"] = [pack(x) for x in split(total[which], each)]
    seen = seen[total > 0]
    begin = (np.cumsum(size) - size)[seen]
    vocabulary = {"sizes": pack(size[seen]), "words": data[ranges(begin, size[seen])].tobytes(), "n": len(seen), "total": int(total.sum())}

    uses, each = unpack_all(table.column("key_uses"))
    sums, which = _total(read_keys([x or b"" for x in table.column("keys").to_pylist()]), uses)
    out["key_counts"] = [pack(x) for x in split(sums.astype(np.int64)[which], each)]

    asked = [x or b"" for x in table.column("contexts").to_pylist()]
    gains = np.concatenate([_read_sums(x or b"") for x in table.column("gains").to_pylist()], axis=1)
    context = read_keys(asked)
    best, degree = np.full(len(context), GRAIN * LEAST_GAIN), np.zeros(len(context), np.uint8)
    distinct, which = unique(context)
    for k in range(len(SHARES)):
        sums = np.bincount(which, weights=gains[k], minlength=len(distinct))
        better = sums[which] > best if len(context) else np.zeros(0, bool)
        best[better], degree[better] = sums[which][better], k + 1
    out["degrees"] = [x.tobytes() for x in split(degree, np.array([len(x) // KEY_BYTES for x in asked]))]
    rows = {k: [*v, None] for k, v in out.items()} | {"block": [table.column("block")[0].as_py()] * (messages + 1)} | {k: [None] * messages + [v] for k, v in vocabulary.items()}
    kinds = {"_bucket": pa.int32(), "block": pa.int32(), **dict.fromkeys(("counts", "key_counts", "degrees", "sizes", "words"), pa.binary()), "n": pa.int64(), "total": pa.int64()}
    return pa.table({k: pa.array(rows[k], t) for k, t in kinds.items()})


def sequences(data: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as blank, bytes, blank: all symbols; the position of each predicted one; how many symbols stand before it in its word."""
    full = size + 2
    flat = np.full(int(full.sum()), BLANK, np.int64)
    begin = np.cumsum(full) - full
    flat[ranges(begin + 1, size)] = data
    at = ranges(begin + 1, size + 1)
    return flat, at, at - np.repeat(begin, size + 1)


def contexts(flat: np.ndarray, at: np.ndarray, before: np.ndarray, depth: int, shorter: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Which predicted positions have a context of ``depth``, and its code: the nearest symbol lowest, 9 bits each."""
    has = before >= depth
    code = shorter[has] | ((flat[at[has] - depth] + 1) << (_BITS * (depth - 1)))
    return has, code


def _grams(table: pa.Table) -> pa.Table:
    """Uses of each (context, next symbol) in the distinct training words of some blocks."""
    give_back()
    data = np.frombuffer(b"".join(table.column("words").to_pylist()), np.uint8)
    size, _ = unpack_all(table.column("sizes"))
    flat, at, before = sequences(data, size[size > 0])
    code = np.zeros(len(at), np.int64)
    keys, uses = [], []
    for depth in range(DEPTH + 1):
        if depth:
            has, code = contexts(flat, at, before, depth, code)
            at, before = at[has], before[has]
        if not len(at):
            break
        key = (code << _BITS) | (flat[at] + 1)
        key, n = np.unique(key, return_counts=True)
        keys.append(key)
        uses.append(n)
    none = np.zeros(0, np.int64)
    return pa.table({"key": np.concatenate([none, *keys]), "n": np.concatenate([none, *uses])})


@dataclass
class Tree:
    """Retained contexts by depth, and smoothed log10 probabilities of their next symbols."""

    #: By depth from 1: sorted codes, and the state of each. State 0 is the root.
    code: list[np.ndarray]
    state: list[np.ndarray]
    parent: np.ndarray
    back_off: np.ndarray
    #: Sorted (state, symbol) and the probability there.
    key: np.ndarray
    logp: np.ndarray
    root: np.ndarray

    @staticmethod
    def fit(key: np.ndarray, n: np.ndarray) -> Tree:
        """key: a context's code and the next symbol plus one, each (context, symbol) once; n: its uses. Every suffix of a context is given too."""
        order = np.argsort(key)
        key, n = key[order], n[order].astype(float)
        code, symbol = key >> _BITS, (key & ((1 << _BITS) - 1)) - 1
        top = code == 0
        seen = np.bincount(symbol[top], weights=n[top], minlength=SYMBOLS)
        root = (seen + 1) / (seen.sum() + SYMBOLS)
        # by depth: contexts, their pairs with the number of the context and the smoothed probability, and whether they stay
        levels, upper = [], (key[top], root[symbol[top]])
        for depth in range(1, DEPTH + 1):
            at = np.flatnonzero((code >= 1 << (_BITS * (depth - 1))) & (code < 1 << (_BITS * depth)))
            context, own = np.unique(code[at], return_inverse=True)
            uses, kinds = np.bincount(own, weights=n[at], minlength=len(context)), np.bincount(own, minlength=len(context))
            shorter = ((code[at] & ((1 << (_BITS * (depth - 1))) - 1)) << _BITS) | (symbol[at] + 1)
            up = upper[1][np.searchsorted(upper[0], shorter)] if len(at) else np.zeros(0)
            p = (n[at] + kinds[own] * up) / (uses + kinds)[own]
            gain = np.bincount(own, weights=n[at] * np.log(n[at] / uses[own] / up), minlength=len(context))
            levels.append([context, own, symbol[at], p, uses, kinds, gain > 0.5 * kinds * np.log(uses + 1)])
            upper = (key[at], p)
        for depth in range(DEPTH, 1, -1):
            context, keep, below = levels[depth - 1][0], levels[depth - 1][6], levels[depth - 2]
            below[6][np.searchsorted(below[0], context[keep] & ((1 << (_BITS * (depth - 1))) - 1))] = True
        codes, states, parent, back, entry, logp, last = [], [], [np.zeros(1, np.int64)], [np.zeros(1)], [], [], 0
        for depth, (context, own, after, p, uses, kinds, keep) in enumerate(levels, 1):
            number = np.cumsum(keep) + last
            shorter = context[keep] & ((1 << (_BITS * (depth - 1))) - 1)
            parent.append(states[-1][np.searchsorted(codes[-1], shorter)] if depth > 1 else np.zeros(len(shorter), np.int64))
            codes.append(context[keep])
            states.append(number[keep])
            back.append(np.log10(kinds[keep] / (uses + kinds)[keep]))
            some = keep[own]
            entry.append((number[own[some]] << _BITS) | after[some])
            logp.append(np.log10(p[some]))
            last += int(keep.sum())
        entry, logp = np.concatenate(entry), np.concatenate(logp)
        order = np.argsort(entry)
        return Tree(codes, states, np.concatenate(parent), np.concatenate(back), entry[order], logp[order], np.log10(root))

    def _next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """log10 probability of each symbol after each state."""
        out, todo = np.zeros(len(state)), np.arange(len(state))
        while len(todo):
            s = state[todo]
            top = s == 0
            out[todo[top]] += self.root[symbol[todo[top]]]
            todo, s = todo[~top], s[~top]
            want = (s << _BITS) | symbol[todo]
            at = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            found = self.key[at] == want if len(self.key) else np.zeros(len(todo), bool)
            out[todo[found]] += self.logp[at[found]]
            todo, s = todo[~found], s[~found]
            out[todo] += self.back_off[s]
            state[todo] = self.parent[s]
        return out

    def remembered(self, word: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of words with ascending hashes. Those of a worker's last buckets, REMEMBERED at most, are kept, as most words come again."""
        names, values = getattr(self, "_known", (np.zeros(0, np.uint64), np.zeros(0)))
        at = np.minimum(np.searchsorted(names, word), max(len(names) - 1, 0))
        known = names[at] == word if len(names) else np.zeros(len(word), bool)
        out = np.empty(len(word))
        out[known] = values[at[known]]
        new = np.flatnonzero(~known)
        out[new] = self.words(data[ranges(begin[new], size[new])], size[new])
        if len(names) + len(new) > REMEMBERED:
            names, values, new = names[:0], values[:0], np.arange(len(word))
        spot = np.searchsorted(names, word[new])
        self._known = (np.insert(names, spot, word[new]), np.insert(values, spot, out[new]))
        return out

    def words(self, data: np.ndarray, size: np.ndarray) -> np.ndarray:
        """log10 probability of each word. Each (context, symbol) is looked up once, however many words have it."""
        if not len(size):
            return np.zeros(0)
        flat, at, before = sequences(data, size)
        code = np.zeros(len(at), np.int64)
        for depth in range(1, DEPTH + 1):
            code |= np.where(before >= depth, flat[at - np.minimum(before, depth)] + 1, 0) << (_BITS * (depth - 1))
        key, which = np.unique((code << _BITS) | flat[at], return_inverse=True)
        code, symbol = key >> _BITS, key & ((1 << _BITS) - 1)
        state, alive = np.zeros(len(key), np.int64), np.arange(len(key))
        for depth in range(1, DEPTH + 1):
            codes, full = self.code[depth - 1], code[alive]
            # every context is at least one symbol long; longer ones where the word has begun that far back
            there = full >> (_BITS * (depth - 1)) > 0
            alive, want = alive[there], full[there] & ((1 << (_BITS * depth)) - 1)
            if not len(codes) or not len(alive):
                break
            k = np.minimum(np.searchsorted(codes, want), len(codes) - 1)
            found = codes[k] == want
            alive = alive[found]
            state[alive] = self.state[depth - 1][k[found]]
        each = self._next(state, symbol)[which]
        return np.add.reduceat(each, np.cumsum(size + 1) - (size + 1))


def _score(model, tokens: int, known: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        tree: Tree = model.value
        b, degrees = _recall(table, answers, WORDS + 1)
        # the root: a word's share of the corpus, smoothed by its spelling's probability, by the weight of the distinct tokens
        which = b.which[0]
        count = np.zeros(len(b.distinct[0]), np.int64)
        count[which] = b.count[0]
        base = np.log10((count + 1) / (tokens + known + 1))
        real, k = b.size > 0, max(known, 1)
        spelt = np.full(len(count), -np.log10(k + 1))
        spelt[real] = tree.remembered(b.distinct[0][real], b.data, b.begin[real], b.size[real]) + np.log10(k / (k + 1))
        root = np.log10(k) + spelt
        seen = count > 0
        root[seen] = np.log10(count[seen] + k * 10.0 ** spelt[seen])
        root -= np.log10(tokens + k)
        # contexts that stay, from the shortest on: their shares, smoothed by what the shorter ones gave
        logp, p = root[which], (10.0**root)[which]
        # only logarithms hold what is very small, as a spelling of hundreds of bytes
        small = logp < LEAST_LOG
        touched = np.zeros(len(which), bool)
        for depth in range(1, WORDS + 1):
            at, _, own = b.asked(depth)
            degree = degrees[depth - 1][own]
            at, degree = at[degree > 0], degree[degree > 0]
            n, c = b.count[depth - 1][at - 1], b.count[depth][at]
            weight = weights(n, degree - 1)
            p[at] = (c + weight * p[at]) / (n + weight)
            touched[at] = True
            some = small[at]
            if some.any():
                at, n, c, weight = at[some], n[some], c[some], weight[some]
                lower = np.log10(weight) + logp[at]
                both = c > 0
                lower[both] = np.log10(c[both] + 10.0 ** lower[both])
                logp[at] = lower - np.log10(n + weight)
        touched &= ~small
        logp[touched] = np.log10(p[touched])
        rows = len(b.train)
        row = b.row[1:]
        sums = [np.bincount(row, weights=v[1:], minlength=rows) for v in (base[which], logp)]
        hits = np.bincount(row[b.count[0][1:] > 0], minlength=rows)
        return pa.table({
            "doc_id": b.table.column("doc_id"), "held_out": pa.array(~b.train), "n_tokens": pa.array(b.n + 1, pa.int64()), "n_known": pa.array(hits, pa.int64()),
            "train_tokens": pa.array([tokens] * rows, pa.int64()), "base_score": sums[0], "score": sums[1],
        })

    return run


def learn(vocabulary: DataFrame, blocks: int) -> Tree:
    """The spelling tree of the training words in ``vocabulary`` (those rows of the first answers)."""
    groups = max(12, blocks // 8)
    grams = vocabulary.withColumn("_group", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("_group").applyInArrow(_grams, "key long, n long")
    counted = Written(grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    context = F.shiftright("key", _BITS).alias("context")
    total = counted.df.groupBy(context).agg(F.sum("n").alias("total"))
    whole = total.where("context = 0").agg(F.sum("total")).first()[0] or 0
    frequent = total.where(F.col("total") >= P_MIN * whole)
    rows = counted.df.withColumn("context", F.shiftright("key", _BITS)).join(frequent, "context").select("key", "n").toArrow()
    counted.drop()
    return Tree.fit(rows.column("key").to_numpy(), rows.column("n").to_numpy())


def score(docs: DataFrame, held_out: Column) -> DataFrame:
    """SCORES for every row of ``docs``: the model, and a unigram base, learn from rows where held_out is not true.

    n_tokens counts the words and one end; n_known those tokens that occur in
    training; train_tokens is the number of training tokens; base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens; score is the tree's log10
    probability of the words and the end. Texts are scored whole, however long
    (one is held by one task). Scores do not depend on how documents are dealt.

    A null text counts as empty (an end alone); a null held_out as false; null
    and repeated doc_ids are rows like others, and each learns and is scored.
    Without training rows the model is uniform. No rows give none. Columns other
    than doc_id and text are read by ``held_out`` alone, whatever their names.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", (~F.coalesce(held_out, F.lit(False))).alias("_train"))
    n, blocks = deal_counts(rows)
    dealt = bucketed(rows, n)
    sent = dealt.groupBy("_bucket").applyInArrow(_send(1, blocks, 0), MESSAGE)
    first = materialize(sent.groupBy("block").applyInArrow(_answer, ANSWER), "answers", "zstd")
    # the messages are answered: their shuffle need not be kept beside the next
    release(spark)
    vocabulary = first.where("_bucket IS NULL")
    known, total = vocabulary.agg(F.sum("n"), F.sum("total")).first()
    known, total = known or 0, total or 0
    tree = spark.sparkContext.broadcast(learn(vocabulary.select("block", "words", "sizes"), blocks))
    answers = first.where("_bucket IS NOT NULL").select(F.lit(1).alias("round"), "_bucket", "block", "counts", "key_counts", "degrees")
    for r in range(2, WORDS + 2):
        sent = dealt.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(_send(r, blocks, total), MESSAGE)
        more = materialize(sent.groupBy("block").applyInArrow(_answer, ANSWER), "answers", "zstd")
        release(spark)
        answers = answers.unionByName(more.where("_bucket IS NOT NULL").select(F.lit(r).alias("round"), "_bucket", "block", "counts", "key_counts", "degrees"))
    return dealt.groupBy("_bucket").cogroup(answers.groupBy("_bucket")).applyInArrow(_score(tree, total, known), SCORES)
