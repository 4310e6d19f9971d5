"""Brute-force versions and a small corpus, for tests."""

import re
from collections import Counter

import numpy as np

WORD = re.compile("[^\x20\x09-\x0d]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def corpus(n=60, seed=0):
    """Invented documents with exact and near copies, shared passages, junk, nulls and one very long text."""
    rng = np.random.default_rng(seed)
    words = np.array(["".join(rng.choice(list("abcdefgh"), rng.integers(2, 7))) for _ in range(400)])
    passage = " ".join(rng.choice(words, 30))
    docs = []
    for i in range(n):
        w = rng.choice(words, rng.integers(25, 120)).tolist()
        text = " ".join(w)
        if i % 7 == 3:
            text = docs[-1][1]
        elif i % 7 == 5:
            text = " ".join([*docs[-1][1].split(" ")[:-1], "changed"]).capitalize()
        elif i % 5 == 1:
            text = f"{' '.join(w[:20])}\n{passage}\n{' '.join(w[20:])}"
        docs.append((i, text, "en"))
    docs += [(n, None, "en"), (n + 1, "", "en"), (n + 2, "one", "en"), (n + 3, "one", None), (n + 4, " \n\t ", "en"), (n + 5, "#a #b $c " * 20, "en"), (n + 6, " ".join(rng.choice(words, 30000)), "en")]
    return docs


def shingles(text, size):
    w = WORD.findall(lower(text))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute_components(data, size, similarity):
    sets = {i: shingles(t, size) for i, t, *_ in data}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= round(100 * similarity) * (len(sets[i]) + len(sets[j]) - both):
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in sets}


def brute_measures(text):
    t = text or ""
    w = WORD.findall(t)
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = set()
    for k in range(len(w) - 7):
        if c[tuple(w[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return {
        "n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", t)), "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered), "n_lines": len(lines), "n_stutters": sum(a == b for a, b in zip(w, w[1:], strict=False)), "n_shouted": sum(x.upper() == x and x.lower() != x for x in w),
    }


def brute_cut(data, size):
    first, out = {}, {}
    for i, t, *_ in sorted(data):
        w = WORD.findall(t or "")
        for k in range(len(w) - size + 1):
            first.setdefault(tuple(w[k : k + size]), i)
    for i, t, *_ in data:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out[i] = (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))
    return out
