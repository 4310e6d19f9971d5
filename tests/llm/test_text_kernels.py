"""Kernels, encoders and file formats against plain versions and the libraries."""

import random
import re
import time
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece as sp_library
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from waymark.llm import exchange, flat, substring, tokenfile, vocab
from waymark.llm.sentencepiece import PieceModel, read_model

WORD = re.compile("[^\x20\x09-\x0d]+")
TEXTS = st.lists(st.text(st.sampled_from(list("aAbB .,!'\n\t\x0b\x1c éßİ  ​日本😀1<|>")), max_size=40), max_size=6)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_words(texts):
    raw, off = flat.buffers(pa.array(texts, pa.string()))
    w = flat.words(raw, off, lower=False)
    got = [[raw[s:e].tobytes().decode() for s, e in zip(w.start[a:b], w.end[a:b], strict=True)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    assert got == [WORD.findall(t) for t in texts]


def test_equal_words_and_windows_hash_equal_across_spans(monkeypatch):
    monkeypatch.setattr(flat, "SPAN", 16)
    texts = ["the quick brown fox", "x the quick brown", "", "The QUICK brown", "a" * 200 + " the quick brown"]
    w = flat.words(*flat.buffers(pa.array(texts)), lower=True)
    h, at = flat.windows(w, 3)
    rows = w.row[at]
    assert h[rows == 0][0] == h[rows == 1][1] == h[rows == 3][0] == h[rows == 4][1]
    assert len(set(h.tolist())) == 4
    data = b"the" + b"quick"
    assert flat.hashes(np.frombuffer(data, np.uint8), np.array([3, 5])).tolist() == w.hash[:2].tolist()


def test_nulls_count_as_empty():
    raw, off = flat.buffers(pa.array([None, "a b", None], pa.string()))
    assert off.tolist() == [0, 0, 3, 3]
    assert flat.words(raw, off, False).first.tolist() == [0, 0, 2, 2]


@pytest.fixture(scope="module", params=["byte_bpe_50k.json", "word_bpe_49k.json"])
def both(request):
    text = vocab.read_vocabulary(public_tokenizers.path(request.param))
    library = Tokenizer.from_str(text)
    library.encode_special_tokens = True
    return vocab.Encoder(text), library


def test_encoder_equals_the_library(both):
    ours, library = both
    rng = random.Random(2)
    parts = ["a", "The", " ", "  ", "\n", ".", ",", "'s", "'", "é", "é", "日本", "1", "\t", "!", "😀", "<|endoftext|>", "\x0b", ")", "İ", "Σ", "̀", " ", " ", "\r\n", "\x1d", "Word,"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(30))) for _ in range(3000)]
    ids, count = ours.encode(*flat.buffers(pa.array([*texts, None], pa.string())))
    got = np.split(ids, np.cumsum(count)[:-1])
    assert [g.tolist() for g in got] == [x.ids for x in library.encode_batch([*texts, ""], add_special_tokens=False)]


def test_encoder_forgets_and_stays_exact(both, monkeypatch):
    ours, library = both
    monkeypatch.setattr(vocab.Encoder, "IDS", 500)
    for k in range(5):
        texts = [f"common words here and number {i * k} of {'x' * (i % 7)}" for i in range(60)]
        ids, count = ours.encode(*flat.buffers(pa.array(texts)))
        assert [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])] == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_queries_encode_as_the_library_does_when_loaded(name):
    text = vocab.read_vocabulary(public_tokenizers.path(name))
    ours, library = vocab.encoder(text), Tokenizer.from_str(text)
    rng = random.Random(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|endof", "text|>", "<|", "|>", " ", "  ", "\n", "Word", "end of it", ".", "é", "\u2003", "'s"]
    texts = ["end of it <|endoftext|> next", "<|endoftext|>", "<|endof", "text|>", *("".join(rng.choice(parts) for _ in range(rng.randrange(12))) for _ in range(2000))]
    ids, count = ours.encode(*flat.buffers(pa.array(texts, pa.string())))
    got = [g.tolist() for g in np.split(ids, np.cumsum(count)[:-1])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert any({49407, 50256} & set(g) for g in got)


@pytest.fixture(scope="module")
def pieces():
    path = public_tokenizers.path("piece_bpe_32k.model")
    return PieceModel(read_model(path)), sp_library.SentencePieceProcessor(model_file=path)


@given(TEXTS)
@settings(max_examples=60, deadline=None)
def test_merge_rounds_equal_the_library(pieces, texts):
    ours, library = pieces
    ids, count = ours.encode(texts)
    want = [[library.bos_id(), *library.encode(t), library.eos_id()] for t in texts]
    assert [x.tolist() for x in np.split(ids, np.cumsum(count)[:-1])][: len(texts)] == want
    assert ours.decode(ids, count) == [library.decode(w) for w in want]


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 700, " " * 50, "▁▁a ▁b", "hello   world\n\n\tx", "𝔘𝔫𝔦", None])
def test_merge_rounds_on_odd_texts(pieces, text):
    ours, library = pieces
    ids, _ = ours.encode([text])
    assert ids.tolist() == [1, *library.encode(text or ""), 2]


def unbroken(n, seed=0):
    rng = np.random.default_rng(seed)
    words = ["the", "tion", "in", "er", "qu", "zx", "anti", "BOX", "7", "ing", "house", "e", "ss", "aa"]
    return "".join(rng.choice(words, n))[:n]


@pytest.mark.parametrize("text", [unbroken(4000), unbroken(4000, 1).upper(), "ab" * 900 + "ba" * 700, "etaoinshrdlu" * 300, "tete" * 500 + "e", "日本語" * 300, "ſaſe" * 200])
def test_merge_rounds_on_unbroken_texts(pieces, text):
    ours, library = pieces
    ids, _ = ours.encode([text])
    assert ids.tolist() == [1, *library.encode(text), 2]


@given(st.text(st.sampled_from(list("aeinrst")), min_size=1, max_size=120))
@settings(max_examples=150, deadline=None)
def test_simultaneous_merges_equal_the_library(pieces, text):
    ours, library = pieces
    ids, _ = ours.encode([text, text * 5])
    assert ids.tolist() == [1, *library.encode(text), 2, 1, *library.encode(text * 5), 2]


def test_merge_rounds_are_nearly_linear(pieces):
    ours, _ = pieces

    def seconds(n):
        text = unbroken(n)
        began = time.process_time()
        ours.encode([text])
        return time.process_time() - began

    seconds(1000)
    assert min(seconds(400_000) for _ in range(2)) < 5 * min(seconds(100_000) for _ in range(2))


@pytest.mark.parametrize("bits", [False, True])
def test_planes_round_trip(bits):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000):
        ids = rng.integers(0, 2**32, n, dtype=np.uint32)
        assert tokenfile.from_planes(tokenfile.to_planes(ids, bits), n).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [False, True])
def test_token_file(tmp_path, bits):
    path = f"file://{tmp_path}/x.planes"
    w = tokenfile.Writer(path, bits, block=64)
    rng = np.random.default_rng(2)
    docs = [(None, 3), (5, 200), (6, 0), (9, 64), (11, 1)]
    ids = [rng.integers(0, 50257, n, dtype=np.uint32) for _, n in docs]
    w.add([d for d, _ in docs[:2]], np.concatenate(ids[:2]), np.array([3, 200]))
    w.add([d for d, _ in docs[2:]], np.concatenate(ids[2:]), np.array([0, 64, 1]))
    assert w.close() == (5, 268)
    r = tokenfile.Reader(path)
    assert [(d, x.tolist()) for d, x in r.documents()] == [(d, x.tolist()) for (d, _), x in zip(docs, ids, strict=True)]
    flat_ids = np.concatenate(ids)
    for a, b in ((0, 268), (63, 65), (100, 101), (5, 5), (200, 268)):
        assert r.ids(a, b).tolist() == flat_ids[a:b].tolist()
    r.close()


def test_empty_token_file(tmp_path):
    path = f"file://{tmp_path}/x.planes"
    tokenfile.Writer(path).close()
    assert list(tokenfile.Reader(path).documents()) == []


@pytest.mark.parametrize("kind", ["hashes", "keys", "one", "none", "equal upper bits"])
def test_unique_equals_numpy(kind):
    h = np.random.default_rng(8).integers(0, 2**64, 300, dtype=np.uint64)
    h = np.r_[h, h[::3], h[:7]]
    h = {"hashes": h, "keys": h & np.uint64((1 << 40) - 1), "one": h[:1], "none": h[:0], "equal upper bits": h & np.uint64(15) | np.uint64(1 << 63)}[kind]
    for got, expected in zip(flat.unique(h, first=True), (np.unique(h), *np.unique(h, return_inverse=True, return_index=True)[:0:-1]), strict=True):
        assert np.array_equal(got, expected)
    assert len(flat.unique(h)) == 2


def test_spellings_tell_words_apart():
    """Equal words of any length have equal hashes wherever they stand, others do not, those that differ in one byte or in length included."""
    rng = np.random.default_rng(9)
    words = [bytes(rng.integers(0, 3, n).astype(np.uint8)) for n in [*range(1, 20), 63, 64, 65, 72, 73, 200, 5000] for _ in range(4)]
    words += [w[:k] + b"\x07" + w[k + 1 :] for w in words[-20:] for k in (0, 7, 8, len(w) - 1)] + [b"", b"\0", b"\0\0", b"\0" * 8, b"\0" * 9, b"\0" * 65]
    every = words + words[::-1]
    size = np.array([len(w) for w in every])
    h = flat.spellings(np.frombuffer(b"".join(every), np.uint8), np.cumsum(size) - size, size)
    assert len({*h.tolist()}) == len({*words})
    assert len({*zip(every, h.tolist(), strict=True)}) == len({*words})


def test_words_join_no_rows():
    for texts in (["ab", "cd", "", " e", "f "], ["", ""], [" "], [], ["a"], ["A b\x08\x0e\x0b", "\t", "x"]):
        raw, off = flat.buffers(pa.array(texts, pa.string()))
        w = flat.words(raw, off, lower=True)
        got = [(r, bytes(w.data[s:e]).decode()) for r, s, e in zip(w.row.tolist(), w.start.tolist(), w.end.tolist(), strict=True)]
        expected = [(i, x) for i, t in enumerate(texts) for x in re.findall(r"[^\x20\x09-\x0D]+", t.lower())]
        assert got == expected
        assert np.array_equal(w.first, np.searchsorted(w.row, np.arange(len(texts) + 1)))


@pytest.mark.parametrize("turn", [substring.TURN, 50])
def test_index_unpacks_only_anchors_that_occur_twice(monkeypatch, turn):
    """Messages of distinct anchors, but for some that each has: all of these look in the bucket with the smallest document."""
    monkeypatch.setattr(substring, "TURN", turn)
    rng, messages, n, common = np.random.default_rng(10), 30, 8000, 200
    some = rng.permutation(np.unique(rng.integers(0, 2**40, common + messages * n + 99, dtype=np.uint64)))
    shared, own = some[:common], some[common : common + messages * n].reshape(messages, n)
    parts, where = [], []
    for m in range(messages):
        h = np.sort(np.r_[shared, own[m]])
        sides = np.full((len(h), 8), 7, np.uint8)[:, : substring._SIDE].tobytes()
        parts.append((exchange.keys(h).tobytes(), sides, sides, substring._planes(np.full(len(h), (m - 4) % messages))))
        where.append(np.flatnonzero(np.isin(h, shared)))
    table = pa.table([pa.array([3] * messages, pa.int32()), pa.array(range(100, 100 + messages), pa.int32()), *(exchange.binary([x[k] for x in parts]) for k in range(4))], names=["block", "_bucket", "anchors", "left", "right", "docs"])
    tracemalloc.start()
    got = substring._index(13)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * table.nbytes
    assert got.column("_bucket").to_pylist() == table.column("_bucket").to_pylist()
    for m, entries, targets in zip(range(messages), got.column("entries").to_pylist(), got.column("targets").to_pylist(), strict=True):
        assert np.array_equal(np.frombuffer(entries, "<i4"), where[m])
        assert {*np.frombuffer(targets, "<i4").tolist()} == {-1 if m == 4 else 104}
