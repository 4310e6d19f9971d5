"""The ten operators against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import base64
import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from brute import WORD, brute_components, brute_cut, brute_measures, corpus, lower

from waymark.llm import chat, embeddings, lm, neardup, packing, quality, sentencepiece, substring, tokenfile, vocab, warc

DOCS = "doc_id long, text string, lang string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# --- packing ---


def check_plan(lengths, demand, capacity):
    plan = packing.solve(lengths, demand, capacity)
    covered = np.zeros(len(lengths), np.int64)
    for at, copies, n in plan.configurations:
        assert (lengths[at] * copies).sum() <= capacity
        assert copies.min() > 0 < n
        covered[at] += copies * n
    assert (covered == demand).all()
    assert plan.bound <= plan.sequences <= plan.bound + len(plan.configurations)
    return plan


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("times", [1, 50])
def test_packing_plan_is_near_the_bound(seed, times):
    rng = np.random.default_rng(seed)
    x = np.minimum(np.maximum(1, rng.lognormal(4, 1, 3000).astype(int)), 512)
    lengths, demand = np.unique(x, return_counts=True)
    plan = check_plan(lengths, demand * times, 512)
    assert plan.bound >= math.ceil(times * x.sum() / 512)
    assert plan.gap <= 0.01
    assert plan.share >= 0.9


def test_packing_plan_edges():
    empty = packing.solve(np.zeros(0, np.int64), np.zeros(0, np.int64), 8)
    assert (empty.configurations, empty.sequences, empty.bound, empty.gap) == ([], 0, 0, 0.0)
    for lengths, demand, used in (([8], [5], 5), ([5], [4], 4), ([3, 5], [7, 7], 7), ([1], [17], 3), ([1, 4096], [10**9, 3], None)):
        plan = check_plan(np.array(lengths), np.array(demand), 8 if used else 4096)
        assert plan.sequences == plan.bound == (used or -(-(10**9) // 4096) + 3)


def test_the_dual_bound_sees_what_can_not_be_filled():
    # two of 5 never share a sequence of 9; room for 12 of 4 is left beside them
    plan = check_plan(np.array([4, 5]), np.array([30, 12]), 9)
    assert plan.sequences == plan.bound == 21


def test_knapsack_prices_the_best_configuration():
    value = np.array([3.0, 4.5, 5.1])
    assert packing.best_configuration(np.array([3, 4, 5]), value, np.array([9, 9, 9]), 9)[1].tolist() == [0, 1, 1]
    assert packing.best_configuration(np.array([3, 4, 5]), value, np.array([9, 9, 0]), 9)[1].tolist() == [0, 2, 0]
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths, most = np.sort(rng.choice(np.arange(1, 20), 4, replace=False)), rng.integers(0, 4, 4)
        value = rng.random(4)
        every = [c for c in np.ndindex(*(most + 1)) if np.dot(c, lengths) <= 25]
        top, copies = packing.best_configuration(lengths, value, most, 25) if most.any() else (0.0, np.zeros(4))
        assert top == pytest.approx(max(np.dot(c, value) for c in every))
        assert np.dot(copies, value) == pytest.approx(top)


def test_pack_documents(spark, docs):
    data, df = docs
    text = vocab.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    library = Tokenizer.from_str(text)
    got = packing.pack_documents(df, text, 1, 512).collect()
    want = {}
    for i, t, _ in data:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 512)):
            want[i, k] = (s, min(512, len(ids) - s), zlib.crc32(ids[s : s + 512].tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        p.sort()
        assert [o for o, _ in p] == [sum(n for _, n in p[:i]) for i in range(len(p))]
        assert sum(n for _, n in p) <= 512
    assert len(places) <= math.ceil(1.02 * sum(r.length for r in got) / 512) + 1


def test_pack_repeated_and_null_rows(spark, empty):
    text = vocab.read_vocabulary(public_tokenizers.path("word_bpe_49k.json"))
    df = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, "c", None), (2, None, None)], DOCS)
    got = packing.pack_documents(df, text, 1, 16).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 2), (1, 3), (1, 3), (2, 1)]
    assert sorted((r.sequence_id, r.offset) for r in got) == sorted({(r.sequence_id, r.offset) for r in got})
    assert packing.pack_documents(empty, text, 1, 16).count() == 0
    with pytest.raises(ValueError, match="lengths"):
        packing.pack(spark.createDataFrame([(1, 0, 0, 99, 0)], packing.PIECES), 16)


# --- language model ---


def test_lm_counts_and_base(spark, docs):
    data, df = docs
    out = {r.doc_id: r for r in lm.score(df, F.col("doc_id") % 4 == 1).collect()}
    tokens = {i: [*WORD.findall(lower(t)), 0] for i, t, _ in data}
    c = Counter(w for i, ws in tokens.items() if i % 4 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in tokens.items():
        r = out[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i % 4 == 1, len(ws), sum(c[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws))
        assert r.score < 0


def test_lm_beats_the_base_on_held_out_texts(spark):
    rng = np.random.default_rng(6)
    phrases = [" ".join("".join(rng.choice(list("abcde"), 4)) for _ in range(6)) for _ in range(40)]
    data = [(i, " ".join(rng.choice(phrases, 10)), None) for i in range(80)]
    out = lm.score(spark.createDataFrame(data, DOCS), F.col("doc_id") % 4 == 1).where("held_out").collect()
    assert all(r.score > 0.6 * r.base_score for r in out)


def test_lm_does_not_depend_on_the_blocks(spark, monkeypatch):
    # a word that is a third of all tokens, with followers of its own, and rarer words around it
    rng = np.random.default_rng(5)
    pick = lambda k, n: f"{k}{int(n * rng.random() ** 2)}"
    data = [(i, " ".join(f"{pick('a', 40)} the {pick('n', 15)}" for _ in range(rng.integers(1, 40))), "") for i in range(300)]
    df, held, got = spark.createDataFrame(data, DOCS), F.col("doc_id") % 5 == 1, {}
    for deal in ((1, 1), (24, 7), (200, 200)):
        monkeypatch.setattr(lm, "deal_counts", lambda rows, d=deal: d)
        got[deal] = {r.doc_id: r.score for r in lm.score(df, held).collect()}
    for deal in list(got)[1:]:
        assert got[deal] == pytest.approx(got[1, 1], rel=1e-9, abs=1e-6)


def spelling_tree(words):
    table = Counter()
    for w in words:
        seq = [32, *w.encode(), 32]
        for j in range(1, len(seq)):
            for d in range(min(lm.DEPTH, j) + 1):
                code = sum((seq[j - k] + 1) << (9 * (k - 1)) for k in range(1, d + 1))
                table[(code << 9) | (seq[j] + 1)] += 1
    return lm.Tree.fit(np.array(list(table), np.int64), np.array(list(table.values()), np.int64))


class BruteModel:
    """The word storey by dictionaries of tuples; spellings by the tree itself."""

    def __init__(self, texts):
        self.count = Counter()
        for t in texts:
            s = ["", *t, ""]
            for j in range(1, len(s)):
                for n in range(1, min(lm.WORDS + 1, j + 1) + 1):
                    self.count[tuple(s[j - n + 1 : j + 1])] += 1
        self.uses = lambda s: self.count[s] if s != ("",) else len(texts)
        self.tokens = sum(c for s, c in self.count.items() if len(s) == 1)
        words = sorted({s[0] for s in self.count if len(s) == 1 and s[0]})
        self.known = len({s for s in self.count if len(s) == 1})
        self.tree = spelling_tree(words)
        follow = {}
        for s, c in self.count.items():
            if len(s) > 1:
                follow.setdefault(s[:-1], {})[s[-1]] = c
        self.weight = {}
        for s, nexts in follow.items():
            if self.examined(s):
                gains = []
                for k in range(len(lm.SHARES)):
                    n, w = self.uses(s), max(lm.LEAST_WEIGHT, lm.SHARES[k] * self.uses(s))
                    gains.append((sum(c * round(lm.GRAIN * math.log((c - 1 + w * self.suffix(s, x)) / (n - 1 + w) / self.suffix(s, x))) for x, c in nexts.items()), w))
                best = max(g for g, _ in gains)
                if best > lm.GRAIN * lm.LEAST_GAIN:
                    self.weight[s] = next(w for g, w in gains if g == best)

    def examined(self, s):
        n = self.uses(s)
        return n >= 2 and (len(s) == 1 or n != self.uses(s[1:]))

    def suffix(self, s, x):
        q = self.count[(x,)] / self.tokens
        for d in range(1, len(s)):
            if self.examined(s[len(s) - d :]):
                q = (self.count[(*s[len(s) - d :], x)] + q) / (self.uses(s[len(s) - d :]) + 1)
        return q

    def p(self, before, x):
        k = max(self.known, 1)
        spelt = 1 / (k + 1) if x == "" else k / (k + 1) * 10 ** self.tree.words(np.frombuffer(x.encode(), np.uint8), np.array([len(x.encode())]))[0]
        out = (self.count[(x,)] + k * spelt) / (self.tokens + k)
        for d in range(1, min(lm.WORDS, len(before)) + 1):
            s = tuple(before[-d:])
            if s in self.weight:
                w = self.weight[s]
                out = (self.count[(*s, x)] + w * out) / (self.uses(s) + w)
        return out


def phrases(seed, n):
    """Texts of few words, with phrases that come back, one hot word, and documents that occur twice."""
    rng = np.random.default_rng(seed)
    words = [f"w{k}" for k in range(12)]
    texts = []
    for i in range(n):
        w = []
        for _ in range(rng.integers(0, 9)):
            w += [["a", "b", "c", "d"], ["a", "b", "e"], ["the"], rng.choice(words, 2).tolist(), ["x", "b", "c", "f"]][rng.integers(5)]
        texts.append(texts[-1] if i % 9 == 8 else w)
    return texts


def test_lm_scores_equal_brute_force(spark, monkeypatch):
    texts = phrases(1, 120)
    monkeypatch.setattr(lm, "deal_counts", lambda rows: (5, 3))
    df = spark.createDataFrame([(i, " ".join(t).upper(), None) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.score for r in lm.score(df, F.col("doc_id") % 4 == 1).collect()}
    model = BruteModel([t for i, t in enumerate(texts) if i % 4 != 1])
    assert {len(s) for s in model.weight} == {1, 2, 3}
    for i, t in enumerate(texts):
        s = ["", *t, ""]
        assert got[i] == pytest.approx(sum(math.log10(model.p(s[:j], s[j])) for j in range(1, len(s))), rel=1e-9)


def test_lm_adds_up_to_one_at_most():
    texts = phrases(2, 60)
    model = BruteModel(texts)
    vocabulary = ["", *sorted({w for t in texts for w in t})]
    for context in ([""], ["", "a"], ["a", "b"], ["x", "b", "c"], ["", "zzz"]):
        known = sum(model.p(context, x) for x in vocabulary)
        assert 0.5 < known < 1


def test_lm_tells_texts_that_occur_twice(spark):
    rng = np.random.default_rng(7)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(90)]
    texts += texts[:15]
    out = lm.score(spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], DOCS), F.lit(False)).collect()
    gain = {r.doc_id: r.score - r.base_score for r in out}
    assert min(gain[i] for i in range(15)) > max(gain[i] for i in range(15, 90)) + 60


def test_lm_is_a_distribution(spark):
    """Probabilities of all next words after a context, known ones and the rest by spelling, add up to 1."""
    words = ["aa", "ab", "ba", "abc"]
    tree = spelling_tree(words)
    data, size = np.frombuffer("".join(words).encode(), np.uint8), np.array([len(w) for w in words])
    assert tree.words(data, size).max() < 0
    for state in range(len(tree.parent)):
        p = 10 ** tree._next(np.full(256, state), np.arange(256))
        assert p.sum() == pytest.approx(1, abs=1e-9)


def test_lm_edges(spark, empty):
    held = F.col("doc_id") == 1
    assert lm.score(empty, held).count() == 0
    df = spark.createDataFrame([(1, "x y", None), (2, None, None), (None, "a a", None), (2, None, None)], DOCS)
    got = lm.score(df, held).collect()
    assert sorted((r.doc_id or -1, r.held_out, r.n_tokens, r.n_known) for r in got) == [(-1, False, 3, 3), (1, True, 3, 1), (2, False, 1, 1), (2, False, 1, 1)]
    assert all(r.train_tokens == 5 for r in got)
    alone = lm.score(df.where("doc_id = 1"), held).first()
    assert (alone.n_known, alone.train_tokens) == (0, 0)
    assert np.isfinite(alone.score)


# --- near duplicates ---


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, size):
    data, df = docs
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(df, size, 0.8).collect()}
    assert got == brute_components(data, size, 0.8)
    assert sum(not k for _, _, k in got.values()) > 10


def test_near_duplicates_of_a_torn_group(spark):
    """Copies around the threshold share buckets without being linked to a bucket's first or last member."""
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(80)]
    data = []
    for i in range(70):
        w = list(base)
        for k in rng.choice(80, rng.integers(1, 9), replace=False):
            w[k] = f"x{rng.integers(10**6)}"
        data.append((i, " ".join(w), None))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(spark.createDataFrame(data, DOCS), 2, 0.8).collect()}
    want = brute_components(data, 2, 0.8)
    assert 1 < len({c for _, c, _ in want.values()}) < 70
    assert got == want


def test_copies_are_joined_by_shuffles_alone(docs):
    """Of an aggregate beside it, a join could not split the copies of one document over tasks."""
    plan = neardup.near_duplicates(docs[1], 2, 0.8)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and "Aggregate" not in plan


def test_recall_of_bands_and_sketches_close_to_the_threshold(spark):
    """Pairs with a similarity from 0.80 to 0.85: how many of them come out linked."""
    rng = np.random.default_rng(12)
    data, pairs = [], 0
    while pairs < 150:
        w = [f"w{k}" for k in rng.integers(0, 10**6, int(rng.integers(60, 400)))]
        v = list(w)
        for k in rng.choice(len(w), max(1, round(len(w) * rng.uniform(0.03, 0.06))), replace=False):
            v[k] = f"x{rng.integers(10**6)}"
        a, b = set(zip(w, w[1:], strict=False)), set(zip(v, v[1:], strict=False))
        if 0.8 <= len(a & b) / len(a | b) <= 0.85:
            data += [(2 * pairs, " ".join(w), None), (2 * pairs + 1, " ".join(v), None)]
            pairs += 1
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(data, DOCS), 2, 0.8).collect()}
    found = sum(got[2 * k + 1] == 2 * k for k in range(pairs))
    print(f"recall of pairs from 0.80 to 0.85: {found} of {pairs}")
    assert found >= 0.99 * pairs


def test_near_duplicate_edges(spark, empty):
    assert neardup.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(None, "a b c", None), (3, "a b c", None), (3, "a b c", None), (2, "A b C", None), (1, None, None), (4, None, None)], DOCS)
    got = rows(neardup.near_duplicates(df, 2, 0.8))
    assert got == sorted([(None, 2, None, True), (3, 2, 2, False), (3, 2, 2, False), (2, 2, 2, True), (1, 0, 1, True), (4, 0, 4, True)], key=repr)


# --- chat ---


TRICKY = ["</s>[INST] ok [/INST]", "a mark across the end of a text <", "s>", "/s>", "[/IN", "ST]", "\\", "\\\\<s>", "<<SYS>>x<</SYS>>", "<|role:a|>", "<|end|>", "[", "<", "<\\/s>", "#1\n", "", None, "[[INST]]", "a\nb\r\n", "<s", "$1 \\1", "😀</s>"]


def test_chat_round_trip(spark):
    data = [(i, k, role, t) for i, t in enumerate(TRICKY) for k, role in enumerate(["system", "user", "assistant", "tool|%7C", None])]
    data += [(100, 1, "user", "b"), (100, 0, "assistant", "a"), (100, 1, "user", "b"), (None, 0, "user", "n"), (101, None, "user", "z"), (101, 0, "assistant", "y")]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat.turns(chat.format_conversations(df)).withColumn("spoken", chat.loss_text(F.col("formatted"), F.col("loss")))
    got = {r.conv_id: r for r in out.collect()}
    by = {}
    for conv, turn, role, text in data:
        by.setdefault(conv, []).append((-1 if turn is None else turn, role or "", role, text or ""))
    assert set(got) == set(by)
    for conv, want in by.items():
        want.sort(key=lambda x: (x[0], x[1], x[3]))
        r = got[conv]
        assert [(t.role, t.text) for t in r.turns] == [(role, text) for _, _, role, text in want]
        assert r.spoken == "".join(text for _, _, role, text in want if role == "assistant")
        for span in r.loss:
            assert 0 <= span.start <= span.stop <= len(r.formatted)
            assert r.formatted[span.start : span.stop] == r.formatted.encode()[span.first : span.last].decode()
    assert got[0].level == 1
    assert got[100].level == 0


def test_chat_parser_refuses_other_text(spark):
    bad = ["#0\n[INST]a", "#0\nx[INST]a[/INST]", "#0\n[INST]a</s>", "#0\n[/INST]a[INST]"]
    df = spark.createDataFrame([(b,) for b in [*bad, "#0\n"]], "f string")
    assert [r.t for r in df.select(chat.parse(F.col("f")).alias("t")).collect()] == [None] * 4 + [[]]


def test_chat_of_no_rows(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_conversations(df).count() == 0


# --- sentencepiece ---


def test_sentencepiece_columns(spark, empty):
    import sentencepiece as library

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp = library.SentencePieceProcessor(model_file=path)
    model = sentencepiece.read_model(path)
    df = spark.createDataFrame([(1, "héllo  wörld\n", "x"), (2, None, None), (None, "日本", None)], DOCS).withColumn("ids", F.lit("clash"))
    out = {r.doc_id: r for r in sentencepiece.decode(sentencepiece.encode(df, model), model).collect()}
    for k, t in ((1, "héllo  wörld\n"), (2, ""), (None, "日本")):
        ids = [1, *sp.encode(t), 2]
        assert np.frombuffer(out[k].ids, "<u4").tolist() == ids
        assert (out[k].n_tokens, out[k].decoded) == (len(ids), sp.decode(ids))
    assert sentencepiece.encode(empty, model).count() == 0


# --- quality ---


ODD = ["a b c d e f g h a b c d e f g h", "x " * 40, "a\na\n\n a\nb\n", "THE END", "é É ß 日本 \x0b \x0c", "", None, "<a>|&*%$#", "a b c d e f g h i " * 3]


def test_measures(spark, docs):
    data, df = docs
    more = spark.createDataFrame([(1000 + i, t, None) for i, t in enumerate(ODD)], DOCS)
    names = [*quality.REPORTED, "n_lines", "n_stutters", "n_shouted"]
    out = quality.measured(df.union(more).withColumn("n_words", F.lit("clash")).withColumn("_words", F.lit(1)), report=names).collect()
    texts = {i: t for i, t, _ in data} | {1000 + i: t for i, t in enumerate(ODD)}
    for r in out:
        m = brute_measures(texts[r.doc_id])
        assert {k: r[k] for k in m} == m, texts[r.doc_id]
        rejected = m["n_words"] < 20 or 100 * m["n_repeat_words"] > 30 * m["n_words"]
        if rejected:
            assert r.rejected_by


def test_cascade_order_does_not_change_the_verdict(docs):
    _, df = docs
    kept = rows(quality.quality_filter(df))
    for rules in (quality.RULES, quality.RULES[::-1]):
        again = df.where(quality.verdict(F.col("text"), rules).isNull())
        assert rows(again) == kept
    assert 0 < len(kept) < df.count()
    assert {r.name for r in quality.ordered_rules(df)} == {r.name for r in quality.RULES}
    free = quality.ordered_rules(df, known=quality.REPORTED)
    assert {r.name for r in free[:4]} == {"few_words", "repeats", "symbols", "word_length"}


def test_late_measures_are_taken_inside_the_cascade(docs):
    _, df = docs
    plan = quality.measured(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1
    before = plan[: plan.index("upper(")]
    assert before.rindex("CASE WHEN") > before.rfind("Project")
    assert " AS " not in before[before.rindex("CASE WHEN") :]
    with_all = quality.measured(df, report=[*quality.REPORTED, "n_lines", "n_stutters", "n_shouted"])
    assert rows(quality.measured(df).select("doc_id", F.col("rejected_by").isNull())) == rows(with_all.select("doc_id", F.col("rejected_by").isNull()))


def test_quality_of_no_rows(empty):
    assert quality.quality_filter(empty).count() == 0
    assert quality.measured(empty).count() == 0


# --- embeddings ---


def brute_links(x, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T >= cosine
    np.fill_diagonal(s, False)
    label = np.arange(len(x))
    while True:
        new = np.array([min(label[i], *label[s[i]]) if s[i].any() else label[i] for i in range(len(x))])
        if (new == label).all():
            return s.sum(1), label
        label = new


def test_near_vectors(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 16))
    for i in range(100, 300):
        y = x[i % 40] / np.linalg.norm(x[i % 40])
        x[i] = y + rng.normal(size=16) * 0.06
    x[300:320] = x[7]
    df = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    links, label = brute_links(x, 0.9)
    for chunk in (2048, 40):
        monkeypatch.setattr(embeddings, "CHUNK", chunk)
        monkeypatch.setattr(embeddings, "CELL", 20)
        monkeypatch.setattr(embeddings, "INDEXED", 100)
        got = sorted(embeddings.near_vectors(df, 0.9).collect())
        found = np.array([r.n_links for r in got])
        assert (found <= links).all()
        assert found.sum() >= 0.99 * links.sum()
        assert np.mean([r.component_id == c for r, c in zip(got, label, strict=True)]) > 0.99
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_traversal_visits_the_nearest_cells_in_order():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, 6))
    index = embeddings.Index((rng.normal(size=(7, 3)), rng.normal(size=(5, 3))), 9)
    border = [np.maximum(b, 0) for b in index.borders(x)]
    every = (border[0][:, :, None] + border[1][:, None, :]).reshape(60, -1)
    got = index.traverse(x, 9)
    assert np.allclose(np.take_along_axis(every, got, 1), np.sort(every, axis=1)[:, :9])
    assert all(len(set(g)) == 9 for g in got.tolist())
    own = [embeddings._distances(h, c).argmin(1) for h, c in zip((x[:, :3], x[:, 3:]), index.books, strict=True)]
    assert (got[:, 0] == own[0] * 5 + own[1]).all()


def test_near_vectors_of_two_widths(spark, monkeypatch):
    """Each width has links of its own, also the rarer one, and extra columns with clashing names do no harm."""
    monkeypatch.setattr(embeddings, "CHUNK", 30)
    monkeypatch.setattr(embeddings, "INDEXED", 60)
    rng = np.random.default_rng(9)
    x = {i: (lambda v: v + rng.normal(size=len(v)) * 0.05)(np.eye(6 if i % 4 else 9)[i % 5]).tolist() for i in range(200)}
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in x.items()], "vec_id long, embedding array<double>, n_links int, head int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_vectors(df, 0.9).collect()}
    for w in (6, 9):
        ids = [i for i, v in x.items() if len(v) == w]
        links, label = brute_links(np.array([x[i] for i in ids]), 0.9)
        assert {i: got[i] for i in ids} == {i: (n, ids[c]) for i, n, c in zip(ids, links, label, strict=True)}


def test_near_vector_edges(spark):
    kind = "vec_id long, embedding array<float>, label int"
    df = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [2.0, 0.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (5, [None, 1.0], 0), (6, [float("nan"), 1.0], 0), (7, [float("inf"), 1.0], 0), (8, [], 0), (9, [1.0, 0.0, 0.0], 0), (11, [1.0, 0.1, 0.0], 0), (12, [3.0], 0), (13, [4.0], 0), (14, [-4.0], 0), (None, [1.0, 0.0], 0), (10, [0.0, 1.0], 0), (10, [0.0, 1.0], 0)], kind)
    got = rows(embeddings.near_vectors(df))
    want = [(1, 1, 1, True), (2, 1, 1, False), *((i, 0, i, True) for i in range(3, 9)), (9, 1, 9, True), (11, 1, 9, False), (12, 1, 12, True), (13, 1, 12, False), (14, 0, 14, True), (None, 0, None, True), (10, 1, 10, True), (10, 1, 10, True)]
    assert got == sorted(want, key=repr)
    assert embeddings.near_vectors(spark.createDataFrame([], kind)).count() == 0
    assert rows(embeddings.near_vectors(df.where("vec_id = 4"))) == [(4, 0, 4, True)]


# --- substring ---


@pytest.mark.parametrize("size", [5, 13])
def test_remove_repeats(docs, size):
    data, df = docs
    got = {r.doc_id: r for r in substring.remove_repeats(df, size, join_all=True).collect()}
    assert {i: (r.n_words, r.n_removed, r.text) for i, r in got.items()} == brute_cut(data, size)
    for r in got.values():
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
    assert sum(r.n_removed for r in got.values()) > 100


def test_factors_are_copies_of_their_sources(docs):
    data, df = docs
    words = {i: WORD.findall(t or "") for i, t, _ in data}
    seen = 0
    for r in substring.remove_repeats(df, 13).collect():
        covered = set()
        for f in r.factors:
            assert f.source < r.doc_id
            assert f.length >= 13
            assert words[r.doc_id][f.start : f.start + f.length] == words[f.source][f.position : f.position + f.length]
            covered.update(range(f.start, f.start + f.length))
            seen += 1
        assert len(covered) == r.n_removed
    assert seen > 10


def plain_words(texts):
    from waymark.llm import flat

    return flat.words(*flat.buffers(pa.array(texts)), lower=False)


@pytest.mark.parametrize("seed", range(6))
def test_greedy_parse_covers_all_windows(seed):
    """Texts over few words, whose windows often straddle two sources."""
    rng = np.random.default_rng(seed)
    text = lambda n: " ".join(rng.choice(list("abc"), n))
    ref = [text(rng.integers(1, 60)) for _ in range(12)]
    ask = [text(rng.integers(1, 90)) for _ in range(10)] + [" ".join(ref[3:6]), ref[2] + " " + ref[2]]
    ref_doc, ask_doc = np.sort(rng.integers(0, 20, 12)), rng.integers(0, 22, 12)
    r, q = plain_words(ref), plain_words(ask)
    at, source, length = substring.longest_factors(r, ref_doc, q, ask_doc, 4)
    covered = set()
    for a, s, n in zip(at, source, length, strict=True):
        assert (q.hash[a : a + n] == r.hash[s : s + n]).all()
        assert q.row[a] == q.row[a + n - 1]
        assert r.row[s] == r.row[s + n - 1]
        assert ref_doc[r.row[s]] < ask_doc[q.row[a]]
        more = a + n < q.first[q.row[a] + 1] and s + n < r.first[r.row[s] + 1]
        assert not more or q.hash[a + n] != r.hash[s + n]
        covered.update(range(a, a + n))
    want = set()
    for k, t in enumerate(ask):
        w = t.split()
        for p in range(len(w) - 3):
            if any(ref_doc[j] < ask_doc[k] and w[p : p + 4] == u[x : x + 4] for j, u in enumerate(map(str.split, ref)) for x in range(len(u) - 3)):
                want.update(range(q.first[k] + p, q.first[k] + p + 4))
    assert covered == want


@pytest.mark.parametrize("deal", [(1, 1), (7, 3), (300, 50)])
def test_remove_repeats_does_not_depend_on_the_blocks(spark, monkeypatch, deal):
    rng = np.random.default_rng(11)
    shared = [" ".join(rng.choice([f"w{k}" for k in range(50)], n)) for n in (13, 13, 20, 40)]
    data = []
    for i in range(120):
        parts = [" ".join(rng.choice([f"w{k}" for k in range(9)], rng.integers(0, 12))) for _ in range(4)]
        for k in rng.choice(4, rng.integers(0, 3), replace=False):
            parts.insert(int(rng.integers(5)), shared[k])
        # one passage in all documents, after the same word or not, and one text in a third of them
        data.append((i, " ".join([*parts, shared[0]]) if i % 3 else "same " * 30, None))
    monkeypatch.setattr(substring, "deal_counts", lambda docs: deal)
    monkeypatch.setattr(substring, "CHUNK_BYTES", 300)
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(spark.createDataFrame(data, DOCS), 13, join_all=True).collect()}
    assert got == brute_cut(data, 13)


def test_remove_repeats_keeps_untouched_texts_and_columns(docs):
    data, df = docs
    want = brute_cut(data, 13)
    texts = {i: t for i, t, _ in data}
    for r in substring.remove_repeats(df.withColumn("spans", F.lit("clash")).withColumn("source", F.lit("s")), 13).collect():
        n, removed, joined = want[r.doc_id]
        assert r.text == (joined if removed else texts[r.doc_id])
        assert r.source == "s"


def test_remove_repeat_edges(spark, empty):
    assert substring.remove_repeats(empty, 3).count() == 0
    df = spark.createDataFrame([(None, "a b c d", None), (5, "a b c d", None), (5, "a b c d", None), (6, "x a b c d y", None), (7, None, None)], DOCS)
    got = rows(substring.remove_repeats(df, 3).select("doc_id", "text", "n_removed"))
    assert got == sorted([(None, "a b c d", 0), (5, "a b c d", 0), (5, "a b c d", 0), (6, "x y", 4), (7, None, 0)], key=repr)


# --- WARC ---


PAGES = [(1, "http://a/1", "<p>x</p>"), (2, "http://a/2", "<p>x</p>"), (3, None, "y"), (4, "u\r\nv%", None), (5, "http://b", ""), (None, "n", "<p>x</p>"), (7, "http://c", "é" * 5000), (9, " http://x/a%20b%25 \u00a0", "z"), (10, "http://x/a%20b%0A", "q"), (11, "", "w"), (12, " \t", "v"), (8, "http://c", "<p>x</p>"), (8, "http://d", "<p>x</p>")]


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("payload", F.lit("clash"))
    return warc.write_archives(df.repartition(3))


def test_warc_round_trip(spark, archive):
    got = [r.asDict() for r in warc.read_archives(spark, archive).collect()]
    assert len(got) == len(PAGES)
    by_url = {}
    for page, url, html in PAGES:
        by_url.setdefault((page, url), (html or "").encode())
    for r in got:
        payload = by_url[r["page_id"], r["target_uri"]]
        assert r["payload_bytes"] == len(payload)
        assert r["payload_digest"] == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert r["payload"] == (b"" if r["record_type"] == "revisit" else payload)
    kinds = {(r["page_id"], r["target_uri"]): (r["record_type"], r["refers_to"]) for r in got}
    assert kinds[1, "http://a/1"] == kinds[2, "http://a/2"] == ("revisit", 8)
    assert kinds[8, "http://c"] == kinds[8, "http://d"] == kinds[None, "n"] == ("response", None)
    assert kinds[4, "u\r\nv%"] == ("revisit", 5)


def test_warc_pushdown(spark, archive):
    some = warc.read_archives(spark, archive, payload="none").where("record_type = 'revisit' AND page_id > 1 AND payload_digest IS NOT NULL")
    assert rows(some.select("page_id", "payload")) == [(2, None), (4, None)]
    reader = warc.WarcReader(archive, {})
    from pyspark.sql.datasource import EqualTo, Not

    assert list(reader.pushFilters([EqualTo(("record_type",), "response"), Not(EqualTo(("page_id",), 3)), EqualTo(("payload",), b"")])) != []
    assert len(reader.tests) == 2


def test_warc_least_bytes(spark):
    df = spark.createDataFrame([(1, "a", "xy"), (2, "b", "xy"), (3, "c", "long text"), (4, "d", "long text")], "page_id long, url string, html string")
    kinds = {r.page_id: r.record_type for r in warc.with_revisits(df, 5).collect()}
    assert kinds == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_warc_of_no_pages(spark):
    path = warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"))
    assert warc.read_archives(spark, path).count() == 0


def test_warc_of_other_writers(spark, tmp_path):
    import gzip

    one = warc.record(1, "http://x", "response", None, warc.digest(b"abc" * 9000), b"abc" * 9000)
    two = warc.record(2, "http://y", "response", None, warc.digest(b"z"), b"z")
    (tmp_path / "plain.warc").write_bytes(one + two)
    (tmp_path / "other.warc.gz").write_bytes(gzip.compress(one) + gzip.compress(two))
    got = rows(warc.read_archives(spark, f"file://{tmp_path}").select("page_id", F.length("payload")))
    assert got == [(1, 27000), (1, 27000), (2, 1), (2, 1)]


@pytest.mark.parametrize("fields", [False, True])
def test_warc_of_several_records_in_a_member(spark, tmp_path, fields):
    import gzip

    pages = [(i, bytes([65 + i]) * n) for i, n in enumerate((3, 9000, 0, 3_000_000, 70_000, 1))]
    raw = [warc.record(i, f"http://x/{i}", "response", None, warc.digest(p), p) for i, p in pages]
    pack = warc.member if fields else gzip.compress
    (tmp_path / "x.warc.gz").write_bytes(pack(raw[0] + raw[1] + raw[2]) + warc.member(raw[3]) + pack(raw[4] + raw[5]))
    got = rows(warc.read_archives(spark, f"file://{tmp_path}").select("page_id", F.length("payload")))
    assert got == [(i, len(p)) for i, p in pages]
    light = warc.read_archives(spark, f"file://{tmp_path}", payload="none").where("page_id >= 3").select("page_id", "payload_bytes", "payload")
    assert rows(light) == [(i, len(p), None) for i, p in pages[3:]]


def test_warc_headers_are_plain_to_others(spark, tmp_path):
    """Addresses are not escaped unless no header can hold them, and those of other writers are taken as they are."""
    assert b"WARC-Target-URI: http://x/a%20b\r\n" in warc.record(1, "http://x/a%20b", "response", None, "", b"")
    other = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: http://x/a%25b%0D\r\nWARC-Payload-Digest: sha256:0123\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n1\r\na\r\n0\r\n\r\n"
    other += b"WARC/1.0\r\nWARC-Type: response\r\nContent-Type: application/http\r\nWARC-Payload-Digest: sha1:" + warc.digest(b"a").encode() + b"\r\nContent-Length: %d\r\n\r\n" % len(chunked) + chunked + b"\r\n\r\n"
    other += b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Payload-Digest: sha1:6dcd4ce2\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    (tmp_path / "other.warc").write_bytes(other)
    got = [tuple(r) for r in warc.read_archives(spark, f"file://{tmp_path}").select("target_uri", "payload_digest", "payload").collect()]
    assert got == [("http://x/a%25b%0D", "sha256:0123", b"abc"), (None, warc.digest(b"a"), b"1\r\na\r\n0\r\n\r\n"), (None, "6dcd4ce2", b"x")]


@pytest.mark.parametrize("packed", [True, False])
def test_warc_long_urls(spark, tmp_path, packed):
    rng, letters = np.random.default_rng(3), np.frombuffer(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_", np.uint8)
    # among the lengths are those that put byte 4,096 into the HTTP headers
    sizes = [*range(3500, 4200, 7), 5000, 60_000, 2_000_000]
    urls = [u for n in sizes for u in ("http://x/" + rng.choice(letters, n).tobytes().decode(), "http://x/" + "a" * n)]
    pack = warc.member if packed else bytes
    data = b"".join(pack(warc.record(i, u, "revisit", 7, warc.digest(b"abc"), b"abc")) + pack(warc.record(-1 - i, u, "response", None, warc.digest(b"abc"), b"abc")) for i, u in enumerate(urls))
    (tmp_path / ("x.warc.gz" if packed else "x.warc")).write_bytes(data)
    got = warc.read_archives(spark, f"file://{tmp_path}", payload="none").select("page_id", "record_type", "payload_bytes", "refers_to", F.md5("target_uri")).collect()
    name = [hashlib.md5(u.encode()).hexdigest() for u in urls]
    want = [(i, "revisit", 3, 7, h) for i, h in enumerate(name)] + [(-1 - i, "response", 3, None, h) for i, h in enumerate(name)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_warc_finds_a_spoilt_payload(spark, tmp_path):
    bad = warc.record(1, "http://x", "response", None, warc.digest(b"abc"), b"abd")
    (tmp_path / "bad.warc").write_bytes(bad)
    with pytest.raises(Exception, match="digest"):
        warc.read_archives(spark, f"file://{tmp_path}").collect()


# --- token files ---


@pytest.mark.parametrize("bits", [False, True])
def test_token_output(spark, docs, bits):
    data, df = docs
    text = vocab.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_str(text)
    got = {r.doc_id: r for r in tokenfile.read_tokens(tokenfile.write_tokens(df, text, 2, bits=bits)).collect()}
    start = 0
    for i, t, _ in data:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert np.frombuffer(got[i].ids, "<u4").tolist() == ids
        assert (got[i].start, got[i].n_tokens) == (start, len(ids))
        start += len(ids)


def test_token_output_of_equal_ids_and_clashing_columns(spark, monkeypatch):
    """Rows of one doc_id are dealt over several files, and come back in order of their place."""
    monkeypatch.setattr(tokenfile, "SHARD_DOCS", 20)
    text = vocab.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    library = Tokenizer.from_str(text)
    data = [(5 if i % 2 else i, f"text number {i}", 7, "x") for i in range(300)]
    manifest = tokenfile.write_tokens(spark.createDataFrame(data, "doc_id long, text string, start long, _tie string"), text, 2)
    got = tokenfile.read_tokens(manifest).orderBy("start").collect()
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got[:-1])]).tolist()
    assert [r.doc_id for r in got] == sorted(r[0] for r in data)
    assert sorted(bytes(r.ids) for r in got) == sorted(np.array([*library.encode(r[1]).ids, 2], "<u4").tobytes() for r in data)
    assert manifest.where("n_docs < 60").count() > 5


def test_token_output_edges(spark, empty):
    text = vocab.read_vocabulary(public_tokenizers.path("byte_bpe_50k.json"))
    assert tokenfile.read_tokens(tokenfile.write_tokens(empty, text, 2)).count() == 0
    df = spark.createDataFrame([(2, "b", None), (1, None, None), (None, "x", None), (2, "a", None)], DOCS)
    got = sorted(tokenfile.read_tokens(tokenfile.write_tokens(df, text, 2)).select("start", "doc_id", "n_tokens").collect())
    assert [tuple(r) for r in got] == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2)]
