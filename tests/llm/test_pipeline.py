"""The pipeline against brute force, and the registered queries on the smallest tables."""

import math
from pathlib import Path

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from brute import brute_components, brute_cut, brute_measures, corpus

import corpus_pipeline

SF = "/root/testdata/sf0.001"


def rejected(text):
    m = brute_measures(text)
    n = m["n_words"]
    return (
        n < 20 or 100 * m["n_repeat_words"] > 30 * n or 10 * m["n_symbols"] > n or 100 * m["n_dup_lines"] > 40 * m["n_lines"]
        or not 2.5 * n <= m["word_chars"] <= 12 * n or 5 * m["n_stutters"] > n or 2 * m["n_shouted"] > n
    )


def test_run_matches_brute_force(spark, tmp_path):
    data = [(i, t, lang, "src", len(t or "")) for i, t, lang in corpus(50, 3)]
    spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    good = [(i, t) for i, t, *_ in data if not rejected(t)]
    alone = {i for i, (_, _, kept) in brute_components(good, 5, 0.8).items() if kept}
    cut = brute_cut([(i, t) for i, t in good if i in alone], 13)
    texts = {i: (cut[i][2] if cut[i][1] else t) for i, t in good if i in alone}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {}
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids) + 1
        for k in range(math.ceil(n / 4096)):
            want[i, k] = min(4096, n - 4096 * k)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {(r.doc_id, r.piece): r.length for r in got} == want
    assert 0 < len(texts) < len(good) < len(data)


def test_stages_keep_the_columns(spark, tmp_path):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([(i, t, lang, None, None) for i, t, lang in corpus(20, 5)], []):
        docs = spark.createDataFrame(rows, kind)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_stages_of_odd_rows_and_clashing_columns(spark, tmp_path):
    """Null ids and texts, repeated rows, and columns named like those that operators use."""
    extra = ["_bucket", "n_words", "n_removed", "spans", "factors", "_words", "_text", "_row", "rejected_by", "component_id", "kept", "n_shingles", "k1", "bands", "piece", "length", "block"]
    kind = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in extra)
    texts = [t for _, t, _ in corpus(30, 7)]
    data = [(None if i % 11 == 4 else i, None if i % 13 == 6 else t, "en", None, 5, *(100 * i + k for k in range(len(extra)))) for i, t in enumerate(texts)]
    data += data[:4]
    docs = spark.createDataFrame(data, kind)
    by_first = {r[5]: r for r in data}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == [c.split()[0] for c in kind.split(", ")], name
        found = docs.collect()
        assert found
        for r in found:
            assert (r[0], *r[5:]) == (by_first[r[5]][0], *by_first[r[5]][5:]), name
        docs = spark.createDataFrame(found, kind)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= len(found)


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_registered(spark):
    import __spark_entry__

    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
@pytest.mark.parametrize("name", ["op3_minhash_near_dedup", "op4_chat_formatting", "op6_quality_rules", "op7_embedding_near_dedup", "op8_substring_dedup", "op9_warc"])
def test_queries_equal_their_sql(spark, name):
    import duckdb

    from waymark.llm import queries

    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    found = c.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r) for r in df.select(*names).collect()))) == sorted(map(repr, found.fetchall()))
