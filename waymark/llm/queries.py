"""The subpackage's queries, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import chat, embeddings, lm, neardup, oracles, packing, quality, sentencepiece, substring, tokenfile, vocab, warc

#: Where the vocabulary files are; a cluster may hold them elsewhere.
TOKENIZERS = os.environ.get("WAYMARK_TOKENIZERS", os.path.dirname(public_tokenizers.path("word_bpe_49k.json")))


def vocabulary_file(name: str) -> str:
    return os.path.join(TOKENIZERS, name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocab.read_vocabulary(vocabulary_file("word_bpe_49k.json"))
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary, end_id=1, capacity=4096)


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), size=2, similarity=0.8)


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    more = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{tricky}'), (-7L, 1L, 'assistant', '{tricky}') AS t(conv_id, turn, role, text)")
    read = chat.turns(chat.format_conversations(rows.union(more)))
    line = lambda t: F.concat(F.coalesce(t["role"], F.lit("")), F.lit("\n"), t["text"], F.lit("\n"))
    read = read.withColumn("_loss", chat.loss_text(F.col("formatted"), F.col("loss")))
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", line), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece.read_model(vocabulary_file("piece_bpe_32k.model"))
    coded = sentencepiece.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    both = sentencepiece.decode(coded.drop("text"), model)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.measured(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), size=13, join_all=True)
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_archives(table(spark, sf_dir, "pages"), least_bytes=0)
    responses = warc.read_archives(spark, path, payload="response").where("record_type = 'response'")
    revisits = warc.read_archives(spark, path, payload="none").where("record_type = 'revisit'")
    length = F.coalesce(F.octet_length("payload"), "payload_bytes").cast("long")
    return responses.union(revisits).select("page_id", length.alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


def op10_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = vocab.read_vocabulary(vocabulary_file("byte_bpe_50k.json"))
    manifest = tokenfile.write_tokens(table(spark, sf_dir, "documents"), vocabulary, end_id=2)
    return tokenfile.read_tokens(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_quality_rules": op6_quality_rules,
    "op7_embedding_near_dedup": op7_embedding_near_dedup,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_warc": op9_warc,
    "op10_token_output": op10_token_output,
}

ORACLE_SQL: dict[str, str] = {
    "op3_minhash_near_dedup": oracles.NEAR_DEDUP,
    "op4_chat_formatting": oracles.CHAT,
    "op6_quality_rules": oracles.QUALITY,
    "op7_embedding_near_dedup": oracles.NEAR_VECTORS,
    "op8_substring_dedup": oracles.SUBSTRING,
    "op9_warc": oracles.WARC,
}
