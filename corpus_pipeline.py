"""The training-data pipeline: quality rules, near-dedup, substring dedup, packing.

Every stage takes the documents that the stage before it kept, and all but the
last return the columns of ``documents``. Stages are joined by written tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import neardup, packing, quality, substring, vocab
from waymark.llm.queries import vocabulary_file
from waymark.storage import materialize


def _in_row(docs: DataFrame) -> DataFrame:
    """doc_id, text and the whole row as a struct: whatever names other columns have, an operator adds its own beside them."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects, unchanged, with all their columns.

    A null or empty text has too few words and goes; repeated rows share one verdict;
    a null doc_id makes no difference. No rows give none.
    """
    return quality.quality_filter(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more of their five-word shingles, the one with the smallest doc_id.

    Documents without words, and rows without a doc_id, are linked with nothing and
    stay. Rows of one doc_id stay or go together. No rows give none.
    """
    gone = neardup.near_duplicates(docs, size=5, similarity=0.8).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select([F.col(f"`{c}`") for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 13 words or more that start in a document with a smaller doc_id.

    text and, where something went, n_chars are new; other columns stay, whatever
    their names. Null texts, texts that lose nothing and rows without a doc_id stay
    as they are; rows of one doc_id do not count against each other. No rows give none.
    """
    cut = substring.remove_repeats(_in_row(docs), size=13)
    old = {c: F.col("_row").getField(c) for c in docs.columns}
    shorter = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(old["n_chars"])
    return cut.select(*({**old, "text": F.col("text"), "n_chars": shorter}[c].alias(c) for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents' tokens in sequences of 4096 at most.

    A null text is the end id alone, a null doc_id stays null, repeated rows have
    places of their own, long texts are cut. Other columns are not read. No rows give none.
    """
    return packing.pack_documents(docs, vocab.read_vocabulary(vocabulary_file("word_bpe_49k.json")), end_id=1, capacity=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("best_fit_packing", pack),
]

#: No SQL for sketches, relative parsing and packing; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written before the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
