"""A training-corpus pipeline: five stages over the documents table, each one of the llm operators.

Every stage takes what its predecessor kept. The first four return the columns of documents; the last one the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm import bpe, exact_dedup, language_id, mixing, near_dedup
from foresift.llm.common import stored


def in_some_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, as they are; those with null or empty text, or without a letter, go.

    Repeated rows stay, ties of languages keep the document, and an empty table stays empty. Only documents, text and
    language columns are looked at; others are carried, whatever their names.
    """
    found = language_id.identify(docs, language_id.train(docs))
    return found.where("lang_pred <> 'und'").select("row.*")


def one_of_each_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (after lower-casing A-Z) the row with the largest id; of rows that repeat it, one.

    Null and empty texts are one text; null ids rank below all others. An empty table stays empty.
    """
    return exact_dedup.keep_one(docs)


def one_of_each_near_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.75) the rows with the smallest id.

    Texts without words are copies of nothing and stay; repeated rows of the smallest id stay. An empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in the proportions wanted: a document may go, or come twice. A null source is one; texts without words add nothing. An empty table stays empty."""
    return mixing.mixed_rows(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` (packed little-endian 32-bit) and digests of the ids and of the text they decode to.

    A row a row, repeated or not; null text counts as empty and has no ids; null ids stay null.
    """
    import public_tokenizers

    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(F.col("id").alias("doc_id"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language id", in_some_language), ("exact dedup", one_of_each_text), ("near dedup", one_of_each_near_group), ("mixing", mix_sources), ("bpe", tokens)]

#: Language inference and byte-pair merging have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs)
    return docs
