"""Exact deduplication with a heavy-hitter split.

A Misra-Gries summary over all digests (Spark's ``approx_top_k``, the mergeable frequent-items sketch of that
family) names the few digests that may hold a large share of the rows. One counting pass with map-side combine
verifies them exactly. The verified winners, ``MAX_HEAVY`` rows at most, are broadcast, so that the copies of hot
texts are decided where they lie; only the other digests, none of which can be frequent, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import frequent, lower_ascii, persist

#: Candidates taken from the summary: the proven bound of the broadcast side, in rows.
MAX_HEAVY = 256
#: Counters of the summary; its error is below 3.5 / COUNTERS of all rows.
COUNTERS = 8192


def text_digest(text):
    """SHA-256 (hex) of the text after lower-casing A-Z only; null counts as the empty text."""
    return F.sha2(lower_ascii(F.coalesce(text, F.lit(""))), 256)


def heavy_digests(digests: DataFrame, min_copies: int = 64) -> DataFrame:
    """``digest, heavy_keep, heavy_size`` of each frequent digest, counted exactly; MAX_HEAVY rows at most.

    ``digests`` has ``id, digest``. A digest held by fewer than ``min_copies`` rows is not worth a broadcast slot.
    """
    likely = frequent(digests, "digest", MAX_HEAVY, COUNTERS).where(F.col("count") >= min_copies).select(F.col("item").alias("digest"))
    return (
        digests.join(F.broadcast(likely), "digest")
        .groupBy("digest")
        .agg(F.max("id").alias("heavy_keep"), F.count("*").alias("heavy_size"))
        .where(F.col("heavy_size") >= min_copies)
    )


def decide(digests: DataFrame, heavy: DataFrame) -> DataFrame:
    """Each row of ``digests`` (``id, digest`` and any others) with ``keep_id, group_size, kept``.

    Rows of heavy digests that are not the winner are finished without a shuffle; the winners go on with the rest,
    so that repeated winners lose all but one row too.
    """
    marked = digests.join(F.broadcast(heavy), "digest", "left")
    # An expression of two columns on purpose: the copies leave here, before any exchange.
    lost = F.col("heavy_size").isNotNull() & ~F.col("id").eqNullSafe(F.col("heavy_keep"))
    copies = marked.where(lost).withColumns({"keep_id": F.col("heavy_keep"), "group_size": F.col("heavy_size"), "kept": F.lit(False)})
    by_digest = Window.partitionBy("digest")
    rest = marked.where(~lost).withColumns(
        {
            "keep_id": F.max("id").over(by_digest),
            "group_size": F.coalesce("heavy_size", F.count("*").over(by_digest)),
            "kept": F.row_number().over(by_digest.orderBy(F.col("id").desc_nulls_last())) == 1,
        }
    )
    return rest.unionByName(copies).drop("heavy_keep", "heavy_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_copies: int = 64) -> DataFrame:
    """Decide for every row which copy of its text stays: ``id, digest, keep_id, group_size, kept``.

    Texts are equal when identical after lower-casing A-Z. Of equal texts the row with the largest id stays; of
    rows that share that id too, one stays. Null texts count as empty; null ids rank below all others, and a group
    with null ids only keeps one row, with keep_id null. An empty table gives an empty result. Other columns of
    ``docs`` are not read, whatever their names.
    """
    digests = persist(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    return decide(digests, persist(heavy_digests(digests, min_copies)))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_copies: int = 64) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; rules as in exact_dedup.

    Decided on ids and digests alone. Then the rows that lose are taken out by id and digest, which no hot text
    gathers in one task; rows that share even those are aggregated where they lie before they meet.
    """
    narrow = persist(docs.select(F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest")))
    decided = decide(narrow, persist(heavy_digests(narrow, min_copies)))
    keys = decided.groupBy("id", "digest").agg(F.first(F.col("id").eqNullSafe(F.col("keep_id"))).alias("stays"), F.count("*").alias("n"))
    marked = persist(keys.where("not stays or n > 1"))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col(id_col).alias("id"), text_digest(F.col(text_col)).alias("digest"))
    here = lambda some: rows["id"].eqNullSafe(some["id"]) & (rows["digest"] == some["digest"])
    kept, again = rows.join(marked, here(marked), "left_anti").select("row.*"), marked.where("stays")
    if again.isEmpty():
        return kept
    return kept.union(rows.join(again, here(again), "left_semi").groupBy("id", "digest").agg(F.first("row").alias("row")).select("row.*"))
