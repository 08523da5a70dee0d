"""Mixing sources to target weights with hash-threshold histograms.

Every document has a hash. A source's part of the mix is all its documents ``copies`` times, and those below a hash
threshold once more. The thresholds come from histograms of words by source and hash bucket: the cumulative sum finds
the bucket in which a source's budget ends, only the rows of that bucket are refined by the next bits, and what is
left is one cell of a few documents. No rows are sorted, and a smaller budget takes a subset of a larger one's rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import WORD, hash60, persist

BITS, LEVELS, ALL_BITS = 12, 2, 60


def n_words(text: Column) -> Column:
    """Words in a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``: one row a source.

    Sources in code point order, null last, get the weights in turn. ``share`` of all words is dealt by weight; no
    source gets above ``most`` times its size, and the excess is dealt again. The level that each unit of weight gets
    is the largest that any prefix of the sources, ordered by limit per weight, can leave to the others.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weigh = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    limits = sizes.select("source", "source_size", weigh.alias("w"), (F.col("source_size") * most).cast("double").alias("limit"))
    before = Window.orderBy(F.col("limit") / F.col("w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    levels = limits.withColumn("level", left / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    return levels.select("source", "source_size", F.least("limit", F.col("w") * F.max("level").over(everything)).alias("target"))


def _cell(level: int) -> Column:
    """The hash bits that name a cell at this level: the leading ``level * BITS``."""
    return F.shiftright("h", ALL_BITS - level * BITS)


def thresholds(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """``source, threshold`` for the sources of ``plan`` (``source, rest``): rows with h below it make up ``rest`` words.

    The row at which the sum passes ``rest`` is taken if that comes nearer; rows of equal hash go together.
    """
    rows, found = sized, plan.select("source", F.lit(0).cast("long").alias("cell"), "rest")
    run = Window.partitionBy("source").orderBy("k")
    for level in range(1, LEVELS + 2):
        key = _cell(level) if level <= LEVELS else F.col("h")
        if level > 1:
            rows = rows.join(found.select(F.col("source").alias("s"), "cell"), F.col("source").eqNullSafe(F.col("s")) & (_cell(level - 1) == F.col("cell"))).drop("s", "cell")
        sums = rows.groupBy("source", key.alias("k")).agg(F.sum("size").alias("words"))
        sums = sums.withColumn("upto", F.sum("words").over(run))
        sums = sums.join(found.select(F.col("source").alias("s"), "cell", "rest"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        if level <= LEVELS:  # the first cell whose end lies beyond the budget
            found = persist(sums.where(F.col("upto") > F.col("rest")).groupBy("source").agg(F.min(F.struct("k", (F.col("rest") - F.col("upto") + F.col("words")).alias("rest"))).alias("m")).select("source", F.col("m.k").alias("cell"), F.col("m.rest").alias("rest")))
    taken = (F.col("upto") <= F.col("rest")) | ((F.col("upto") - F.col("rest")) < (F.col("rest") - F.col("upto") + F.col("words")))
    floor = F.shiftleft(F.col("cell"), ALL_BITS - LEVELS * BITS)
    return sums.groupBy("source").agg(F.coalesce(F.max(F.when(taken, F.col("k") + 1)), F.max(floor)).alias("threshold"))


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), hash60(F.col(id_col)).alias("h"))


def mix_plan(sized: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2) -> DataFrame:
    """``s`` (the source), source_size, target, whole, threshold: a row of the source is taken ``whole`` times, and once more if h < threshold."""
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = persist(targets(sizes, weights, share, most).withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    ends = thresholds(sized, plan.where("rest > 0")).withColumnRenamed("source", "s")
    return persist(plan.join(ends, F.col("source").eqNullSafe(F.col("s")), "left").select(F.col("source").alias("s"), "source_size", "target", "whole", F.coalesce("threshold", F.lit(0)).alias("threshold")))


def _copies() -> Column:
    return F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)


def mix(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For every row: ``id, size, source, source_size, target, copies``; the mix takes the row ``copies`` times.

    Null and empty texts have size 0; null is a source of its own, the last; a source without words has target 0 and
    copies 0. Rows of one id share their hash and so their decision. The result is a function of the table alone:
    reruns agree. An empty table gives an empty result. Other columns are not read.
    """
    sized = persist(_sized(docs, id_col, text_col, source_col))
    plan = mix_plan(sized, weights, share, most)
    return sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).select("id", "size", "source", "source_size", "target", _copies().alias("copies"))


def mixed_rows(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken; rules as in mix.

    Only the plan of one row a source meets the texts.
    """
    plan = mix_plan(persist(_sized(docs, id_col, text_col, source_col)), weights, share, most)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs[source_col].alias("source"), hash60(docs[id_col]).alias("h"))
    taken = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return taken.select(F.explode(F.array_repeat("row", _copies().cast("int"))).alias("row")).select("row.*")
