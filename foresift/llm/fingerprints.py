"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (lines, and pieces of longer ones that end at punctuation, by one rule however long the text is) are digested to 64 bits,
of which some check the others. Each digest goes into three cells of a sketch; a cell keeps how many it holds and the XOR of the digests. Subtracting two sketches
leaves the digests that only one text has. A cell that is left with one digest names it; taking it out of its other
cells exposes more. If cells remain in the end, the digests are dealt to blocks, sorted by block once and cut there: each
is a small sketch of its own, tried again with more cells where it does not peel, so that work stays near proportional
to the text's length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import persist

#: Cells of each of three hashes: of a text's sketch, of a block's, and of a block's that is tried again. Peeling rounds.
THIRD, SMALL, LARGE, ROUNDS = 8, 4, 16, 12
#: Bits of a digest that check the others.
CHECK_BITS = 24
#: Digests that a block should hold on average.
LOAD = 5
#: A longer line is cut at the first punctuation from so many characters on, or else after as many as the second says.
PIECE = (60, 120)
#: Rows that a range of ids should hold, and the largest number of ranges.
RANGE_ROWS, MAX_RANGES = 2000, 16_384


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _check(d: Column) -> Column:
    return F.xxhash64(F.shiftrightunsigned(d, CHECK_BITS)).bitwiseAND(F.lit(2**CHECK_BITS - 1))


def digests(text: Column) -> Column:
    """The distinct digests of a text's paragraphs: 40 bits of a hash, then a check of those, so that an XOR of several shows."""

    def digest(piece: Column) -> Column:
        return _let(F.xxhash64(piece), lambda h: h.bitwiseAND(F.lit(-(2**CHECK_BITS))).bitwiseOR(_check(h)))

    low, high = PIECE
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(rf"[^\n]{{{low},{high - 1}}}?[.,;:!?](?=\s|$)|[^\n]{{1,{high}}}"), F.lit(0)), digest))


def _item(d: Column, n: Column, third: int) -> Column:
    """A digest with its three cells, one of each third, from bits of its own."""
    cell = lambda k: (F.shiftrightunsigned(d, CHECK_BITS + 7 * k).bitwiseAND(F.lit(127)) % third + k * third).cast("int")
    return F.struct(d.alias("d"), n.alias("n"), cell(0).alias("c0"), cell(1).alias("c1"), cell(2).alias("c2"))


def sketch(items: Column, third: int) -> Column:
    """The cells of an array of digests ``d`` that count ``n`` times: how many are in each, ``n``, and the XOR of their digests, ``keys``."""
    cell = lambda held: F.struct(F.aggregate(held, F.lit(0), lambda n, x: n + x["n"]).alias("n"), F.aggregate(held, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x["d"])).alias("keys"))

    def part(items: Column, k: int) -> Column:
        return F.transform(F.sequence(F.lit(k * third), F.lit((k + 1) * third - 1)), lambda c: _let(F.filter(items, lambda x: x[f"c{k}"] == c), cell))

    return _let(F.transform(items, lambda x: _item(x["d"], x["n"], third)), lambda own: F.concat(part(own, 0), part(own, 1), part(own, 2)))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["keys"].bitwiseXOR(y["keys"]).alias("keys")))


def _places(d: Column, third: int) -> Column:
    """A digest's three cells as bits."""
    x = _item(d, F.lit(0), third)
    bit = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), x[f"c{k}"])
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def peel(cells: Column, third: int) -> Column:
    """``ok, found``: the digests of a difference of two sketches; ok if all were recovered. Cells leave as they become empty."""
    single = lambda c: (F.abs(c["n"]) == 1) & (_check(c["keys"]) == c["keys"].bitwiseAND(F.lit(2**CHECK_BITS - 1)))
    held = lambda c: (c["n"] != 0) | (c["keys"] != 0)
    cell = lambda n, keys, at: F.struct(n.alias("n"), keys.alias("keys"), at.alias("at"))

    def step(state: Column, _: Column) -> Column:
        named = F.array_distinct(F.transform(F.filter(state["cells"], single), lambda c: F.struct(c["keys"].alias("d"), c["n"].alias("n"))))
        out = F.transform(named, lambda x: F.struct(x["d"].alias("d"), x["n"].alias("n"), _places(x["d"], third).alias("at")))

        def without(c: Column, x: Column) -> Column:
            return F.when(c["at"].bitwiseAND(x["at"]) != 0, cell(c["n"] - x["n"], c["keys"].bitwiseXOR(x["d"]), c["at"])).otherwise(c)

        def less(out: Column) -> Column:
            cells = F.filter(F.transform(state["cells"], lambda c: F.aggregate(out, c, without)), held)
            return F.struct(cells.alias("cells"), F.concat(state["found"], F.transform(out, lambda x: x["d"])).alias("found"), (F.size(out) > 0).alias("more"))

        return F.when(state["more"], _let(out, less)).otherwise(state)

    full = F.filter(F.transform(cells, lambda c, at: cell(c["n"], c["keys"], F.call_function("shiftleft", F.lit(1).cast("long"), at))), held)
    start = F.struct(full.alias("cells"), F.array().cast("array<bigint>").alias("found"), F.lit(True).alias("more"))
    done = lambda s: F.struct((F.size(s["cells"]) == 0).alias("ok"), s["found"].alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, done)


def _difference(items: Column) -> Column:
    """The digests of a block that only one text has: by a small sketch, by a larger one where that does not peel, else by cancelling them one by one."""
    one = lambda side: F.transform(F.filter(items, lambda x: x["n"] == side), lambda x: x["d"])
    exact = _let(F.struct(one(1).alias("a"), one(-1).alias("b")), lambda s: F.concat(F.array_except(s["a"], s["b"]), F.array_except(s["b"], s["a"])))
    large = _let(peel(sketch(items, LARGE), LARGE), lambda r: F.when(r["ok"], r["found"]).otherwise(exact))
    return _let(peel(sketch(items, SMALL), SMALL), lambda r: F.when(r["ok"], r["found"]).otherwise(large))


def _blocked(a: Column, b: Column) -> Column:
    """The digests that only one of two arrays has, by a sketch for each of many blocks, into which one array's digests go and the other's come out."""
    blocks = F.greatest(F.lit(2), F.ceil((F.size(a) + F.size(b)) / LOAD)).cast("long")
    deal = lambda found, n: F.transform(found, lambda d: F.struct(F.pmod(F.shiftrightunsigned(d, CHECK_BITS + 21), blocks).alias("block"), F.struct(d.alias("d"), F.lit(n).alias("n")).alias("item")))

    def each(items: Column) -> Column:
        """The blocks that have items, from items in order of block."""
        begins = lambda k: (k == 0) | ~F.get(items, k)["block"].eqNullSafe(F.get(items, k - 1)["block"])
        starts = F.concat(F.filter(F.sequence(F.lit(0), F.size(items) - 1), begins), F.array(F.size(items)))
        part = lambda s, e: F.transform(F.slice(items, s + 1, e - s), lambda x: x["item"])
        return _let(starts, lambda s: F.flatten(F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: _let(part(F.get(s, k), F.get(s, k + 1)), _difference))))

    return F.when(F.size(a) + F.size(b) > 0, _let(F.array_sort(F.concat(deal(a, 1), deal(b, -1))), each)).otherwise(F.array().cast("array<bigint>"))


def compare(rows: DataFrame, a: str, b: str, a_cells: str, b_cells: str, to: str) -> DataFrame:
    """Add ``to``: the digests that only one of the arrays ``a`` and ``b`` has: from their sketches if those peel, else from blocks."""
    found = _let(peel(subtract(F.col(a_cells), F.col(b_cells)), THIRD), lambda r: F.when(r["ok"], r["found"]).otherwise(_blocked(F.col(a), F.col(b))))
    return rows.withColumn(to, found)


def likeness(n_a: Column, n_b: Column, n_different: Column) -> Column:
    """Jaccard similarity of two digest sets from their sizes and the number of digests that only one has; 1 if both are empty."""
    return F.when(n_a + n_b + n_different == 0, 1.0).otherwise((n_a + n_b - n_different) / (n_a + n_b + n_different))


def text_of(cells: Column) -> Column:
    """The sketch as text: 20 hex digits a cell."""
    digits = lambda c: F.concat(F.lpad(F.hex(c["n"]), 4, "0"), F.lpad(F.hex(c["keys"]), 16, "0"))
    return F.array_join(F.transform(cells, digits), "")


def with_next(texts: DataFrame) -> DataFrame:
    """Add ``next``, the text of the row that follows by descending id (null ids last); the last row's is that of the first.

    The rows are dealt to ranges of ids, in which a window finds the next one. The first rows of each range are dealt
    to the range above too. Rows of one id are in order of their text's hash.
    """
    ids = texts.select("id")
    n = ids.count()
    ranges = max(1, min(MAX_RANGES, -(-n // RANGE_ROWS)))
    cuts = ids.select(F.percentile_approx("id", [k / ranges for k in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 and n else None
    cuts = sorted(set(cuts or ()))
    step = max(1, round(len(cuts) ** 0.5))
    below = lambda values: F.size(F.filter(values, lambda c: c < F.col("id")))
    if cuts:
        fine = F.array(*[F.lit(c) for c in cuts])
        coarse = below(F.array(*[F.lit(c) for c in cuts[step - 1 :: step]])) * step
        at = _let(coarse, lambda c: c + below(F.slice(fine, c + 1, F.lit(step))))
    else:
        at = F.lit(0)
    at = F.when(F.col("id").isNull(), -1).otherwise(at)
    firsts = ids.groupBy(at.alias("range")).agg(F.max("id").alias("first"))
    up = Window.orderBy("range")  # a row a range
    above = F.coalesce(F.lead("range").over(up), F.min("range").over(Window.partitionBy()))
    firsts = persist(firsts.select("first", above.alias("above")))
    placed = texts.withColumn("range", at).join(F.broadcast(firsts), F.col("id").eqNullSafe(F.col("first")), "left")
    places = F.when(F.col("above").isNull(), F.array(F.struct(F.col("range"), F.lit(False).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range"), F.lit(False).alias("extra")), F.struct(F.col("above").alias("range"), F.lit(True).alias("extra")))
    )
    placed = placed.select("id", "text", F.explode(places).alias("at")).select("id", "text", "at.range", "at.extra")
    order = Window.partitionBy("range").orderBy("extra", F.col("id").desc_nulls_last(), F.xxhash64("text"))
    return placed.withColumn("next", F.lead("text").over(order)).where(~F.col("extra")).select("id", "text", "next")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Compare every text with its edited version and with the next row's text.

    The edited text has the last half of the characters (rounded down) replaced by the first as many of the next row's
    text, or all of it if shorter. Returns ``id, n_chars, edited`` (the text), ``fingerprint, edited_fingerprint``,
    the digest arrays ``edited_changes, next_changes`` and the likenesses ``near_edited, near_next``.

    Null counts as the empty text, which has no paragraphs; two of those are alike (1). Texts that differ only in line
    breaks or repeated paragraphs have equal fingerprints. A single row is its own next one. Repeated rows stay. An
    empty table gives an empty result. Only the two named columns are read.
    """
    texts = with_next(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half))
    rows = texts.select("id", n.cast("long").alias("n_chars"), "text", "next", edited.alias("edited"))
    rows = rows.select("id", "n_chars", "edited", digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next")).alias("c"))
    return _compared(rows)


def _compared(rows: DataFrame) -> DataFrame:
    rows = rows.withColumns({f"{x}_cells": sketch(F.transform(x, lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), THIRD) for x in "abc"})
    rows = compare(rows, "a", "b", "a_cells", "b_cells", "edited_changes")
    rows = compare(rows, "a", "c", "a_cells", "c_cells", "next_changes")
    near = lambda x, changes: likeness(F.size("a"), F.size(x), F.size(changes))
    return rows.select(
        "id", "n_chars", "edited", text_of(F.col("a_cells")).alias("fingerprint"), text_of(F.col("b_cells")).alias("edited_fingerprint"),
        "edited_changes", "next_changes", near("b", "edited_changes").alias("near_edited"), near("c", "next_changes").alias("near_next"),
    )
