"""Quotation linking: conversations in reply order, without the quotes.

A line's quote level is the number of ``>`` marks before it. Neighbouring lines of one level are a passage. Quoted
passages and what each message says itself, whole and in runs of as many sentences as the conversation's quotes have, are
normalised and hashed; a quote's hash finds the message that said it first in the same conversation. The message
replies to what it quotes at the lowest level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import persist

MARKS = r"^((?:[ \t]*>)+)[ \t]?"
#: Where a sentence ends: at the end of its line, or before white space after its last mark.
ENDS = r"\n|(?<=[.!?])\s+"


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def passages(text: Column) -> Column:
    """``level, text`` of the runs of lines of equal quote level, in order."""

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 1), "[^>]", ""))
        return F.struct(level.alias("level"), F.regexp_replace(x, MARKS, "").alias("text"))

    def runs(lines: Column) -> Column:
        begins = lambda k: (k == 0) | ~F.get(lines, k)["level"].eqNullSafe(F.get(lines, k - 1)["level"])
        starts = F.concat(F.filter(F.sequence(F.lit(0), F.size(lines) - 1), begins), F.array(F.size(lines)))

        def run(s: Column, e: Column) -> Column:
            return F.struct(F.get(lines, s)["level"].alias("level"), F.array_join(F.transform(F.slice(lines, s + 1, e - s), lambda x: x["text"]), "\n").alias("text"))

        return _let(starts, lambda s: F.transform(F.sequence(F.lit(0), F.size(s) - 2), lambda k: run(F.get(s, k), F.get(s, k + 1))))

    plain = F.array(F.struct(F.lit(0).alias("level"), text.alias("text")))  # no line begins with a mark
    return F.when(text.rlike(r"(?m)^[ \t]*>"), _let(F.transform(F.split(text, "\n"), line), runs)).otherwise(plain)


def normalised(text: Column) -> Column:
    """Lower case, white space collapsed, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def _digest(text: Column) -> Column:
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(1), text).alias("b"))


def _sentences(text: Column) -> Column:
    """The normalised sentences that are not empty."""
    return F.filter(F.transform(F.split(text, ENDS), normalised), lambda x: x != "")


def _windows(parts: Column) -> Column:
    """Hashes of all windows of 1, 2, 4, ... neighbouring parts, an array for each size: each from two of half its size."""

    def longer(found: Column, half: Column) -> Column:
        last = F.element_at(found, -1)
        double = F.transform(F.slice(last, 1, F.size(last) - half), lambda h, at: F.xxhash64(h, F.get(last, at + half)))
        return F.concat(found, F.array(double))

    sizes = lambda x: F.filter(F.transform(F.sequence(F.lit(0), F.lit(29)), lambda k: F.call_function("shiftleft", F.lit(1), k)), lambda half: 2 * half <= F.size(x))
    return _let(F.transform(parts, lambda x: F.xxhash64(x)), lambda h: F.aggregate(sizes(h), F.array(h), longer))


def _runs(parts: Column, lengths: Column) -> Column:
    """Digests of all runs of neighbouring parts of the given lengths; each covered by two windows, whatever its length."""

    def run(windows: Column, n: Column, at: Column) -> Column:
        size = F.length(F.bin(n)) - 1
        of = F.get(windows, size)
        return F.struct(F.get(of, at).alias("a"), F.xxhash64(n, F.get(of, at + n - F.call_function("shiftleft", F.lit(1), size))).alias("b"))

    def of(windows: Column) -> Column:
        n_parts = F.size(F.get(windows, F.lit(0)))
        return F.flatten(F.transform(F.filter(lengths, lambda n: (n > 0) & (n <= n_parts)), lambda n: F.transform(F.sequence(F.lit(0), n_parts - n), lambda at: run(windows, n, at))))

    return _let(_windows(parts), of)


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv, turn, role, text, n_quotes, reply_to, thread, depth`` of every message.

    ``text`` is what the message says itself. A quote belongs to the earliest message before it in its conversation
    whose own text, or a passage or neighbouring sentences of that, is the same after normalising (a sentence ends with its
    line, or at ``.!?`` before white space; lines of white space do not count; equal 128-bit hashes are the same); a quote
    that ends within a sentence finds nothing. ``reply_to`` is the
    turn of the message that is quoted at the lowest level that finds one (of several, the latest turn), else null.
    ``thread`` is the turn of the first message that replies lead to, ``depth`` the number of replies up to it; order by
    conversation, ``thread``, ``depth`` and turn is reply order: a message comes after what it replies to.
    Quotes that find nothing are taken out too. Null texts say nothing. Messages whose conversation or turn is null
    link with nothing and are their own thread. Rows that share a conversation and turn are quoted as
    one and answered alike; each stays a row. An empty table gives an empty result. Other columns are not read.
    """
    said = messages.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), passages(F.coalesce(F.col(text_col), F.lit(""))).alias("passages")
    )
    own = F.array_join(F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]), "\n")
    said = persist(said.select("conv", "turn", "role", F.trim(own).alias("text"), F.filter("passages", lambda p: p["level"] > 0).alias("quotes"), F.transform(F.filter("passages", lambda p: p["level"] == 0), lambda p: p["text"]).alias("own")))
    quoted = said.select("conv", "turn", F.posexplode("quotes").alias("at", "q")).select("conv", "turn", "at", "q.level", normalised(F.col("q.text")).alias("whole"), _sentences(F.col("q.text")).alias("parts")).where("whole <> ''")
    quoted = quoted.withColumn("n", F.size("parts"))
    asked = quoted.select("conv", "turn", "at", "level", F.explode(F.concat(F.array(_digest(F.col("whole"))), _runs(F.col("parts"), F.array("n")))).alias("key"))
    wanted = quoted.groupBy("conv").agg(F.collect_set("n").alias("lengths"))
    whole = F.transform(F.concat(F.array("text"), F.col("own")), lambda x: _digest(normalised(x)))
    stated = said.join(wanted, "conv").select("conv", "turn", F.explode(F.concat(whole, _runs(_sentences(F.col("text")), F.col("lengths")))).alias("key"))
    stated = stated.groupBy("conv", "key").agg(F.min("turn").alias("origin"))
    found = asked.join(stated, ["conv", "key"]).where("origin < turn").groupBy("conv", "turn", "at", "level").agg(F.min("origin").alias("origin"))
    replies = persist(found.groupBy("conv", "turn").agg(F.min(F.struct("level", (-F.col("origin")).alias("less"))).alias("m")).select("conv", "turn", (-F.col("m.less")).alias("reply_to")))
    kept = said.select("conv", "turn", "role", "text", F.size("quotes").alias("n_quotes"))
    found = kept.join(_threads(replies), ["conv", "turn"], "left")
    return found.select("conv", "turn", "role", "text", "n_quotes", "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).alias("depth"))


def _threads(replies: DataFrame) -> DataFrame:
    """``conv, turn, reply_to, root, depth``: the first message and the steps to it, by doubling the part of the way that is known."""
    now = replies.select("conv", "turn", "reply_to", F.col("reply_to").alias("root"), F.lit(1).alias("depth"))
    while True:
        now = persist(now)
        above = now.select("conv", F.col("turn").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"))
        if now.join(above, ["conv", "root"], "left_semi").isEmpty():
            return now
        far = F.coalesce("depth2", F.lit(0))
        now = now.join(above, ["conv", "root"], "left").select("conv", "turn", "reply_to", F.coalesce("root2", "root").alias("root"), (F.col("depth") + far).alias("depth"))
