"""Repair of conversations at the least cost: roles in the order ``(s?(ua)+)?``, no blank, repeated or unfinished messages.

Equal messages at the same turn are first counted together, so that a message repeated without end is one row. The rows,
without their texts, are then dealt by ranges of conversation and turn, so that one conversation may lie in many tasks.
Each task cuts its rows into runs and sums every run up by the block tables of ``block_tables``. The runs of a conversation
are composed from its end, which gives the costs after each run, and then from its start, which gives the state before it.
With both, every run is traced by itself, and only messages that stay meet their texts again.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foresift.llm.block_tables import GONE, INITIALS, MADE, NEXT, START, Tables
from foresift.llm.common import WORD, lean, stored

#: Symbols in a run at most.
RUN = 32_768
ROLES = {"u": "user", "a": "assistant"}
FINE = frozenset(("su", "ua", "au"))
KEYS = ("conv", "turn", "role", "digest")


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv, turn, role, text`` after known damage, by the remainder r of crc32 of ``conv_id:turn`` and 20 (nulls: one space).

    r = 0 drops the row, 1 empties its text, 2 takes out ``.``, ``!`` and ``?``, 3 repeats it, 4 makes its role user; other
    rows stay, with a null role or text as one space. An empty table stays empty; other columns are not read.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    r = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").alias("conv"), "turn", blank("role").alias("role"), blank("text").alias("text"), r.alias("r")).where("r <> 0")
    text = F.when(F.col("r") == 1, "").when(F.col("r") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("r") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "r")
    return rows.select("conv", "turn", "role", "text", F.explode(F.when(F.col("r") == 3, F.array(F.lit(1), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("n")).drop("n")


def _digest() -> Column:
    return F.unhex(F.sha2("text", 256)).alias("digest")


def faults(messages: DataFrame) -> DataFrame:
    """Each distinct message of a turn once: ``conv, turn, role, digest, copies, initial, blank, open_end, later``.

    ``blank``: no word; ``open_end``: the last character that is no white space is none of ``.!?``; ``later``: the same
    role and text stand at an earlier turn (a null turn comes first). ``copies`` counts equal rows.
    """
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    rows = messages.select("conv", "turn", "role", _digest(), (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("open_end"))
    rows = rows.groupBy(*KEYS, "blank", "open_end").agg(F.count(F.lit(1)).alias("copies"))
    when = F.struct(F.col("turn").isNotNull().alias("some"), F.col("turn").alias("turn"))
    again = rows.groupBy(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    met = rows.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")), "left")
    later = F.coalesce(when > F.col("first"), F.lit(False))
    return met.select(*KEYS, "copies", F.substring("role", 1, 1).alias("initial"), "blank", "open_end", later.alias("later"))


def _runs(rows: DataFrame) -> DataFrame:
    """Rows dealt by ranges of conversation and turn, each with its run and place there; and a row for every run with its table."""
    kinds = dict(rows.dtypes)
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, digest binary, run long, at long, copies long, symbols binary, ahead binary, cost binary, states binary, pairs long, first string, last string"
    order = [F.col(k).asc_nulls_first() for k in KEYS]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id().cast("long"))
    most = RUN

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held, number = _tables(), None, 0

        def closed(run: dict) -> dict:
            symbols = np.concatenate(run["symbols"])
            ahead, cost, states = tables.summary(symbols)
            return {"conv": run["conv"], "run": run["run"], "at": -1, "symbols": symbols.astype(np.uint8).tobytes(), "ahead": ahead.astype("<i2").tobytes(), "cost": cost.astype("<i8").tobytes(), "states": states.astype(np.uint8).tobytes(), "pairs": run["pairs"], "first": run["first"], "last": run["last"]}

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                gone = row["blank"] or row["later"]
                symbol = GONE if gone else 2 + 4 * row["open_end"] + (INITIALS.find(row["initial"]) if row["initial"] and row["initial"] in INITIALS else 3)
                left, at_first = row["copies"], True
                while left:
                    if held is None or held["conv"] != row["conv"] or held["length"] >= most:
                        if held:
                            out.append(closed(held))
                        held, number = {"conv": row["conv"], "run": (row["part"] << 32) | number, "length": 0, "symbols": [], "pairs": 0, "first": row["initial"], "last": None}, number + 1
                    take = min(left, most - held["length"])
                    symbols = np.full(take, GONE, np.uint8)
                    if at_first:
                        symbols[0] = symbol
                        out.append({k: row[k] for k in KEYS} | {"run": held["run"], "at": held["length"], "copies": row["copies"]})
                    held["pairs"] += take - 1 + (held["last"] is not None and held["last"] + row["initial"] not in FINE)
                    held["symbols"].append(symbols)
                    held["length"] += take
                    held["last"], at_first = row["initial"], False
                    left -= take
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if held:
            yield pa.RecordBatch.from_pylist([closed(held)], schema=types)

    types = _arrow(rows.sparkSession, schema)
    return dealt.mapInArrow(lean(cut), schema)


def _arrow(spark, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], schema).schema)


def _composed(runs: DataFrame) -> DataFrame:
    """For each run the vector after it and the state before it; for each conversation, in a row without run, its cost, wrong neighbours and what is made up at its end."""
    schema = f"conv {dict(runs.dtypes)['conv']}, run long, after long, state long, cost long, pairs long, ending string"
    types = _arrow(runs.sparkSession, schema)

    def compose(rows: list[dict]) -> list[dict]:
        vectors = _tables().vectors
        cost, after = 0, 0
        for r in reversed(rows):
            r["after"] = after
            cost += int(np.frombuffer(r["cost"], "<i8")[after])
            after = int(np.frombuffer(r["ahead"], "<i2")[after])
        cost += vectors[after][START]
        state, pairs, out, last = START, 0, [], None
        for r in rows:
            pairs += r["pairs"] + (last is not None and last + r["first"] not in FINE)
            last = r["last"]
            out.append({"conv": r["conv"], "run": r["run"], "after": r["after"], "state": state})
            state = int(np.frombuffer(r["states"], np.uint8).reshape(-1, 4)[r["after"], state])
        ending = ""
        while vectors[0][state]:
            ending += MADE[state]
            state = NEXT[state, MADE[state]]
        return [*out, {"conv": rows[0]["conv"], "cost": cost, "pairs": pairs, "ending": ending}]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if held and held[0]["conv"] != row["conv"]:
                    out += compose(held)
                    held = []
                held.append(row)
            yield pa.RecordBatch.from_pylist(out, schema=types)
        if held:
            yield pa.RecordBatch.from_pylist(compose(held), schema=types)

    return runs.repartition("conv").sortWithinPartitions("conv", "run").mapInArrow(lean(each), schema)


@functools.cache
def _tables() -> Tables:
    """The block tables, made once in a worker."""
    return Tables()


def _traced(placed: DataFrame) -> DataFrame:
    """From rows of runs (first) and of messages, by run: the letters of every run, and each message that stays with its new role and what is made up before it."""
    kinds = dict(placed.dtypes)
    schema = f"conv {kinds['conv']}, turn {kinds['turn']}, role string, digest binary, run long, made string, becomes string, letters string"
    types = _arrow(placed.sparkSession, schema)

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, said = _tables(), []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["at"] < 0:
                    letters = tables.letters(np.frombuffer(row["symbols"], np.uint8), row["after"], row["state"])
                    out.append({"conv": row["conv"], "run": row["run"], "letters": letters})
                    said, state, made = [], row["state"], ""
                    symbols = iter(np.frombuffer(row["symbols"], np.uint8).tolist())
                    for a in letters:
                        if a == "I":
                            made += MADE[state]
                            state = NEXT[state, MADE[state]]
                            continue
                        symbol, becomes = next(symbols), None
                        if a == "K":
                            becomes = INITIALS[(symbol - 2) % 4]
                            state = NEXT[state, becomes]
                            becomes = ""
                        elif a == "R":
                            becomes = ROLES[MADE[state]]
                            state = NEXT[state, MADE[state]]
                        said.append((made, becomes))
                        made = "" if a in "KR" else made
                else:
                    made, becomes = said[row["at"]]
                    if becomes is not None:
                        out.append({k: row[k] for k in KEYS} | {"made": made, "becomes": becomes or row["role"]})
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return placed.mapInArrow(lean(trace), schema)


def repair(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cheapest edits of ``conv, turn, role, text``: the messages that stay, and what was done.

    Costs: keep 0, another role (user or assistant) 1, delete 2, an empty message made up anywhere 5, and 5 more for each
    unfinished message that is not deleted. Blank messages and repeats of an earlier one must go. Within a conversation
    rows stand by turn (nulls first), then role and digest of the text. Of equally cheap ways the one whose letters
    (D, I, K, R) come first is taken. Null conversations are one conversation; roles and texts must not be null. Texts
    with the same SHA-256 count as equal. An empty table gives empty results.

    First result: ``conv, turn, was, digest, made, role, text``: ``made`` has the initials of the messages made up before it.
    Second: ``conv, run, letters, cost, pairs, ending``: rows with ``letters``, in the order of ``run``, and one row
    without ``run`` with the whole cost, the number of wrong neighbours before the repair and the initials made up at the end.
    """
    runs = stored(_runs(faults(messages)))
    found = stored(_composed(runs.where("at < 0").select("conv", "run", "ahead", "cost", "states", "pairs", "first", "last")))
    by_run = found.where("run is not null").select(F.col("run").alias("of"), "after", "state")
    heads = runs.where("at < 0").join(by_run, F.col("run") == F.col("of")).select("conv", "turn", "role", "digest", "run", "at", "symbols", "after", "state")
    rest = runs.where("at >= 0").select("conv", "turn", "role", "digest", "run", "at", "symbols", F.lit(None).cast("long").alias("after"), F.lit(None).cast("long").alias("state"))
    done = stored(_traced(heads.unionByName(rest).repartition("run").sortWithinPartitions("run", "at")))
    stays = done.where("letters is null").select(*KEYS, F.struct("made", "becomes").alias("way"), F.lit(None).cast("string").alias("text"))
    texts = messages.select("conv", "turn", "role", _digest(), F.lit(None).cast("struct<made:string,becomes:string>").alias("way"), "text")
    whole = stays.unionByName(texts).groupBy(*KEYS).agg(F.max("way").alias("way"), F.max("text").alias("text")).where("way is not null")
    kept = whole.select("conv", "turn", F.col("role").alias("was"), "digest", "way.made", F.col("way.becomes").alias("role"), "text")
    told = done.where("letters is not null").select("conv", "run", "letters", *[F.lit(None).cast(t).alias(c) for c, t in (("cost", "long"), ("pairs", "long"), ("ending", "string"))])
    ends = found.where("run is null").select("conv", "run", F.lit(None).cast("string").alias("letters"), "cost", "pairs", "ending")
    return kept, told.unionByName(ends)


def summed_up(kept: DataFrame, told: DataFrame) -> DataFrame:
    """``conv, audit, cost, illegal, repaired_sha256``: the letters in order and the SHA-256 of the repaired ``role:text`` lines, read in order without holding a conversation's texts."""
    kinds, none = dict(kept.dtypes), lambda *names: [F.lit(None).cast(t).alias(c) for c, t in names]
    schema = f"conv {kinds['conv']}, audit string, cost long, illegal long, repaired_sha256 string"
    types = _arrow(kept.sparkSession, schema)
    one = kept.select("conv", F.lit(1).alias("kind"), *none(("run", "long")), "turn", "was", "digest", "made", "role", "text", *none(("letters", "string"), ("cost", "long"), ("pairs", "long"), ("ending", "string")))
    two = told.select("conv", F.when(F.col("run").isNull(), 2).otherwise(0).alias("kind"), "run", *none(("turn", kinds["turn"]), ("was", "string"), ("digest", "binary"), ("made", "string"), ("role", "string"), ("text", "string")), "letters", "cost", "pairs", "ending")
    order = [F.col(c).asc_nulls_first() for c in ("conv", "kind", "run", "turn", "was", "digest")]
    rows = one.unionByName(two).repartition("conv").sortWithinPartitions(*order)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, text, lines = [], hashlib.sha256(), 0

        def say(line: str) -> None:
            nonlocal lines
            text.update((("\n" if lines else "") + line).encode())
            lines += 1

        for batch in batches:
            out = []
            for row in batch.to_pylist():
                for made in row["made"] or row["ending"] or "":
                    say(ROLES[made] + ":")
                if row["kind"] == 0:
                    letters.append(row["letters"])
                elif row["kind"] == 1:
                    say(f"{row['role']}:{row['text']}")
                else:
                    out.append({"conv": row["conv"], "audit": "".join(letters) + "I" * len(row["ending"]), "cost": row["cost"], "illegal": row["pairs"], "repaired_sha256": text.hexdigest()})
                    letters, text, lines = [], hashlib.sha256(), 0
            yield pa.RecordBatch.from_pylist(out, schema=types)

    return rows.mapInArrow(lean(hashed), schema)


def counted(rows: DataFrame) -> DataFrame:
    """``conv, gaps, blank, duplicate, truncated`` from ``faults``: each row counts by its first fault; gaps of turns leave nulls out."""
    again = F.when(F.col("blank"), 0).when(F.col("later"), F.col("copies")).otherwise(F.col("copies") - 1)
    cut = F.when(~F.col("blank") & ~F.col("later") & F.col("open_end"), 1).otherwise(0)
    sums = rows.groupBy("conv", "turn").agg(F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"), F.sum(again).alias("duplicate"), F.sum(cut).alias("truncated"))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    return sums.groupBy("conv").agg(gaps, *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])


def audit(conversations: DataFrame) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of every conversation after ``damaged``.

    A conversation of which nothing is left gets zeros, an empty audit and the hash of the empty text; a null id is one
    conversation. Repeated rows are repeats of a message. An empty table gives an empty result.
    """
    messages = damaged(conversations)
    kept, told = repair(messages)
    parts = [conversations.select(F.col("conv_id").alias("conv")).distinct(), counted(faults(messages)), summed_up(kept, told)]
    names = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long", "audit": "string", "repaired_sha256": "string"}
    wide = [p.select("conv", *[(F.col(c) if c in p.columns else F.lit(None)).cast(t).alias(c) for c, t in names.items()]) for p in parts]
    one = wide[0].unionByName(wide[1]).unionByName(wide[2]).groupBy("conv").agg(*[F.max(c).alias(c) for c in names])
    empty = {"audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}
    return one.select(F.col("conv").alias("conv_id"), *[F.coalesce(c, F.lit(empty.get(c, 0)).cast(t)).alias(c) for c, t in names.items()])
