"""Sharding by a permutation-filled lookup table.

Each shard prefers the slots of a prime-sized table in an order of its own (an offset and a step from its name's
hash). In turn, each claims the first slot on its list that is still free, until the table is full: shards own equal
numbers of slots to within one, and a shard that comes or goes moves little more than its own share of the rows. A
row's slot is its key's hash modulo the table size; the table, as large as ``slots`` says and no larger, is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foresift.llm.common import hash60

SHARDS, SLOTS = 32, 4099


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def lookup_table(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """``slot, shard`` for each of ``slots`` (a prime above the number of shards); work and size depend on these parameters alone."""
    if len(set(names)) != len(names) or not 0 < len(names) <= slots or any(slots % k == 0 for k in range(2, int(slots**0.5) + 1)):
        raise ValueError("names must differ, and slots must be a prime, not below their number")
    named = F.array(*[F.lit(n) for n in names])
    offsets = F.transform(named, lambda n: hash60(F.concat(n, F.lit("/offset"))) % slots)
    steps = F.transform(named, lambda n: hash60(F.concat(n, F.lit("/step"))) % (slots - 1) + 1)

    def claim(state: Column, turn: Column) -> Column:
        shard = (turn % len(names)).cast("int")
        slot_of = lambda j: ((F.get(F.col("offsets"), shard) + j * F.get(F.col("steps"), shard)) % slots).cast("int")
        free = lambda j: F.get(state["owner"], slot_of(j)) < 0
        first = F.element_at(F.filter(F.sequence(F.get(state["tried"], shard), F.lit(slots - 1)), free), 1)
        return _let(
            first,
            lambda j: F.struct(
                F.transform(state["owner"], lambda x, slot: F.when(slot == slot_of(j), shard).otherwise(x)).alias("owner"),
                F.transform(state["tried"], lambda x, s: F.when(s == shard, j + 1).otherwise(x)).alias("tried"),
            ),
        )

    empty = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), len(names)).alias("tried"))
    full = F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), empty, claim, lambda s: s["owner"])
    lists = spark.range(1).select(offsets.alias("offsets"), steps.alias("steps"), named.alias("names"))
    return lists.select("names", F.posexplode(full).alias("slot", "owner")).select("slot", F.get("names", F.col("owner")).alias("shard"))


def assign(docs: DataFrame, names: list[str], slots: int = SLOTS, id_col: str = "doc_id") -> DataFrame:
    """``id, slot, shard`` of every row.

    The key is the id as text; a null id counts as the empty text, and rows of one id share a shard. An empty table
    gives an empty result. Only the id column is read.
    """
    keyed = docs.select(F.col(id_col).alias("id"), (hash60(F.col(id_col)) % slots).cast("int").alias("slot"))
    return keyed.join(F.broadcast(lookup_table(docs.sparkSession, names, slots)), "slot").select("id", "slot", "shard")
