"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import lean, removed, stored, tidy

#: Keys that a task holds at a time.
HELD = 200_000


def top(low: dict[Any, Any], x: Any) -> Any:
    """The root of a key in a forest of keys, each with the next one toward its root; a new key is a root."""
    while (up := low.setdefault(x, x)) != x:
        low[x] = x = low.setdefault(up, up)
    return x


def join(low: dict[Any, Any], x: Any, y: Any) -> None:
    """Join two keys' trees; the smallest key of each tree stays its root."""
    x, y = top(low, x), top(low, y)
    low[max(x, y)] = min(x, y)


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's edges as stars around smallest keys, which join the same; a task of many keys has several forests, one after the other."""
    low: dict[Any, Any] = {}
    kind = None

    def found() -> pa.RecordBatch:
        leaves = [x for x in list(low) if top(low, x) != x]
        return pa.RecordBatch.from_arrays([pa.array(leaves, kind), pa.array([top(low, x) for x in leaves], kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.schema.field(0).type
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            join(low, x, y)
            if len(low) >= HELD:
                yield found()
                low.clear()
    if low:
        yield found()


def _contracted(edges: DataFrame) -> DataFrame:
    """The edges as each task's stars, in a file a task."""
    return stored(edges.mapInArrow(lean(_stars), edges.schema))


def _is_stars(edges: DataFrame) -> bool:
    """Whether every larger end has one smaller neighbour, which has none itself."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("up")).union(edges.select("b", F.lit(0)))
    by = ends.groupBy("v").agg(F.sum("up").alias("n"), F.min("up").alias("least"))
    return by.where((F.col("n") > 1) | ((F.col("n") == 1) & (F.col("least") == 0))).isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """``key, component`` for every key in ``edges`` (``a, b``, of one orderable type): the smallest key reachable.

    Each task first makes stars of its edges, without a shuffle. Where few are left, fewer tasks take them, of at most
    ``HELD`` keys, and do so again; a graph that comes down to one such task is done then. Every round on a larger one
    hangs each key's larger neighbours on its smallest one, then flattens. Minima are aggregated before
    they meet the edges, so a key with many neighbours is split like any skewed join. Null and self edges join nothing.
    """
    now = _contracted(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    while 2 * (tasks := max(1, -(-2 * now.count() // HELD))) <= (files := len(now.inputFiles())):
        old, now = now, _contracted(now.coalesce(tasks))
        removed(old)
    while max(files, tasks) > 1 and not _is_stars(now):
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b")
        old, now = now, _contracted(small.union(low.select("a", F.col("low").alias("b"))).distinct())
        removed(old)
        del both, low, large, small
        tidy(now.sparkSession)
    return now.select(F.col("a").alias("key"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
