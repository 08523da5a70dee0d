"""Nearest vectors by a forest of random-projection trees that is searched through one queue for all trees.

Equal vectors are one entry with its smallest ids. A tree splits at the median of the projection on the difference of two
of its vectors, found on a bounded sample of each node; all vectors are dealt to its leaves, and leaves that are still too
large are split again by further levels, fitted on samples of their own, until none is left that can be split. A query goes
down all trees at once: the queue gives the part that its splitting planes hold nearest, whichever tree it is of, until
so many leaves are found (of further levels, the same among the leaves found so far). What stands in those leaves is
ranked by its exact distance. How many leaves to visit is measured: on a bounded number of vectors whose true neighbours a
scan finds, the least number that reaches the recall asked for.
"""

from __future__ import annotations

import heapq
import io
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foresift.llm.common import lean, stored

TREES, LEAF, DEPTH = 16, 128, 8
#: Vectors that a node's planes are fitted on, and vectors that the number of leaves is measured on, both about.
SAMPLE, TRIED = 8_192, 160
#: Recall to reach on the latter, and leaves that a query visits at first there.
RECALL, FIRST = 0.95, 256
#: Rows of a task's group: vectors going down a further level, and queries in one leaf.
GROUP = 65_536
LEAVES = 1 << (DEPTH + 1)


class Tree:
    """Splitting planes: a row each with its direction, threshold and two children, the one below the threshold first (from 0: a plane; below: -1 - leaf)."""

    def __init__(self, planes: np.ndarray):
        self.w, self.at, self.sides = planes[:, :-3], planes[:, -3], planes[:, -2:].astype(np.int64)

    @classmethod
    def fitted(cls, vectors: np.ndarray, depth: int, seed: int) -> np.ndarray:
        """Planes that halve a sample down to a depth, or until its vectors project to the same place."""
        rng, planes, leaves = np.random.default_rng(seed), [], 0
        waiting = [(vectors, depth, None)]
        while waiting:
            own, left, place = waiting.pop()
            plane = None
            if left and len(own) > 1:
                a, b = own[rng.choice(len(own), 2, replace=False)]
                w = a - b
                if (size := np.linalg.norm(w)) > 0:
                    projected = own @ (w := w / size)
                    middle = float(np.median(projected))
                    if projected.max() > middle:
                        plane = [*w, middle, 0, 0]
                    elif projected.min() < middle:  # more than half lie at the top
                        plane = [*w, float(projected[projected < middle].max()), 0, 0]
            if plane is None:
                name, leaves = -1 - leaves, leaves + 1
            else:
                name = len(planes)
                planes.append(plane)
                low = projected <= plane[-3]
                waiting += [(own[~low], left - 1, (name, -1)), (own[low], left - 1, (name, -2))]
            if place:
                planes[place[0]][place[1]] = name
        return np.array(planes, np.float64).reshape(len(planes), vectors.shape[1] + 3)

    def leaf(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        at = np.full(len(vectors), 0 if len(self.w) else -1)
        while (on := np.flatnonzero(at >= 0)).size:
            plane = at[on]
            low = np.einsum("ij,ij->i", vectors[on], self.w[plane]) <= self.at[plane]
            at[on] = self.sides[plane, np.where(low, 0, 1)]
        return -1 - at

    def below(self, node: int, past: float, projected: np.ndarray) -> Iterator[tuple[float, int]]:
        """A plane's children and the squared distance past planes, given a query's distances past all of them."""
        off = float(projected[node])
        yield past + max(off, 0.0) ** 2, int(self.sides[node, 0])
        yield past + min(off, 0.0) ** 2, int(self.sides[node, 1])


def packed(planes: np.ndarray) -> bytes:
    file = io.BytesIO()
    np.save(file, planes)
    return file.getvalue()


def unpacked(raw: bytes) -> np.ndarray:
    return np.load(io.BytesIO(raw))


def nearest_leaves(trees: list[Tree], starts: list[float], query: np.ndarray, most: int) -> list[tuple[float, int, int]]:
    """``distance past planes, tree, leaf`` of the leaves nearest to a query in all trees, through one queue."""
    projected = [t.w @ query - t.at for t in trees]
    queue = [(past, k, 0 if len(t.w) else -1) for k, (t, past) in enumerate(zip(trees, starts, strict=True))]
    heapq.heapify(queue)
    found = []
    while queue and len(found) < most:
        past, k, node = heapq.heappop(queue)
        if node < 0:
            found.append((past, k, -1 - node))
        else:
            for p, child in trees[k].below(node, past, projected[k]):
                heapq.heappush(queue, (p, k, child))
    return found


def _vectors(column: pa.Array) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.float64)


def distinct_vectors(embeddings: DataFrame, id_col: str, vector_col: str, ids: int) -> DataFrame:
    """``key, vec, ids``: each distinct vector with its smallest ids, the first of which is its key.

    Rows with a null id, and vectors that are null, zero, of another length than most, or hold null or non-finite components take no part.
    """
    good = "id IS NOT NULL AND size(vec) > 0 AND NOT exists(vec, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf')) AND exists(vec, x -> x <> 0)"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vec")).where(good)
    length = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    rows = rows.where(F.size("vec") == (length[0] if length else 0))
    ranked = rows.withColumn("k", F.dense_rank().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("k") <= ids)
    return ranked.groupBy("vec").agg(F.sort_array(F.collect_set("id")).alias("ids")).select(F.col("ids")[0].alias("key"), "vec", "ids")


def _fit(rows: DataFrame, split_only: bool = True) -> DataFrame:
    """``tree, node, planes`` of the nodes that could be split, from samples ``tree, node, size, vec``."""
    leaf, deepest = LEAF, DEPTH

    def fit(group: pa.Table) -> pa.Table:
        tree, node, size = (group[c][0].as_py() for c in ("tree", "node", "size"))
        vectors = _vectors(group["vec"])
        vectors = vectors[np.lexsort(vectors.T)]  # whatever order they came in
        depth = min(deepest, max(0, math.ceil(math.log2(size / leaf))))
        planes = Tree.fitted(vectors, depth, (tree << 8) ^ node)
        return pa.table({"tree": pa.array([tree], pa.int32()), "node": pa.array([node], pa.int64()), "planes": pa.array([packed(planes)], pa.binary())})[: len(planes) or first]

    first = 0 if split_only else 1
    return rows.groupBy("tree", "node").applyInArrow(fit, "tree int, node long, planes binary")


class Forest:
    """An index of distinct vectors. The first level is of bounded size and shipped to all tasks; further ones are tables."""

    def __init__(self, vectors: DataFrame):
        self.vectors, self.spark = vectors, vectors.sparkSession
        self.size = vectors.count()
        rate = min(1.0, SAMPLE / max(1, self.size))
        picked = vectors.select(F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"), F.lit(1).cast("long").alias("node"), F.lit(self.size).alias("size"), "key", "vec")
        picked = picked.where(F.pmod(F.xxhash64("tree", "key"), F.lit(1 << 30)) < int(rate * (1 << 30)))
        planes = {r["tree"]: unpacked(bytes(r["planes"])) for r in _fit(picked, split_only=False).collect()}  # TREES * 2^DEPTH planes at most
        self.top = self.spark.sparkContext.broadcast([planes[t] for t in sorted(planes)])
        self.placed, self.levels = self._top_leaves(), []
        tried = None
        while True:
            sizes = self.placed.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") > 2 * LEAF)
            large = stored(sizes if tried is None else sizes.join(tried, ["tree", "node"], "left_anti"))
            if large.limit(1).count() == 0:
                break
            self._deeper(large)
            tried = large.select("tree", "node") if tried is None else tried.unionByName(large.select("tree", "node"))

    def _top_leaves(self) -> DataFrame:
        """Every vector once a tree, with its leaf of the first level."""
        top, leaves = self.top, LEAVES

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [Tree(p) for p in top.value]
            for batch in batches:
                vectors = _vectors(batch.column(1))
                for k, tree in enumerate(trees):
                    n = len(vectors)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, k), pa.int32()), pa.array(leaves + tree.leaf(vectors), pa.int64()), *batch.columns], names=["tree", "node", "key", "vec", "ids"])

        kinds = dict(self.vectors.dtypes)
        return self.vectors.mapInArrow(lean(place), f"tree int, node long, key long, vec {kinds['vec']}, ids {kinds['ids']}")

    def _deeper(self, large: DataFrame) -> None:
        """Split these nodes by trees of their own. One that cannot be split stays as it is."""
        rows = self.placed.join(large, ["tree", "node"])
        rate = F.lit(SAMPLE) / F.col("size")
        picked = rows.where(F.pmod(F.xxhash64("tree", "node", "key"), F.lit(1 << 30)) < rate * (1 << 30))
        level = stored(_fit(picked.select("tree", "node", "size", "vec")))
        kinds = dict(self.placed.dtypes)
        schema, leaves = f"tree int, node long, key long, vec {kinds['vec']}, ids {kinds['ids']}", LEAVES

        def place(planes: np.ndarray, group: pa.Table) -> pa.Table:
            leaf = group["node"].to_numpy() * leaves + Tree(planes).leaf(_vectors(group["vec"]))
            return pa.table({"tree": group["tree"], "node": pa.array(leaf, pa.int64()), "key": group["key"], "vec": group["vec"], "ids": group["ids"]})

        went = _met(self.placed, level, place, schema)
        self.placed = stored(went.unionByName(self.placed.join(level.select("tree", "node"), ["tree", "node"], "left_anti")))
        self.levels.append(level)

    def leaves(self, queries: DataFrame, most: int) -> DataFrame:
        """``query, vec, tree, node, at``: the leaves that each of ``key, vec`` visits, in the order of ``at`` (from 1)."""
        top, kind, leaves = self.top, dict(queries.dtypes)["vec"], LEAVES
        schema = f"query long, vec {kind}, tree int, node long, past double"

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            trees = [Tree(p) for p in top.value]
            for batch in batches:
                for row, vector in enumerate(_vectors(batch.column(1))):
                    found = nearest_leaves(trees, [0.0] * len(trees), vector, most)
                    n = pa.array(np.full(len(found), row))
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(n), batch.column(1).take(n), pa.array([t for _, t, _ in found], pa.int32()), pa.array([leaves + k for *_, k in found], pa.int64()), pa.array([p for p, *_ in found])], names=["query", "vec", "tree", "node", "past"])

        found = queries.select("key", "vec").mapInArrow(lean(down), schema)

        def further(planes: np.ndarray, group: pa.Table) -> pa.Table:
            tree, parts = [Tree(planes)], []
            for row, (vector, past, node) in enumerate(zip(_vectors(group["vec"]), group["past"].to_pylist(), group["node"].to_pylist(), strict=True)):
                parts += [(row, p, node * leaves + leaf) for p, _, leaf in nearest_leaves(tree, [past], vector, most)]
            n = pa.array([r for r, *_ in parts], pa.int64())
            return pa.table({"query": group["query"].take(n), "vec": group["vec"].take(n), "tree": group["tree"].take(n), "node": pa.array([x for *_, x in parts], pa.int64()), "past": pa.array([p for _, p, _ in parts], pa.float64())})

        order = Window.partitionBy("query").orderBy("past", "tree", "node")
        best = lambda df: df.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most)
        for level in self.levels:
            went = _met(found, level, further, schema)
            found = best(went.unionByName(found.join(level.select("tree", "node"), ["tree", "node"], "left_anti").select("query", "vec", "tree", "node", "past"))).drop("at")
        return best(found)

    def search(self, queries: DataFrame, k: int, most: int) -> DataFrame:
        """``query, found``: for each of ``key, vec`` the ``k`` nearest distinct vectors in the leaves it visits, as ``d, key, ids``, itself included."""
        kind = dict(self.placed.dtypes)["ids"]
        schema = f"query long, d double, key long, ids {kind}"

        def rank(leaf: pa.Table, group: pa.Table) -> pa.Table:
            members, out = _vectors(leaf["vec"]), []
            for row, vector in enumerate(_vectors(group["vec"])):
                d = np.sqrt(((members - vector) ** 2).sum(axis=1))
                near = np.argpartition(d, k - 1)[:k] if k < len(d) else np.arange(len(d))
                near = np.flatnonzero(d <= d[near].max())  # ties with the last one too
                keys = leaf["key"].to_numpy()[near]
                near = near[np.lexsort((keys, d[near]))][:k]
                out.append((np.full(len(near), row), near, d[near]))
            rows, near, d = (np.concatenate(x) for x in zip(*out, strict=True))
            return pa.table({"query": group["query"].take(pa.array(rows)), "d": pa.array(d), "key": leaf["key"].take(pa.array(near)), "ids": leaf["ids"].take(pa.array(near))})

        hits = _met(self.leaves(queries, most), self.placed.select("tree", "node", "key", "vec", "ids"), rank, schema)
        hits = hits.groupBy("query", "key").agg(F.first("d").alias("d"), F.first("ids").alias("ids"))
        nearest = hits.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("d", "key"))).where(F.col("k") <= k)
        return nearest.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("d", "key", "ids"))).alias("found"))

    def leaves_for(self, recall: float = RECALL, k: int = 10) -> int:
        """The least number of leaves a query has to visit for this recall, measured on about ``TRIED`` vectors against a scan of all."""
        share = min(1.0, TRIED / max(1, self.size))
        tried = stored(self.vectors.where(F.pmod(F.xxhash64(F.lit("tried"), "key"), F.lit(1 << 30)) < int(share * (1 << 30))).select("key", "vec"))
        true = stored(scan(self.vectors, tried, k + 1).where("key <> query").select("query", "key"))
        near = true.count()
        if not near:
            return 1
        homes = stored(self.placed.join(true, "key").select("query", "key", "tree", "node"))
        most = FIRST
        while True:
            visited = self.leaves(tried, most).select("query", "tree", "node", "at")
            firsts = homes.join(visited, ["query", "tree", "node"]).groupBy("query", "key").agg(F.min("at").alias("at"))
            reached = [(r["at"], r["n"]) for r in firsts.groupBy("at").agg(F.count(F.lit(1)).alias("n")).orderBy("at").collect()]
            upto = np.cumsum([n for _, n in reached] or [0])
            if upto[-1] >= recall * near:
                return int(reached[int(np.searchsorted(upto, recall * near))][0])
            most *= 4


def _met(rows: DataFrame, sides: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``run(what a node has in sides, a group of the node's rows)`` wherever a node has both; a node's rows are dealt to groups of ``GROUP`` at most or so."""
    hot = stored(rows.groupBy("tree", "node").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts")).where("parts > 1"))
    hot = F.broadcast(hot) if hot.count() <= 100_000 else hot
    spread = rows.join(hot, ["tree", "node"], "left").withColumn("part", F.pmod(F.xxhash64("vec"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    copies = sides.join(hot, ["tree", "node"], "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return empty
        return run(unpacked(right["planes"][0].as_py()) if "planes" in right.column_names else right, left).cast(empty.schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    empty = to_arrow_schema(rows.sparkSession.createDataFrame([], schema).schema).empty_table()
    keys = ["tree", "node", "part"]
    return spread.groupBy(*keys).cogroup(copies.groupBy(*keys)).applyInArrow(both, schema)


def scan(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query, key, d``: the ``k`` nearest of all vectors to each of a bounded number of ``key, vec``, by comparing them all."""
    asked = queries.collect()
    if not asked:
        return vectors.sparkSession.createDataFrame([], "query long, key long, d double")
    shared = vectors.sparkSession.sparkContext.broadcast(([r["key"] for r in asked], np.array([r["vec"] for r in asked], np.float64)))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sought = shared.value
        for batch in batches:
            own, keys = _vectors(batch.column(1)), batch.column(0).to_numpy()
            for name, vector in zip(names, sought, strict=True):
                d = np.sqrt(((own - vector) ** 2).sum(axis=1))
                best = np.lexsort((keys, d))[:k]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(best), name)), pa.array(keys[best]), pa.array(d[best])], names=["query", "key", "d"])

    found = vectors.select("key", "vec").mapInArrow(lean(near), "query long, key long, d double")
    return found.withColumn("k", F.row_number().over(Window.partitionBy("query").orderBy("d", "key"))).where(F.col("k") <= k).drop("k")


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` its ``k`` nearest others by Euclidean distance in double precision, ties to the smaller id.

    Found with about the ``recall`` asked for; what is found has its exact distance. Rows with a null id, and vectors that
    are null, zero, of another length than most, or hold null or non-finite components take no part. Equal vectors are
    distinct neighbours; repeated rows (same id and vector) are one. Of n others, n are returned where n < ``k``. An
    empty table gives an empty result. Only the two named columns are read.
    """
    vectors = stored(distinct_vectors(embeddings, id_col, vector_col, k + 1))
    asked = embeddings.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector_col).alias("vec")).where(F.col(id_col) % every == 0).distinct()
    asked = asked.join(vectors.select(F.col("vec").alias("v"), "key"), F.col("vec") == F.col("v")).select("query_id", "vec", "key")
    if vectors.limit(1).count() == 0:
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    forest = Forest(vectors)
    found = forest.search(asked.select("key", "vec").distinct(), k + 1, forest.leaves_for(recall, k))
    rows = asked.join(found, F.col("key") == F.col("query")).select("query_id", F.explode("found").alias("f")).select("query_id", F.col("f.d").alias("score"), F.explode("f.ids").alias("vec_id")).where("vec_id <> query_id")
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
