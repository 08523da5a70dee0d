"""Near-duplicate detection by chosen-path set similarity joins.

A document is the set of its five-word shingles; equal sets are one class. Each class has 128 minwise values. Several
independent trees branch all classes by a few of these: a node's children hold the classes that agree on the minwise
token at one chosen coordinate. Branching stops at nodes small enough to compare their members with one another.

Only connected components are wanted, so no step lists the pairs of a group. Sketches of the minwise values find
candidate clusters: each node's members meet its smallest member, then each small node gives a spanning forest of the
candidate pairs among its members. A cluster's full sets meet in one group and are compared there, which gives a
spanning forest of the links. A cluster that is too large for one group has its stars confirmed first; then only
members that may link different components meet again, the largest component dealt to parts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foresift.llm.common import REACH, lean, likely, removed, slices, stored, tidy
from foresift.llm.components import components, join, top

WORDS, SIMILARITY = 5, 0.75
#: Minwise values of a class; independent trees; members up to which a node is compared as a whole; levels below the first.
MINHASHES, TREES, SMALL, LEVELS = 128, 12, 1024, 4
#: A pair whose sketches agree less is no candidate: five standard deviations below the similarity.
SCREEN = SIMILARITY - 5 * (SIMILARITY * (1 - SIMILARITY) / MINHASHES) ** 0.5
#: Text handled at a time, in bytes.
SLICE = 1_000_000
#: Members of a star that are confirmed in one group; shingles for which a member counts once more toward a group's size.
STAR, HEAVY = 128, 512

_RNG = random.Random(7)
_MULTIPLY = np.array([_RNG.getrandbits(64) | 1 for _ in range(MINHASHES)], np.uint64)
_ADD = np.array([_RNG.getrandbits(64) for _ in range(MINHASHES)], np.uint64)
#: The coordinates by which the trees branch at their roots: each takes each with a chance of 1 / (similarity * MINHASHES).
ROOTS = np.array(sorted({k for _ in range(TREES) for k in range(MINHASHES) if _RNG.random() < 1 / (SIMILARITY * MINHASHES)}))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingles(text: str | None, memo: dict[bytes, int] | None = None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    memo = {} if memo is None else memo
    for w in words:
        if w not in memo:
            memo[w] = xxhash.xxh64_intdigest(w)
    h = np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))
    n = min(WORDS, len(h))
    out = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mix(out + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo: dict[bytes, int] = {}
    for batch in batches:
        for at, texts in slices(batch.column(1), SLICE):
            size, cls, nodes, sig = [], [], [], []
            for text in texts:
                s = shingles(text, memo)
                size.append(len(s))
                if len(memo) > 100_000:
                    memo.clear()
                if not len(s):
                    cls.append(None), nodes.append(None), sig.append(None)
                    continue
                low = np.full(MINHASHES, 2**64 - 1, np.uint64)
                for k in range(0, len(s), 2048):
                    low = np.minimum(low, (s[None, k : k + 2048] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()))
                nodes.append(_mix(low[ROOTS] + ROOTS.astype(np.uint64)).view(np.int64))
                sig.append(low.astype(np.uint16).tobytes())
            given = [batch.column(c)[at : at + len(texts)] for c in (0, 2)]
            columns = [*given, pa.array(size, pa.int64()), pa.array(cls, pa.binary()), pa.array(nodes, pa.list_(pa.int64())), pa.array(sig, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "version", "n", "cls", "nodes", "sig"])


def _screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches agree enough."""
    for batch in batches:
        a, b = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, MINHASHES) for k in (2, 3))
        ok = pa.array((a == b).mean(axis=1) >= SCREEN)
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(ok), batch.column(1).filter(ok)], names=["a", "b"])


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each node, from batches sorted by their first two columns."""
    held: pa.Table | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        held = rows if held is None else pa.concat_tables([held, rows])
        node, part = held["node"].to_numpy(), held["part"].to_numpy()
        cuts = np.flatnonzero((np.diff(node) != 0) | (np.diff(part) != 0)) + 1
        for start, end in zip([0, *cuts[:-1]], cuts, strict=False):
            yield held.slice(start, end - start)
        held = held.slice(cuts[-1] if len(cuts) else 0)
    if held is not None and held.num_rows:
        yield held


class _Group:
    """A group's members in order of their sets' sizes, and which of them are joined already."""

    def __init__(self, rows: pa.Table, label: np.ndarray):
        size = rows["n"].to_numpy()
        self.order = np.argsort(size, kind="stable")
        self.cls, self.size, self.side, self.label = rows["cls"].to_pylist(), size[self.order], rows["side"].to_numpy()[self.order], label[self.order]
        self.found: list[tuple[bytes, bytes]] = []

    def others(self, i: int) -> tuple[int, np.ndarray]:
        """The end of the members after i whose size allows a link with it, and which of them are to be compared with it."""
        end = int(np.searchsorted(self.size, self.size[i] * 100 // 75, "right"))
        at = slice(i + 1, end)
        return end, (self.label[at] != self.label[i]) & ((self.side[at] != self.side[i]) | (self.side[i] == 0))

    def join(self, i: int, mates: np.ndarray) -> None:
        """Join i with members, one of each part that is joined already."""
        for j in mates[np.unique(self.label[mates], return_index=True)[1]]:
            self.found.append((self.cls[self.order[i]], self.cls[self.order[j]]))
        self.label[np.isin(self.label, self.label[mates])] = self.label[i]

    def batch(self) -> pa.RecordBatch:
        """What was found, each tree as a star around its smallest class: it joins the same, in one step."""
        low: dict[bytes, bytes] = {}
        for x, y in self.found:
            join(low, x, y)
        self.found = [(top(low, x), x) for x in list(low) if top(low, x) != x]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in self.found], pa.binary()) for k in (0, 1)], names=["a", "b"])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the candidate pairs of different components in each node."""
    for rows in _groups(batches):
        group = _Group(rows, np.arange(rows.num_rows))
        component = np.unique(np.array(rows["component"].to_pylist(), object), return_inverse=True)[1][group.order]
        sig = np.frombuffer(b"".join(rows["sig"].to_pylist()), np.uint16).reshape(-1, MINHASHES)[group.order]
        for i in range(rows.num_rows):
            end, differ = group.others(i)
            at = np.flatnonzero(differ & (component[i + 1 : end] != component[i])) + i + 1
            if len(at):
                group.join(i, at[np.count_nonzero(sig[at] == sig[i], axis=1) >= SCREEN * MINHASHES])
        if group.found:
            yield group.batch()


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links between different components in each group, from the full sets."""
    for rows in _groups(batches):
        label = np.unique(np.array(rows["component"].to_pylist(), object), return_inverse=True)[1]
        group = _Group(rows, label)
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["set"]]
        token = np.unique(np.concatenate([sets[k] for k in group.order]), return_inverse=True)[1]
        start = np.concatenate([[0], np.cumsum(group.size)])
        held = np.zeros(len(token), np.int64)
        for i in range(rows.num_rows):
            end, differ = group.others(i)
            if not differ.any():
                continue
            own = token[start[i] : start[i + 1]]
            held[own] = 1
            both = np.add.reduceat(held[token[start[i + 1] : start[end]]], start[i + 1 : end] - start[i + 1])
            held[own] = 0
            alike = 100 * both >= 75 * (group.size[i] + group.size[i + 1 : end] - both)
            group.join(i, np.flatnonzero(differ & alike) + i + 1)
        if group.found:
            yield group.batch()


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Branch rows of large nodes: each node chooses its own coordinates."""
    coordinates = np.arange(MINHASHES, dtype=np.uint64)
    for batch in batches:
        node = batch.column(0).to_numpy().view(np.uint64)
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(-1, MINHASHES)
        dice = _mix(node[:, None] + _mix(coordinates + np.uint64(1))[None, :])
        row, k = np.nonzero(dice < np.uint64(int(2**64 / (SIMILARITY * MINHASHES))))
        child = _mix(dice[row, k] + sig[row, k].astype(np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(child), *[batch.column(c).take(pa.array(row)) for c in (1, 2, 3)]], names=["node", "cls", "sig", "n"])


def _distinct_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


class _Join:
    """The state of one join: classes with their sketches, nodes, and the texts that their sets come from."""

    def __init__(self, docs: DataFrame, features: DataFrame):
        """``features`` are read once, and their files deleted."""
        self.texts = docs
        self.made: list[DataFrame] = []
        some = features.where(F.col("cls").isNotNull()).groupBy("cls").agg(F.min(F.struct("id", "n", "sig", "nodes")).alias("m"))
        self.classes = self.kept(some.select("cls", "m.*"))
        removed(features)
        rows = self.classes.select("cls", F.explode("nodes").alias("node"))
        shared = rows.groupBy("node").agg(F.count("*").alias("size"), F.min("cls").alias("low")).where("size > 1")
        self.nodes = self.kept(rows.join(shared, "node").select("node", "cls", "low"))

    def kept(self, rows: DataFrame) -> DataFrame:
        """Rows in files, of which later steps' tasks read as many at a time as Spark packs, until the join is done. Shuffle files of the steps before go."""
        self.made.append(stored(rows))
        tidy(rows.sparkSession)
        return self.made[-1]

    def dropped(self, since: int) -> None:
        """Delete what was kept after the first ``since`` tables, but for the last."""
        removed(*self.made[since:-1])
        del self.made[since:-1]

    def stars(self) -> DataFrame:
        """Candidate pairs (``a, b``) of each node's members with its smallest."""
        pairs = _distinct_pairs(self.nodes.select(F.col("low").alias("a"), F.col("cls").alias("b")))
        a, b = self.classes.select(F.col("cls").alias("a"), F.col("sig").alias("sig_a")), self.classes.select(F.col("cls").alias("b"), F.col("sig").alias("sig_b"))
        return self.kept(pairs.join(a, "a").join(b, "b").select("a", "b", "sig_a", "sig_b").mapInArrow(lean(_screen), "a binary, b binary"))

    @staticmethod
    def _mixed(rows: DataFrame, labels: DataFrame) -> DataFrame:
        """Rows of the nodes with several components, with ``component, size, main_size, main``; ``main`` is the largest.

        ``rows`` has ``node, cls, weight`` and others, ``labels`` the component of a ``key``.
        """
        marked = rows.join(labels.select(F.col("key").alias("cls"), "component"), "cls", "left").withColumn("component", F.coalesce("component", "cls"))
        by = marked.groupBy("node", "component").agg(F.sum("weight").alias("n"))
        nodes = by.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "component")).alias("m")).where("size > m.n")
        return marked.join(nodes.select("node", "size", F.col("m.n").alias("main_size"), F.col("m.component").alias("main")), "node")

    @staticmethod
    def _settled(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The rows of nodes that can be compared, with ``part`` and ``side``, and those of nodes that are too large.

        A large node in which few members are not of the main component is not too large: the main component is dealt
        to parts, and the few meet each.
        """
        half = SMALL // 2
        few = F.col("size") - F.col("main_size") <= half
        whole = rows.where(F.col("size") <= SMALL).withColumn("part", F.lit(0).cast("long"))
        parts = F.ceil(F.col("main_size") / half)
        own = F.array(F.pmod(F.xxhash64("cls"), parts))
        dealt = rows.where((F.col("size") > SMALL) & few).withColumn("part", F.explode(F.when(F.col("component") == F.col("main"), own).otherwise(F.sequence(F.lit(0).cast("long"), parts - 1))))
        return whole.unionByName(dealt).withColumn("side", F.lit(0)), rows.where((F.col("size") > SMALL) & ~few)

    def small_nodes(self, nodes: DataFrame, labels: DataFrame) -> DataFrame:
        """``node, part, side, cls, component, n, sig`` of the nodes with several components, branched until they are small.

        A node that is large at the last level is compared in pairs of parts.
        """
        columns = ["node", "part", "side", "cls", "component", "n", "sig"]
        one = F.lit(1).alias("weight")
        mixed = self._mixed(nodes.select("node", "cls", one), labels)
        done, large = self._settled(self.kept(mixed.join(self.classes.select("cls", "sig", "n"), "cls")))
        done = done.select(columns)
        for _ in range(LEVELS):
            if large.isEmpty():
                return done
            child = self.kept(large.select("node", "cls", "sig", "n").mapInArrow(lean(_children), "node long, cls binary, sig binary, n long").dropDuplicates(["node", "cls"]))
            more, large = self._settled(self.kept(self._mixed(child.withColumn("weight", one), labels)))
            done = done.unionByName(more.select(columns))
        n = F.ceil(F.col("size") * 2 / SMALL).cast("int")
        own = F.pmod(F.xxhash64("cls"), n).cast("int")
        cells = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((F.least(own, k) * n + F.greatest(own, k)).cast("long").alias("part"), F.when(own == k, 0).when(own < k, 1).otherwise(2).alias("side")))
        return done.unionByName(large.withColumn("at", F.explode(cells)).withColumns({"part": F.col("at.part"), "side": F.col("at.side")}).select(columns))

    def _grouped(self, rows: DataFrame, run) -> DataFrame:
        return self.kept(rows.repartition("node", "part").sortWithinPartitions("node", "part").mapInArrow(lean(run), "a binary, b binary"))

    def clusters(self, nodes: DataFrame, labels: DataFrame, base: DataFrame) -> tuple[DataFrame, DataFrame]:
        """``key, component``: clusters of classes that candidate pairs of different components join, beside those that ``base`` joins; and the nodes' rows."""
        rows = self.small_nodes(nodes, labels)
        return self.kept(components(self._grouped(rows, _candidates).union(base))), rows

    def sets(self, clusters: DataFrame) -> DataFrame:
        """``cls, n, set`` (the sorted shingles, eight bytes each) of the classes in clusters, and of a few others.

        Texts are not shuffled, only sets are: bitmaps of the wanted ids and classes let few others pass.
        """
        classes, count = clusters.select(F.col("key").alias("cls")), clusters.count()
        wanted = classes.join(self.classes.select("cls", "id"), "cls").select(F.col("id").alias("wanted")).distinct()
        own = likely(self.texts, "id", wanted, count)
        if count > REACH:  # an inner join: Spark would move a semi join below the bitmap
            own = own.join(wanted, F.col("id").eqNullSafe(F.col("wanted")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, texts in slices(batch.column(0), SLICE):
                    found = [shingles(t) for t in texts]
                    columns = [pa.array([xxhash.xxh3_128_digest(x.tobytes()) for x in found], pa.binary()), pa.array(list(map(len, found)), pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["cls", "n", "set"])

        found = likely(own.select("text").mapInArrow(lean(run), "cls binary, n long, set binary"), "cls", classes, count)
        return found.groupBy("cls").agg(F.first("n").alias("n"), F.first("set").alias("set"))

    def links(self, groups: DataFrame, sets: DataFrame) -> DataFrame:
        """Links (``a, b``) in groups (``node, part, side, cls, component``)."""
        return self._grouped(groups.select("node", "part", "side", "cls", "component").join(sets, "cls"), _links)

    def run(self) -> DataFrame:
        """``key, component`` of the classes that are linked with another."""
        stars = self.stars()
        likely = self.kept(components(stars))
        since = len(self.made)
        clusters, _ = self.clusters(self.nodes, likely, likely)
        self.dropped(since)
        sets = self.sets(clusters)
        weighed = clusters.select(F.xxhash64("component").alias("node"), F.col("key").alias("cls")).join(self.classes.select("cls", (1 + F.floor(F.col("n") / HEAVY)).alias("weight")), "cls")
        sized = self.kept(weighed.join(weighed.groupBy("node").agg(F.sum("weight").alias("size")), "node"))
        alone = sized.where(F.col("size") <= SMALL).select("node", F.lit(0).cast("long").alias("part"), F.lit(0).alias("side"), "cls", F.col("cls").alias("component"))
        large = sized.where(F.col("size") > SMALL).select("cls", "weight")
        if large.isEmpty():
            labels = stored(components(self.links(alone, sets)))  # the join meets the sets where they are grouped
        else:
            sets = self.kept(sets)
            labels = self._large(large, self.kept(components(self.links(alone.unionByName(self._star_groups(stars, large)), sets))), sets)
        removed(*self.made)
        return labels

    def _star_groups(self, stars: DataFrame, large: DataFrame) -> DataFrame:
        """The stars of classes in large clusters, each in groups of about ``STAR`` members and the star's centre."""
        some = stars.join(large.select(F.col("cls").alias("b")), "b", "left_semi")
        sizes = some.groupBy("a").agg(F.ceil(F.count("*") / STAR).alias("parts"))
        dealt = some.join(sizes, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
        members = dealt.select("a", "part", F.col("b").alias("cls")).union(dealt.select("a", "part", "a").distinct())
        return members.select(F.xxhash64(F.lit("star"), F.col("a")).alias("node"), "part", F.lit(0).alias("side"), "cls", F.col("cls").alias("component"))

    def _large(self, large: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
        """Find the links between the components that the stars of large clusters have left."""
        nodes = self.nodes.join(large, "cls", "left_semi")
        nothing = labels.limit(0)
        clusters, rows = self.clusters(nodes, labels, nothing)
        members = clusters.select(F.xxhash64("component").alias("node"), F.col("key").alias("cls")).join(large, "cls")
        ready, beyond = self._settled(self.kept(self._mixed(members, labels)))
        groups = ready.select("node", "part", "side", "cls", "component").unionByName(rows.join(beyond.select("cls"), "cls", "left_semi").select("node", "part", "side", "cls", "component"))
        return stored(components(self.links(groups, sets).union(labels)))


def _decide(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, version, n_shingles, component_id, kept`` of every row; ``version`` is a hash of the text."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    read = texts.withColumn("version", F.xxhash64("text"))
    features = stored(read.mapInArrow(lean(_features), f"id {kind}, version long, n long, cls binary, nodes array<long>, sig binary"))
    own = stored(features.select("id", "version", "n", "cls"))
    labels = _Join(texts, features).run().withColumnRenamed("key", "cls")
    rows = own.join(labels, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    least = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("id").alias("component_id"))
    found = rows.join(least, "component", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return found.select("id", "version", F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id, kept`` of every row.

    Rows are linked if their sets' Jaccard similarity is 0.75 or more; ``component_id`` is the smallest id that can be
    reached by links, ``kept`` says that it is the row's own. Null texts, empty ones and those without words have an
    empty set and are linked with nothing. Shorter texts than five words are one shingle. Null ids are passed over when
    the smallest is sought; a component of null ids only has a null component_id, and its rows are kept. Repeated rows
    are one class and get equal answers. An empty table gives an empty result. Other columns are not read.
    """
    return _decide(docs, id_col, text_col).drop("version")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of each component those with its smallest id."""
    lost = stored(_decide(docs, id_col, text_col).where("not kept").select(F.col("id").alias("__id"), F.col("version").alias("__version")).distinct())
    return docs.join(lost, docs[id_col].eqNullSafe(lost["__id"]) & (F.xxhash64(docs[text_col]) == lost["__version"]), "left_anti")
