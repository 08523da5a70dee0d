"""Nearest vectors against a scan of all pairs."""

import math
import random

import numpy as np
import pytest

from foresift.llm import nearest, queries

SCHEMA = "vec_id long, embedding array<float>, label int, key long, ids long"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2) for i, v in rows], SCHEMA)


def exact(rows, every=100, k=10):
    """All pairs by loops: the ranking of each query, and the distance of its last one."""
    good = sorted({(i, tuple(np.float32(v).tolist())) for i, v in rows if i is not None and v and None not in v and all(map(math.isfinite, v)) and any(v)})
    out = {}
    for i, v in good:
        if i % every == 0:
            ranked = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(v, w, strict=True))), j) for j, w in good if j != i)
            out[i] = ranked[:k]
    return out


def found(df):
    by = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["rank"], r["score"], r["vec_id"]))
    return by


def recall(got, wanted):
    hits = total = 0
    for q, ranked in wanted.items():
        mine = got.get(q, [])
        assert [r for r, *_ in mine] == [*range(1, len(mine) + 1)]
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine) and len({x[2] for x in mine}) == len(mine)
        hits += sum(j in {x[2] for x in mine} for _, j in ranked)
        total += len(ranked)
    return hits / max(1, total)


def test_small_tables_are_exact(spark):
    rng = random.Random(2)
    vectors = [[rng.choice([-1.0, 0.0, 1.0, 2.0]) for _ in range(4)] for _ in range(90)]  # many ties and equal vectors
    rows = [(k * 25, v) for k, v in enumerate(vectors)] + [(7, vectors[0])] * 2 + [(None, vectors[1]), (9, None), (100_000, [0.0] * 4), (11, [1.0, None, 2.0, 3.0]), (200_000, [math.nan, 1.0, 1.0, 1.0]), (13, [math.inf, 0.0, 0.0, 1.0]), (14, []), (300_000, [1.0])]
    wanted = exact([r for r in rows if not (r[1] and len(r[1]) == 1)])
    got = found(nearest.nearest(frame(spark, rows)))
    assert got.keys() == wanted.keys()
    for q, ranked in wanted.items():
        assert [x[2] for x in got[q]] == [j for _, j in ranked]
        assert np.allclose([x[1] for x in got[q]], [d for d, _ in ranked], rtol=1e-12)


def test_few_and_none(spark):
    assert nearest.nearest(frame(spark, [])).count() == 0
    assert nearest.nearest(frame(spark, [(0, None)])).count() == 0
    assert found(nearest.nearest(frame(spark, [(0, [1.0, 0.0])]))) == {}
    assert found(nearest.nearest(frame(spark, [(0, [1.0, 0.0]), (5, [1.0, 3.0])]))) == {0: [(1, 3.0, 5)]}


@pytest.mark.parametrize("levels", [1, 3])
def test_recall(spark, monkeypatch, levels):
    """Clusters, plain noise and one vector that a third of all rows share; with small trees, leaves are split again and again."""
    if levels > 1:
        for name, value in {"DEPTH": 2, "LEAVES": 8, "LEAF": 12, "SAMPLE": 60, "TREES": 4, "GROUP": 40, "TRIED": 60}.items():
            monkeypatch.setattr(nearest, name, value)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(8, 12)) * 2
    vectors = np.concatenate([centres[rng.integers(8, size=500)] + 0.1 * rng.normal(size=(500, 12)), rng.normal(size=(500, 12)), np.tile(centres[:1], (500, 1))]).astype(np.float32)
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(1500), vectors, strict=True)]
    vectors = nearest.distinct_vectors(frame(spark, rows), "vec_id", "embedding", 11)
    forest = nearest.Forest(nearest.stored(vectors))
    assert (len(forest.levels) > 1) == (levels > 1)
    assert forest.placed.count() == nearest.TREES * 1001  # every vector is in one leaf of each tree
    wanted = exact(rows, 20)
    assert recall(found(nearest.nearest(frame(spark, rows), every=20)), wanted) >= 0.9


def test_one_queue():
    """The queue gives the leaves of all trees in the order of their distance past planes."""
    rng = np.random.default_rng(1)
    data = rng.normal(size=(400, 6))
    trees = [nearest.Tree(nearest.Tree.fitted(data, 4, seed)) for seed in range(3)]
    query, every = rng.normal(size=6), []
    for k, tree in enumerate(trees):
        waiting = [(0, 0.0)]
        while waiting:
            node, past = waiting.pop()
            if node < 0:
                every.append((past, k, -1 - node))
                continue
            off = float(tree.w[node] @ query - tree.at[node])
            waiting += [(int(tree.sides[node, 0]), past + max(off, 0) ** 2), (int(tree.sides[node, 1]), past + min(off, 0) ** 2)]
        assert len(np.unique(tree.leaf(data))) == 16
    got = nearest.nearest_leaves(trees, [0.0] * 3, query, 20)
    assert np.allclose([p for p, *_ in got], sorted(p for p, *_ in every)[:20])


def test_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert recall(found(queries.op12_nearest(spark, sf_dir)), exact(rows)) >= 0.9
