"""Connected components: few tasks on a small graph in many partitions, and the rounds that a large one goes through."""

import random

import pytest

from foresift.llm import components
from foresift.llm.common import persist


def graph(seed):
    """Chains in random order, stars and pairs, over keys of 16 bytes, with the smallest key that each reaches."""
    rng = random.Random(seed)
    keys = [rng.randbytes(16) for _ in range(700)]
    chain, star, rest = keys[:300], keys[300:400], keys[400:]
    edges = list(zip(chain, chain[1:], strict=False)) + [(star[0], k) for k in star[1:]] + list(zip(rest[::2], rest[1::2], strict=True))
    want = dict.fromkeys(chain, min(chain)) | dict.fromkeys(star, min(star)) | {k: min(pair) for pair in zip(rest[::2], rest[1::2], strict=True) for k in pair}
    rng.shuffle(edges)
    return edges, want


def dealt(spark, edges):
    return persist(spark.createDataFrame(edges, "a binary, b binary").repartition(24))


def found(table):
    return {bytes(r["key"]): bytes(r["component"]) for r in components.components(table).collect()}


@pytest.mark.parametrize("held", [40, 100])
def test_a_graph_beyond_one_task(spark, monkeypatch, held):
    """Tasks that may hold few keys begin anew, so that rounds have to join what they left."""
    monkeypatch.setattr(components, "HELD", held, raising=False)
    edges, want = graph(1)
    assert found(dealt(spark, edges)) == want


def test_a_small_graph_takes_few_tasks(spark):
    """Rounds of shuffles took 130, and more with more partitions."""
    sc = spark.sparkContext
    edges, want = graph(2)
    table = dealt(spark, edges)
    sc.setJobGroup("components", "components")
    try:
        assert found(table) == want
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    tracker = sc.statusTracker()
    stages = {k for job in tracker.getJobIdsForGroup("components") for k in tracker.getJobInfo(job).stageIds}
    assert sum(s.numCompletedTasks for s in map(tracker.getStageInfo, stages) if s) < 80
