"""Near-duplicate detection moves only the texts that may be in clusters, and a bitmap of wanted keys misses none."""

import random

from pyspark.sql import functions as F

from foresift.llm import common, near_dedup
from foresift.llm.common import persist


def moved(spark, first):
    """Bytes that the stages from ``first`` on have written to shuffles."""
    store = spark.sparkContext._jsc.sc().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    own = [stages.apply(k) for k in range(stages.size())]
    return max(s.stageId() for s in own), sum(s.shuffleWriteBytes() for s in own if s.stageId() >= first)


def test_texts_beside_clusters_are_not_shuffled(spark):
    """Two near copies among 150 long texts: no more than a fraction of the texts' bytes is shuffled where nothing is broadcast by size."""
    rng = random.Random(4)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1200))) for k in range(150)]
    rows.append((150, rows[7][1] + " end"))
    docs = persist(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    size = sum(len(text) for _, text in rows)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last, _ = moved(spark, 0)
        got = {r["id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()}
        _, written = moved(spark, last + 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == {k: k for k in range(150)} | {150: 7}
    assert written < size / 4


def test_sets_of_clusters_are_shuffled_twice(spark, monkeypatch):
    """A hundred pairs of near copies: each set is moved to its class and to its group, and no text is; the same clusters where the bitmap is too full to be relied on."""
    rng = random.Random(6)
    rows = [(k, " ".join(f"{rng.getrandbits(64):x}" for _ in range(1200))) for k in range(100)]
    rows += [(100 + k, text + " end") for k, text in rows]
    docs = persist(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    sets = sum(8 * len(near_dedup.shingles(text)) for _, text in rows)
    want = {k: k % 100 for k in range(200)}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        last, _ = moved(spark, 0)
        assert {r["id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()} == want
        _, written = moved(spark, last + 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert written < 3 * sets
    monkeypatch.setattr(near_dedup, "REACH", 0)
    assert {r["id"]: r["component_id"] for r in near_dedup.near_dedup(docs).collect()} == want


def test_a_bitmap_misses_no_wanted_key(spark, monkeypatch):
    """Whole columns come back, null keys and repeated rows too; a full bitmap lets everything pass."""
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.col("id").cast("string").alias("x"))
    rows = persist(rows.union(rows.where("k <= 3")))
    wanted = rows.select(F.col("k").alias("w")).where("w is null or w <= 500").distinct()
    got = common.likely(rows, "k", wanted, 501)
    assert got.columns == ["k", "x"]
    assert got.where("k is null").count() == 1
    assert got.where("k <= 3").count() == 6
    assert got.where("k <= 500").count() == 503
    assert got.count() < 503 + 20_000 * 0.1
    monkeypatch.setattr(common, "MOST_BITS", 64)
    assert common.likely(rows, "k", wanted, 501).count() > 19_000
    assert common.likely(rows, "k", wanted.limit(0), 0).count() == 0
