"""Peeling of sketches: all digests come out, or the sketch says that it holds more, and cells that are empty take no part in later rounds."""

import random

import pytest
from pyspark.sql import functions as F

from foresift.llm import fingerprints as f


@pytest.mark.parametrize("third", [f.SMALL, f.THIRD, f.LARGE])
def test_peeled_digests_are_those_of_one_side(spark, third):
    rng = random.Random(third)
    rows = []
    for k in range(60):
        words = [f"piece {k} {j} {rng.random()}" for j in range(rng.randint(0, 3 * third))]
        rows.append((k, "\n".join(words[: 2 * len(words) // 3]), "\n".join(words[len(words) // 3 :])))
    sides = spark.createDataFrame(rows, "k int, x string, y string").select(f.digests(F.col("x")).alias("a"), f.digests(F.col("y")).alias("b"))
    cells = lambda c: f.sketch(F.transform(c, lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), third)
    found = sides.select("a", "b", cells("a").alias("p"), cells("b").alias("q")).select("a", "b", f.peel(f.subtract(F.col("p"), F.col("q")), third).alias("r")).collect()
    whole = [r for r in found if r["r"]["ok"]]
    assert len(whole) > 30 and all(set(r["r"]["found"]) <= set(r["a"]) ^ set(r["b"]) for r in found)
    assert all(sorted(r["r"]["found"]) == sorted(set(r["a"]) ^ set(r["b"])) for r in whole)
