"""Split ranks against NumPy, and exact significance against all orders."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.operators import quality, ranks

SCHEMA = "feature string, x double"


def sides():
    rng = np.random.default_rng(8)
    ref = {"normal": rng.normal(0, 1, 900), "ties": rng.integers(0, 5, 700).astype(float), "hot": np.r_[np.zeros(600), rng.normal(3, 1, 50)], "one": np.array([2.0]), "few": rng.normal(0, 1, 9)}
    cur = {"normal": rng.normal(0.3, 1, 800), "ties": rng.integers(1, 6, 500).astype(float), "hot": np.r_[np.zeros(100), rng.normal(3, 1, 500)], "one": np.array([2.0, 3.0]), "few": rng.normal(1, 1, 12)}
    return ref, cur


def frame(spark, data):
    rows = [(k, float(v)) for k, x in data.items() for v in x] + [("normal", None), ("ties", float("nan"))]
    return spark.createDataFrame(rows, SCHEMA).withColumn("other", F.lit(1)).repartition(5)


@pytest.mark.parametrize("blocks", [2, 7, 64])
def test_quantiles(spark, blocks):
    ref, _ = sides()
    levels = [0.0, 0.05, 0.1, 0.5, 0.777, 1.0]
    got = {r["feature"]: r["quantiles"] for r in ranks.percentiles(frame(spark, ref), levels, blocks).collect()}
    assert got.keys() == ref.keys()
    for k, x in ref.items():
        assert got[k] == pytest.approx(np.quantile(x, levels), abs=1e-12)
    assert ranks.percentiles(spark.createDataFrame([], SCHEMA), levels).count() == 0


def distance(a, b):
    return max(abs((a <= v).mean() - (b <= v).mean()) for v in np.r_[a, b])


def test_drift(spark):
    ref, cur = sides()
    got = {r["feature"]: r for r in quality.drift_report(frame(spark, ref), frame(spark, cur)).collect()}
    for k in ref:
        a, b = ref[k], cur[k]
        edges = np.r_[-np.inf, np.quantile(a, np.arange(1, 10) / 10), np.inf]
        p, q = (np.maximum([((x >= lo) & (x < hi)).mean() for lo, hi in zip(edges, edges[1:], strict=False)], 1e-6) for x in (a, b))
        assert got[k]["psi"] == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=1e-9)
        assert got[k]["ks"] == pytest.approx(distance(a, b), abs=1e-12)


def test_exact_significance(spark):
    """All orders of up to 12 values a side (or those of small sides) are as likely: count them."""
    cases, rows = [(3, 4), (5, 5), (6, 3), (12, 2), (1, 6)], []
    wanted = {}
    for n, m in cases:
        orders = []
        for own in combinations(range(n + m), n):
            taken = np.isin(np.arange(n + m), own)
            orders.append(np.abs(np.cumsum(taken) * m - np.cumsum(~taken) * n).max())
        for steps in sorted(set(orders)):
            wanted[n, m, int(steps)] = np.mean(np.array(orders) >= steps)
            rows.append((n, m, int(steps)))
    df = spark.createDataFrame(rows, "n long, m long, s long").withColumn("p", ranks.exact_tail(F.col("n"), F.col("m"), F.col("s")))
    for r in df.collect():
        assert r["p"] == pytest.approx(wanted[r["n"], r["m"], r["s"]], abs=1e-12)


def test_small_samples_are_exact(spark):
    a, b = np.arange(12) + 0.5, np.arange(12) * 1.3 - 2
    got = quality.ks(frame(spark, {"few": a}).where("feature = 'few'"), frame(spark, {"few": b}).where("feature = 'few'")).first()
    steps = round(distance(a, b) * 144)
    p = spark.range(1).select(ranks.exact_tail(F.lit(12), F.lit(12), F.lit(steps)).alias("p")).first()[0]
    assert got["p"] == pytest.approx(p) and 0 < p < 1
