"""Predictive distributions against closed forms, tables and sampling."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from foresift.functions import predictive as P

# Tabulated Student quantiles at 0.975.
TABLE = {3: 3.182446305284263, 5: 2.570581835636314, 10: 2.2281388519649385, 30: 2.042272456301238, 100: 1.983971518523552}


def closed(q, df):
    if df == 1:
        return math.tan(math.pi * (q - 0.5))
    a = 4 * q * (1 - q)
    if df == 2:
        return 2 * (q - 0.5) * math.sqrt(2 / a)
    c = math.cos(math.acos(math.sqrt(a)) / 3) / math.sqrt(a)
    return math.copysign(2 * math.sqrt(c - 1), q - 0.5)


def test_student_quantiles(spark):
    rows = spark.createDataFrame([(float(v),) for v in (1, 2, 4, *TABLE)], "df double")
    levels = (0.001, 0.05, 0.3, 0.5, 0.7, 0.975, 0.9995)
    for r in rows.select("df", *[P.t_quantile(q, F.col("df")).alias(str(k)) for k, q in enumerate(levels)]).collect():
        for k, q in enumerate(levels):
            if r["df"] in (1, 2, 4):
                assert r[str(k)] == pytest.approx(closed(q, r["df"]), rel=1e-9, abs=1e-12)
        if r["df"] in TABLE:
            assert r["5"] == pytest.approx(TABLE[r["df"]], abs=1e-9)
        assert r["1"] == pytest.approx(-spark.range(1).select(P.t_quantile(0.95, F.lit(r["df"]))).first()[0], rel=1e-12)


def test_many_degrees_are_normal(spark):
    r = spark.range(1).select(P.t_quantile(0.95, F.lit(1e6)).alias("t"), P.log_gamma(F.lit(0.5)).alias("half"), P.log_gamma(F.lit(171.0)).alias("large")).first()
    assert r["t"] == pytest.approx(NormalDist().inv_cdf(0.95), abs=1e-5)
    assert r["half"] == pytest.approx(math.lgamma(0.5), abs=1e-12) and r["large"] == pytest.approx(math.lgamma(171), rel=1e-14)


def test_samples_and_means(spark):
    df = spark.range(400).withColumns({"mu": F.lit(3.0), "s": F.lit(2.0), "df": F.lit(5.0)})
    normal, student = P.Gaussian(F.col("mu"), F.col("s")), P.Student(F.col("mu"), F.col("s"), F.col("df"))
    rows = df.select(normal.sample(50, F.col("id")).alias("n"), student.sample(50, F.col("id")).alias("t"), *[c.alias(k) for k, c in zip(("lo", "hi"), student.interval(0.1), strict=True)], student.mean().alias("m"))
    got = rows.collect()
    n, t = np.array([r["n"] for r in got]).ravel(), np.array([r["t"] for r in got]).ravel()
    assert n.mean() == pytest.approx(3, abs=0.05) and n.std() == pytest.approx(2, abs=0.05)
    assert np.quantile(t, [0.05, 0.95]) == pytest.approx([got[0]["lo"], got[0]["hi"]], abs=0.15) and got[0]["m"] == 3
    again = df.repartition(7).select("id", student.sample(50, F.col("id")).alias("t")).orderBy("id").collect()
    assert [r["t"] for r in again] == [r["t"] for r in df.select("id", student.sample(50, F.col("id")).alias("t")).orderBy("id").collect()]
    assert df.select(P.Student(F.col("mu"), F.col("s"), F.lit(1.0)).mean()).first()[0] is None
