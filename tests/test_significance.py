"""Tails of Student's t and what they decide."""

from pyspark.sql import functions as F

from foresift.functions import special
from foresift.operators import compare


def test_t_two_sided(spark):
    """Against the tables of Student's t at p = 0.05 and 0.01."""
    rows = [(2.570582, 5, 0.05), (-2.228139, 10, 0.05), (2.042272, 30, 0.05), (2.750000, 30, 0.01), (1.983972, 100, 0.05), (0.0, 7, 1.0)]
    found = spark.createDataFrame(rows, "x double, df long, p double").select("p", special.t_two_sided(F.col("x"), F.col("df")).alias("q")).collect()
    assert all(abs(r["p"] - r["q"]) < 2e-5 for r in found)


def test_verdict_needs_significance(spark):
    """A model that is better by chance does not beat the baseline; one that is better every time does."""
    rows = [(m, "a", 0, h, 0.0, e, -9.0, 9.0) for h in range(12) for m, e in (("base", 2.0), ("luck", 0.0 if h % 2 else 3.5), ("good", 1.0 + h % 2 / 9))]
    fc = spark.createDataFrame(rows, "model string, series_id string, fold long, h long, y_true double, y_pred double, lo double, hi double")
    board = compare.significance(compare.leaderboard(fc, "base", 0.1), fc, "base")
    found = {r["model"]: (r["skill"] > 0, r["sig"]) for r in board.collect()}
    assert found == {"good": (True, "***"), "luck": (True, ""), "base": (False, "—")}
    assert [r["verdict"] for r in compare.verdict(board, "base").collect()] == ["good"]
    assert [r["verdict"] for r in compare.verdict(board.where("model <> 'good'"), "base").collect()] == ["nothing beats base"]
