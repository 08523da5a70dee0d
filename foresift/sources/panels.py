"""Panels of series from the star-schema and event tables: ``series_id, ds, t, y``, t counting steps from the panel's first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regularize(observed: DataFrame, unit: str, step: int = 1) -> DataFrame:
    """Put ``series_id, ds, y`` on a full grid between the panel's first and last step; missing steps have y null.

    The grid is exploded from one row a series; the span is one row and broadcast.
    """
    span = observed.agg(F.min("ds").alias("lo"), F.max("ds").alias("hi"))
    grid = observed.select("series_id").distinct().join(F.broadcast(span))
    every = F.expr(f"INTERVAL {step} {unit}")
    steps = grid.select("series_id", F.posexplode(F.sequence("lo", "hi", every)).alias("t", "ds"))
    return steps.join(observed, ["series_id", "ds"], "left").select("series_id", "ds", F.col("t").cast("long").alias("t"), "y")


def hourly_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hour by event type: the sum of values; empty hours stay null."""
    hours = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ds"))
    return regularize(hours.agg(F.round(F.sum("value"), 6).alias("y")), "HOUR")


def filled_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_events(spark, sf_dir).withColumn("y", F.coalesce("y", F.lit(0.0)))


def gappy_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hourly panel with holes of known place: every seventh step, and runs of four steps at each fiftieth."""
    return filled_hourly(spark, sf_dir).withColumn("y", F.when((F.col("t") % 7 == 0) | (F.col("t") % 50 < 4), None).otherwise(F.col("y")))


def daily_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day by order priority: the sum of prices, 0 where there is none."""
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("series_id"), F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ds"))
    return regularize(days.agg(F.round(F.sum("o_totalprice"), 6).alias("y")), "DAY").withColumn("y", F.coalesce("y", F.lit(0.0)))


def weekly_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week by part: the quantity shipped, mostly 0."""
    weeks = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("series_id"), F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ds"))
    return regularize(weeks.agg(F.round(F.sum("l_quantity"), 6).alias("y")), "WEEK").withColumn("y", F.coalesce("y", F.lit(0.0)))


def weekly_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Week by region, nation and market segment: ``region, nation, segment, ds, y``, observed cells only."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.date_trunc("week", "l_shipdate").cast("timestamp_ntz").alias("ds"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    regions = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    joined = joined.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    cells = joined.groupBy(F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"), "ds")
    return cells.agg(F.round(F.sum("revenue"), 4).alias("y"))
