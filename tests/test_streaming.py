"""Streams against their batch twins."""

from pyspark.sql import functions as F

from foresift.sources import connectors
from foresift.streaming import quality


def test_rolling_quality(spark, tmp_path):
    rows = spark.range(200).select(F.lit("m").alias("model"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("ds"), (F.col("id") % 7).cast("double").alias("y_true"), F.lit(3.0).alias("y_pred"), F.lit(1.0).alias("lo"), F.lit(5.0).alias("hi"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = quality.rolling_quality(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("quality").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    run.awaitTermination(60)
    found = {r["start"]: (r["n"], round(r["mae"], 9), round(r["coverage"], 9)) for r in spark.table("quality").collect()}
    batch = rows.groupBy(F.window("ds", "1 day", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("y_true") - 3)).alias("e"), F.avg(F.col("y_true").between(1, 5).cast("double")).alias("c"))
    want = {r["w"]["start"]: (r["n"], round(r["e"], 9), round(r["c"], 9)) for r in batch.collect()}
    assert len(found) > 20 and all(want[k] == v for k, v in found.items())


def test_json_records(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1.5), ("b", None)], "series_id string, y double")
    assert sorted(map(tuple, connectors.parse_json(connectors.to_json(rows), "series_id string, y double").collect())) == [("a", 1.5), ("b", None)]


def test_append_adds_and_filters_push_down(spark, tmp_path):
    path = str(tmp_path / "table")
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v long")
    connectors.sink(rows, "parquet", path, "overwrite", ("k",))
    connectors.sink(rows, "parquet", path, "append", ("k",))
    found = connectors.source(spark, "parquet", path, {"k": "a"})
    assert found.count() == 2 and "PartitionFilters: [isnotnull(k" in found._jdf.queryExecution().executedPlan().toString()
