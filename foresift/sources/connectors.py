"""Sources and sinks: Spark's own formats with equality filters, and JSON records through Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, fmt: str, path: str, where: dict | None = None, **options) -> DataFrame:
    """Read; the equalities of ``where`` are pushed to the source by Spark, and prune its partitions."""
    rows = spark.read.format(fmt).options(**options).load(path)
    for name, value in (where or {}).items():
        rows = rows.where(F.col(name).isNull() if value is None else F.col(name) == value)
    return rows


def sink(rows: DataFrame, fmt: str, path: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Write; append adds files, overwrite replaces the whole target."""
    rows.write.format(fmt).mode(mode).partitionBy(*partition_by).save(path)


def from_kafka(spark: SparkSession, servers: str, topic: str, schema: str, most: int = 1000) -> DataFrame:
    """A stream of JSON records, ``most`` a trigger; unreadable records give nulls."""
    stream = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest")
    return parse_json(stream.option("maxOffsetsPerTrigger", most).load(), schema)


def parse_json(records: DataFrame, schema: str) -> DataFrame:
    return records.select(F.from_json(F.col("value").cast("string"), schema).alias("r")).select("r.*")


def to_json(rows: DataFrame) -> DataFrame:
    """One JSON ``value`` a row, as a Kafka sink wants it."""
    return rows.select(F.to_json(F.struct("*")).alias("value"))
