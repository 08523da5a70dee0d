"""Tables of runs: forecasts by run and model with resume, snapshots by configuration, alerts of streams."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from itertools import groupby
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession) -> str:
    """The shared folder of the session; on one machine without that setting, a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return Path(tempfile.mkdtemp(prefix="spark-")).as_uri()


def kept(rows: DataFrame) -> DataFrame:
    """The rows as a table in the session's folder: computed once however often it is used, and not lost with an executor. It stays until the folder is cleaned."""
    path = f"{folder(rows.sparkSession)}/table_{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def run_id(config: dict) -> str:
    """Twelve hex digits that equal configurations share, whatever the order of their keys."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:12]


def stored(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``; None where nothing has been written yet. Other failures are raised."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def _put(rows: DataFrame, path: str, *parts: str) -> None:
    """Replaces only the partitions that ``rows`` has."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def resume(spark: SparkSession, path: str, run: str, models: dict[str, Callable[[], DataFrame]], only: tuple[str, ...] = (), fresh: bool = False) -> tuple[DataFrame, list[str]]:
    """The run's forecasts, and the names of the models computed now.

    A model that the store has is not computed again, unless it is among ``only`` or ``fresh`` is set; a failure
    leaves the models written before it in the store.
    """
    have = stored(spark, path)
    done = set() if have is None else {r["model"] for r in have.where(F.col("run_id") == run).select("model").distinct().collect()}
    due = [m for m in models if m in only or fresh or m not in done]
    for name in due:
        _put(models[name]().withColumn("run_id", F.lit(run)).withColumn("model", F.lit(name)), path, "run_id", "model")
    return spark.read.parquet(path).where((F.col("run_id") == run) & F.col("model").isin(list(models))), due


def snapshot(metrics: DataFrame, path: str, config: dict) -> tuple[str, bool]:
    """Writes a run's metrics with its configuration under the run's id; a run that is there stays. Returns the id and whether it wrote."""
    spark, run = metrics.sparkSession, run_id(config)
    have = stored(spark, path)
    if have is not None and have.where(F.col("run_id") == run).take(1):
        return run, False
    _put(metrics.withColumns({"config": F.lit(json.dumps(config, sort_keys=True, default=str)), "run_id": F.lit(run)}), path, "run_id")
    return run, True


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """``run_id, config, n_rows`` of the runs with metrics."""
    have = stored(spark, path)
    if have is None:
        return spark.createDataFrame([], "run_id string, config string, n_rows long")
    return have.groupBy(F.col("run_id").cast("string").alias("run_id"), "config").agg(F.count("*").alias("n_rows"))


def alert_sink(alerts: DataFrame, path: str, checkpoint: str, deliver: Callable[[list[dict]], None] | None = None, most: int = 1000):
    """Starts a stream of alerts into a table, by batch; a batch that is written again after a failure replaces itself.

    ``deliver`` gets all alerts of a batch as dictionaries, up to ``most`` at a time, of which the driver holds no more.
    Where it fails, those alerts are still stored, with ``delivered`` false, and the others go on. A batch that runs again
    after a failure delivers again. Without ``deliver`` nothing counts as delivered.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("_chunk", F.floor(F.monotonically_increasing_id() / most))
        failed: list[int] = []
        if deliver is not None:
            rows = kept(rows)  # chunks are told apart once, whatever is read again
            for chunk, found in groupby(rows.sort("_chunk").toLocalIterator(), key=lambda r: r["_chunk"]):
                try:
                    deliver([{k: v for k, v in r.asDict(recursive=True).items() if k != "_chunk"} for r in found])
                except Exception:  # whatever the user's callback raises must not stop the stream
                    failed.append(chunk)
        lost = batch.sparkSession.createDataFrame([(c,) for c in failed], "_failed long")
        told = rows.join(lost, F.col("_chunk") == F.col("_failed"), "left").withColumn("delivered", F.col("_failed").isNull() & F.lit(deliver is not None))
        _put(told.drop("_chunk", "_failed").withColumn("batch", F.lit(number)), path, "batch")

    return alerts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
