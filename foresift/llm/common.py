"""Small pieces that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A word: a run of anything but the ASCII white space bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a temporary one only in local mode, for tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-ckpt-"))
    return sc.getCheckpointDir()


def persist(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder: smaller than a checkpoint for wide or many rows."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}.parquet"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the files of tables that ``stored`` wrote, once nothing will read them again."""
    for df in tables:
        spark = df.sparkSession
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files and checkpoints that nothing refers to any more: it does so as the driver collects garbage, which a driver of small objects seldom does."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Return to the system what a Python worker has freed: Spark keeps workers for the tasks of later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, list[str]]]:
    """A column's texts (null: empty) in runs of about ``size`` bytes, each with the row at which it starts."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 100)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(upto, size + (upto[at - 1] if at else 0), "right")))
        yield at, [t or "" for t in texts[at:end].to_pylist()]
        at = end


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function for mapInArrow that gives memory back at its end."""

    @functools.wraps(run)
    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; plain ``lower`` is the same for texts of ASCII only, and faster."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


#: Bits of a bitmap of wanted values at most: 16 MB. Values up to which it has 16 bits or more for each.
MOST_BITS = 1 << 27
REACH = MOST_BITS // 16


def likely(rows: DataFrame, col: str, wanted: DataFrame, count: int) -> DataFrame:
    """The rows whose ``col`` may be one of the ``count`` values in the only column of ``wanted``: all that are, and few others.

    A bitmap of the values' hashes, 64 to 128 bits a value, goes to every task, so that the other rows need no shuffle.
    Beyond some two million values its size stays, and ever more of the other rows pass: one in 16 for ``REACH`` values.
    """
    bits = min(MOST_BITS, 1 << (64 * count).bit_length())

    def at(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(bits))

    values = wanted.select(at(wanted[wanted.columns[0]]).alias("__at"))
    marks = values.select(F.bitmap_bucket_number("__at").alias("__part"), F.bitmap_bit_position("__at").alias("__bit")).repartition("__part").groupBy("__part").agg(F.bitmap_construct_agg("__bit").alias("__bits"))
    hashed = rows.withColumn("__at", at(rows[col])).withColumn("__part", F.bitmap_bucket_number("__at"))
    bit = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return hashed.join(F.broadcast(marks), "__part").where(F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1).select(*rows.columns)


def hash60(key: Column) -> Column:
    """60 uniform bits of a key's text (null: the empty text) as a non-negative long, the same in any SQL engine with md5."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


#: Summaries that one task combines at most, and levels of combining: enough for FAN_IN ** LEVELS partitions.
FAN_IN, LEVELS = 64, 4


def frequent(df: DataFrame, col: str, k: int, counters: int) -> DataFrame:
    """``item, count`` of the values of a column that a mergeable frequent-items summary names, ``k`` rows at most.

    The partitions' summaries are combined in a tree: each task takes ``FAN_IN`` of them, whatever the number of partitions.
    """
    many = df.withColumn("part", F.spark_partition_id())
    summed = many.groupBy(F.floor(F.col("part") / FAN_IN).alias("at")).agg(F.expr(f"approx_top_k_accumulate({col}, {counters})").alias("summary"))
    for _ in range(LEVELS - 1):  # the last level leaves one
        summed = summed.groupBy(F.floor(F.col("at") / FAN_IN).alias("at")).agg(F.expr(f"approx_top_k_combine(summary, {counters})").alias("summary"))
    return summed.select(F.inline(F.expr(f"approx_top_k_estimate(summary, {k})")))
