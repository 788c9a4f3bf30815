"""Helpers that every operator of this subpackage uses."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from furrow import storage

#: White space of the word contracts: a word is a run of anything else.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"


_written: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, and keep Arrow batches of long texts small.

    This sets the session's two limits of Arrow batches, for later queries of the caller too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))
    storage.ship(spark)


def released(batches: Iterator) -> Iterator:
    """Pass batches on; at the end give freed memory back, as a worker lives on for tasks of other stages."""
    yield from batches
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def documents(spark: SparkSession, sf_dir: str, table: str = "documents") -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_root(spark: SparkSession) -> str:
    return storage.checkpoint_root(spark)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/furrow/{uuid.uuid4().hex}-{name}"
    df.write.option("compression", "zstd").parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete the stage tables that this session has written, once no result that reads them is needed any more; returns how many."""
    mine = [p for s, p in _written if s is spark]
    for path in mine:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    _written[:] = [x for x in _written if x[0] is not spark]
    return len(mine)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, size: str, most: int = 1000) -> DataFrame:
    """Inner join of ``rows`` with one row of ``keyed`` for each key, where few keys may hold most rows.

    ``size`` is the column of ``keyed`` with the number of rows of the key. A key
    with more than 1/``most`` of all rows is hot; there are fewer than ``most`` of
    them whatever the input, so that side is broadcast. The other keys are small
    and are joined by a shuffle.
    """
    total = keyed.agg(F.sum(size)).first()[0] or 0
    is_hot = F.col(size) * most > F.lit(total)
    hot = keyed.where(is_hot).withColumn("_hot", F.lit(True))
    held = rows.join(F.broadcast(hot), key, "left")
    added = [c for c in keyed.columns if c != key]
    in_hot = held.where(F.col("_hot")).drop("_hot")
    in_cold = held.where(F.col("_hot").isNull()).drop("_hot", *added).join(keyed.where(~is_hot), key)
    return in_hot.unionByName(in_cold)
