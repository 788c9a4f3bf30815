"""Cutting lineage through the shared checkpoint folder, and sending the package to executors."""

from __future__ import annotations

import hashlib
import json
import os
import re
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the cluster names. One of our own only where none is set and driver and tasks are one process; elsewhere that is an error."""
    sc = spark.sparkContext
    root = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[[^,\]]*(,[^\]]*)?\])?$", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="furrow-")
        sc.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_root(df.sparkSession)
    return df.checkpoint()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, in whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def digest(*parts: object) -> str:
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:32]


class Stages:
    """Results of named stages in a folder, each under a digest of its name, settings and inputs: what is there is read, anything else is made and kept.

    An input is another stage's key, a table on files (its files' names, sizes and times count), or a value that tells its content. A changed setting or file makes
    new keys for its stage and for those that follow, and for no others. A stage counts as done once its ``_SUCCESS`` file is there, so one that was broken off is made again.
    """

    def __init__(self, folder: str) -> None:
        self.folder, self.made, self.keys = folder, [], {}

    def _told(self, spark: SparkSession, given: object) -> object:
        if not isinstance(given, DataFrame):
            return given
        if id(given) in self.keys:
            return self.keys[id(given)][1]
        files = sorted(given.inputFiles())
        if not files:
            raise ValueError("a stage's input must be a stage, a table on files or a value")
        conf, status = spark._jsc.hadoopConfiguration(), []
        for f in files:
            at = spark._jvm.org.apache.hadoop.fs.Path(f)
            s = at.getFileSystem(conf).getFileStatus(at)
            status.append((f, s.getLen(), s.getModificationTime()))
        return [given.schema.simpleString(), status]

    def stage(self, spark: SparkSession, name: str, inputs: list, settings: object, make: Callable[[], DataFrame]) -> DataFrame:
        """The stage's table; ``make`` is called only if it isn't there."""
        key = f"{name}-{digest(name, settings, [self._told(spark, x) for x in inputs])}"
        path = f"{self.folder}/{key}"
        if not exists(spark, f"{path}/_SUCCESS"):
            make().write.mode("overwrite").parquet(path)
            self.made.append(name)
        out = spark.read.parquet(path)
        self.keys[id(out)] = (out, key)  # held, so that no other table gets its id
        return out


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each context; they need no copy of their own."""
    sc = spark.sparkContext
    if getattr(sc, "_furrow_sent", False):
        return
    top = Path(__file__).resolve().parent
    handle, name = tempfile.mkstemp(prefix="furrow-", suffix=".zip")
    os.close(handle)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(name)
    sc._furrow_sent = True
