"""Session helpers shared by all operators."""

from __future__ import annotations

import hashlib
import os
import pickle
import re
import tempfile
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir, or the one the session has set.

    A temporary one is made only in local mode (tests); on a cluster, where each machine would get its own, it is an error.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        current = spark.sparkContext.getCheckpointDir()
        if not current and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        there = current.rpartition("/")[0] if current else tempfile.mkdtemp(prefix="sievelight-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(there)
    return there


def _path(spark: SparkSession, path: str):
    """A path and its file system in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes the rows as parquet to the shared folder and reads them back; columns stay prunable, lost executors cost nothing.

    The table is deleted when the driver ends, or by `forget`.
    """
    spark = df.sparkSession
    path = os.path.join(checkpoint_dir(spark), f"{tag}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    where, fs = _path(spark, path)
    fs.deleteOnExit(where)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


_written: dict[str, list[str]] = {}


def forget(spark: SparkSession) -> int:
    """Deletes the tables that `materialize` has written in this application; their number. No query that reads them may still run."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where, fs = _path(spark, path)
        fs.delete(where, True)
    return len(paths)


def stored(spark: SparkSession, key: str, make: Callable[[], T]) -> T:
    """What `make` gives, kept in the shared folder under a key that tells all it depends on; made once, then read."""
    path = os.path.join(checkpoint_dir(spark), key)
    if table_exists(spark, path):
        return pickle.loads(spark.read.schema("content binary").parquet(path).first().content)
    value = make()
    spark.createDataFrame([(bytearray(pickle.dumps(value)),)], "content binary").coalesce(1).write.mode("overwrite").parquet(path)
    return value


def table_exists(spark: SparkSession, path: str) -> bool:
    """Whether a table has been written there to its end."""
    done, fs = _path(spark, os.path.join(path, "_SUCCESS"))
    return fs.exists(done)


def fingerprint(df: DataFrame) -> str:
    """A key of the files behind a table: their names, sizes and times of change."""
    spark, marks = df.sparkSession, []
    for name in sorted(df.inputFiles()):
        where, fs = _path(spark, name)
        status = fs.getFileStatus(where)
        marks.append(f"{name} {status.getLen()} {status.getModificationTime()}")
    return hashlib.sha256("\n".join(marks).encode()).hexdigest()[:24]


def tiling(spark: SparkSession, left: int, right: int, most_left: int, most_right: int) -> tuple[int, int]:
    """Numbers of blocks of two sides that meet in tiles: as many as their sizes ask for, and of the left side so many that all cores have one."""
    rows, columns = max(1, -(-left // most_left)), max(1, -(-right // most_right))
    while rows * columns < 2 * spark.sparkContext.defaultParallelism and left >= 128 * rows:
        rows *= 2
    return rows, columns


def exists(df: DataFrame) -> bool:
    return bool(df.limit(1).count())
