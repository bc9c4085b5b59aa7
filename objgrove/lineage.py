"""Reliable lineage cuts in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}

#: Rows that one task sorts or groups, so that its memory does not grow with their number.
TASK_ROWS = 1_000_000


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or, on one machine only, a local folder where it is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not base:
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="objgrove-core-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        base = "file://" + _own[app]
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(base)
    # a path without a scheme is on the default file system, which Python on executors has to be told
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return system.makeQualified(path).toString().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    shared_root(df.sparkSession)
    return df.checkpoint()


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df dealt by keys to tasks by its number of rows. Partitions of a given number are not merged by their compressed size."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)), *keys)
