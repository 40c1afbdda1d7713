"""What operators that run in rounds need of the session."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting that removes the shuffle files of an execution at its end.
CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _running = threading.Lock(), {"n": 0, "before": "false"}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which all executors share. A local session without it gets a temporary folder; a cluster must set it."""
    path = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


@contextmanager
def cleaned_up(spark: SparkSession) -> Iterator[None]:
    """What runs within removes its shuffle files at its end.

    The setting for that belongs to the session: it is on while any call runs and put back by the last, so calls from
    several threads agree.
    """
    with _lock:
        if not _running["n"]:
            _running["before"] = spark.conf.get(CLEAN_UP, "false")
            spark.conf.set(CLEAN_UP, "true")
        _running["n"] += 1
    try:
        yield
    finally:
        with _lock:
            _running["n"] -= 1
            if not _running["n"]:
                spark.conf.set(CLEAN_UP, _running["before"])


def keep(df: DataFrame) -> DataFrame:
    """The rows written to spark.checkpoint.dir, which all executors share, with the lineage cut.

    What the rows came from isn't needed again, so the shuffle files behind them are removed at once.
    """
    shared_dir(df.sparkSession)
    with cleaned_up(df.sparkSession):
        return df.checkpoint(eager=True)


def store(df: DataFrame) -> DataFrame:
    """As keep(), but as Parquet: for tables of many rows whose columns repeat, which take a small part of a checkpoint's disk.

    They take many times their files' size in memory, but Spark goes by these when it looks for tables to broadcast, so it
    is told to shuffle them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stored-{uuid.uuid4().hex}"
    with cleaned_up(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
