"""Tables that cut lineage: written once to the shared folder, then read by the stages that follow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_MADE: list[str] = []


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only where that setting is absent and all runs on this machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-postloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    path = f"{work_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder that nothing reads any more."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
        if path in _MADE:
            _MADE.remove(path)


def stored_alone(spark: SparkSession, make: Callable[[], DataFrame], label: str) -> tuple[DataFrame, str]:
    """The table that make returns, stored, and its path; the tables that make itself stored are deleted then."""
    first = len(_MADE)
    df = make()
    inner = _MADE[first:]
    out = stored(df, label)
    path = _MADE[-1]
    drop(spark, inner)
    return out, path


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Let Python functions of this session get at most so many rows at once: texts can be long, and 10,000 of them large.

    Spark reads the setting when a plan is run, so it stays set; a smaller one of the user's stays as it is.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(name, str(rows))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and return a scan of the files, so a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int, at_once: int = 1_000_000) -> DataFrame:
    """df of so many rows dealt by its keys into parts of about ``at_once`` rows, never fewer than Spark's own number.

    So the memory of a task that sorts or groups a part doesn't grow with the table.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // at_once)), *keys)
