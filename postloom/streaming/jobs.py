"""State that follows a stream of events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import feed
from .state import admission_stream  # noqa: F401


def read_events(spark: SparkSession, path: str, schema: str, *, files: int = 8) -> DataFrame:
    """Event files as a stream, some files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def windowed_counts(events: DataFrame, *, at: str = "ts", key: str = "event_type", late: str = "1 hour", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Events of each key in tumbling or sliding windows; rows later than the watermark are left out."""
    w = F.window(at, size, slide) if slide else F.window(at, size)
    return events.withWatermark(at, late).groupBy(w, key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), key, "n")


def session_counts(events: DataFrame, *, at: str = "ts", key: str = "user_id", late: str = "1 hour", gap: str = "30 minutes") -> DataFrame:
    """Sessions of each key."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), key, "n")


def first_views(events: DataFrame, *, keys: list[str], at: str = "ts", late: str = "1 hour") -> DataFrame:
    """T5: the first event of each key within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def upsert_batches(fold: Callable[[DataFrame, DataFrame | None], DataFrame], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that folds each batch into the state under path; the version of a batch is written once and then pointed to.

    A batch that is run again finds its version written and folds from the one before, so nothing counts twice.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = feed.last_pointer(spark, path)
        if before is not None and before["version"] >= number + 1:
            return
        old = feed.read_version(spark, path, before) if before is not None else None
        feed.publish(fold(batch, old), path, version=number + 1, day="")

    return run


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """One refresh: everything that has arrived since the last, then stop; one run at a time holds the checkpoint."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
