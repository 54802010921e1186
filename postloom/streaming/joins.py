"""Streams that meet: saved postings and their deadlines, new postings and what a user has seen."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import feed, userstate
from ..operators.select import discover


def saved_deadlines(saves: DataFrame, postings: DataFrame, *, wait: str = "7 days", late: str = "1 hour") -> DataFrame:
    """Saves (user_id, job_key, saved_at) with the deadlines that postings (job_key, deadline_at, seen_at) state within ``wait`` of the save.

    A stream-stream left outer join: both sides have a watermark, and a save and a sight can be at most ``wait`` apart
    either way, so the state of either side ends. A save that nothing matched comes out with nulls once the watermark says
    that nothing can. A posting seen several times gives a row for each sight; the alerts take the newest.
    """
    s = saves.withWatermark("saved_at", late)
    p = postings.select(F.col("job_key").alias("_job"), "deadline_at", "seen_at").withWatermark("seen_at", late)
    near = (F.col("seen_at") >= F.col("saved_at") - F.expr(f"INTERVAL {wait}")) & (F.col("seen_at") <= F.col("saved_at") + F.expr(f"INTERVAL {wait}"))
    return s.join(p, (F.col("job_key") == F.col("_job")) & near, "left_outer").drop("_job")


def alert_batches(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch over :func:`saved_deadlines` that keeps the notifications of all users under path.

    The newest sight of a posting decides its deadline; one schedule notification stays for each user and job, and the
    deadline alerts at 3, 1 and 0 days follow from it (:func:`alerts_of`). A batch that runs again changes nothing.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = feed.last_pointer(spark, path)
        if before is not None and before["version"] >= number + 1:
            return
        known = batch.where(F.col("deadline_at").isNotNull())
        newest = known.groupBy("user_id", "job_key").agg(F.max_by(F.struct("deadline_at", "saved_at"), F.struct("seen_at", "deadline_at")).alias("_d"), F.max("seen_at").alias("seen_at"))
        new = newest.select(
            F.concat_ws(":", F.lit("schedule"), "user_id", "job_key", F.col("_d.deadline_at").cast("string")).alias("id"), F.lit("schedule").alias("type"), "user_id", "job_key",
            F.col("_d.deadline_at").alias("deadline_at"), "seen_at", F.col("_d.saved_at").alias("created_at"), F.lit(None).cast("timestamp").alias("read_at"),
        )
        if before is not None:
            old = feed.read_version(spark, path, before).select(*new.columns)
            late = old.select("user_id", "job_key", F.col("seen_at").alias("_known"))  # a sight older than the one known doesn't count
            new = new.join(late, ["user_id", "job_key"], "left").where(F.col("_known").isNull() | (F.col("seen_at") >= F.col("_known"))).drop("_known")
        else:
            old = new.limit(0)
        feed.publish(userstate.upsert_notifications(old, new, at="seen_at"), path, version=number + 1, day="")

    return run


def alerts_of(notifications: DataFrame, *, today: Column, days: Sequence[int] = (3, 1, 0)) -> DataFrame:
    """The alerts of a day from schedule notifications: those of :func:`userstate.deadline_alerts` over the same saves and deadlines."""
    saved = notifications.where("type = 'schedule'").select("user_id", "job_key", "deadline_at")
    left = saved.withColumn("days", F.datediff("deadline_at", today)).where(F.col("days").isin(*days))
    return left.select(F.concat_ws(":", F.lit("deadline"), "user_id", "job_key", F.col("days").cast("string")).alias("id"), "user_id", "job_key", "days", "deadline_at")


def first_sights(postings: DataFrame, *, key: str = "ord", at: str = "first_seen_at", late: str = "1 hour") -> DataFrame:
    """Postings of a stream, each once: one that comes again within the watermark of its first sight is left out."""
    return postings.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def discovery_batches(
    path: str, seen: Callable[[], DataFrame], applied: Callable[[], DataFrame], *, since: Column | None = None, key: str = "ord", at: str = "first_seen_at"
) -> Callable[[DataFrame, int], None]:
    """A foreachBatch that writes the new postings of each batch to path/batch=N, by :func:`select.discover`.

    seen and applied give the tables as they stand when a batch runs. Each batch has a folder of its own that is written
    over if the batch runs again, so a restart neither loses nor repeats a posting.
    """

    def run(batch: DataFrame, number: int) -> None:
        rows, _ = discover(batch, "new", since, seen(), applied(), key=key, at=at)
        rows.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return run
