"""Values that follow from the day, and a calendar of when each row's next ones change."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates

#: Days after the deadline, and after publication, from which a derived value differs.
_DEADLINE_STEPS = {"status": (-3, 0, 1), "label": (-7, 0, 1)}
_AGE_STEPS = {"freshness": (4, 15), "penalty": (8, 15, 29), "listed": (31,)}
DERIVED = ("deadline_status", "deadline_label", "freshness", "age_penalty", "listed", "next_change")


def next_change(deadline: Column, base: Column, today: Column) -> Column:
    """The first day after today on which a value derived from the deadline or the age differs; null if none does."""
    steps = [F.date_add(deadline, n) for n in sorted({n for v in _DEADLINE_STEPS.values() for n in v})]
    steps += [F.date_add(base, n) for n in sorted({n for v in _AGE_STEPS.values() for n in v})]
    return F.array_min(F.filter(F.array(*steps), lambda d: d > today))


def derive(postings: DataFrame, today: Column) -> DataFrame:
    """The columns of ``DERIVED`` as they are today.

    postings have deadline_at, deadline_kind, deadline (its text), published_at and first_seen_at. Days remaining and days of age are
    differences of dates that any reader takes when it reads; what is kept are the values that change in steps.
    """
    base = F.coalesce(F.col("published_at"), F.to_date("first_seen_at"))
    age = dates.listing_age(F.col("published_at"), F.to_date("first_seen_at"), today)
    return postings.withColumns({
        "deadline_status": dates.deadline_state(F.col("deadline_at"), F.coalesce("deadline_kind", F.lit("")), today)["status"],
        "deadline_label": dates.deadline_label(F.col("deadline_at"), F.coalesce("deadline", F.lit("")), today),
        "freshness": dates.freshness(age), "age_penalty": dates.age_penalty(age), "listed": F.coalesce(age <= 30, F.lit(True)),
        "next_change": next_change(F.col("deadline_at"), base, today),
    })


def start(postings: DataFrame, path: str, day: dt.date) -> None:
    """Write all rows as they are on a day: the first folder of the table at path."""
    _written(derive(postings, F.lit(day)), f"{path}/rolled={day.isoformat()}")


def _written(rows: DataFrame, target: str) -> None:
    """Write rows into folders of the month of their next change, few files each; a large month is split."""
    by_month = rows.withColumn("due_month", F.date_format("next_change", "yyyy-MM")).hint("rebalance", "due_month")
    by_month.sortWithinPartitions("next_change").write.mode("overwrite").partitionBy("due_month").parquet(target)


def _month(day: dt.date) -> Column:
    return F.lit(f"{day:%Y-%m}")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.parquet(path)
    return df.withColumns({"rolled": F.to_date("rolled"), "due_month": F.col("due_month").cast("string")})


def read_day(spark: SparkSession, path: str, day: dt.date) -> DataFrame:
    """The table as of a day up to which it was rolled: of each row the version whose next change is still ahead."""
    today = F.lit(day)
    ahead = F.col("next_change").isNull() | ((F.col("next_change") > today) & (F.col("due_month") >= _month(day)))
    return _rows(spark, path).where((F.col("rolled") <= today) & ahead).drop("due_month")


def roll(spark: SparkSession, path: str, day: dt.date) -> int:
    """Bring the table at path to a day; how many rows were worked out again.

    Only folders of the months that have come since the last roll are read, whole partitions of the calendar: rows due then
    are derived anew into a folder of the day, and what they supersede stays where it is, past its next change and so
    never read again. The day's folder is written over if the roll runs again, so a lost job does no harm.
    """
    rows = _rows(spark, path)
    last = rows.select(F.max(F.when(F.col("rolled") < F.lit(day), F.col("rolled")))).first()[0]
    if last is None:
        return 0
    due = rows.where((F.col("rolled") <= F.lit(last)) & (F.col("next_change") > F.lit(last)) & (F.col("next_change") <= F.lit(day)))
    due = due.where(F.col("due_month").between(_month(last), _month(day)))
    again = derive(due.drop(*DERIVED, "rolled", "due_month"), F.lit(day))
    target = f"{path}/rolled={day.isoformat()}"
    _written(again, target)
    return spark.read.schema(again.schema).parquet(target).count()
