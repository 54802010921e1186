"""Global positions and prefix sums over an order, without sorting everything in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ordered_parts(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """df dealt into ranges of the order and written, with the number of the range in ``part``.

    The table is written because the ranges come from a sample: every later pass must see the same ones.
    """
    return stored(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), label)


def prefix_sums(parts: DataFrame, value: Column, order: Sequence[Column], name: str, keys: Sequence[str] = ()) -> DataFrame:
    """Add ``name``: the sum of value over all rows before this one, by order, restarting with each key.

    parts comes from :func:`ordered_parts` with an order that starts with the keys, so each range is summed by
    itself and offset by the totals of the ranges before it; only those totals (a row for each range and key)
    meet in one window.
    """
    by = ["part", *keys]
    totals = parts.groupBy(*by).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*[F.col(c).alias(f"_{c}") for c in by], F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
    match = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    on = match[0]
    for m in match[1:]:
        on &= m
    return own.join(base, on).withColumn(name, F.col(name) + F.col("_base")).drop(*[f"_{c}" for c in by], "_base")
