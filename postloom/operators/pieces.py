"""Pieces of strings, so that "holds" is an equi-join and not a comparison of all pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proper_pieces(df: DataFrame, c: str, least: Column, into: str = "piece") -> DataFrame:
    """df with a row for each place and length of a piece of column c that is shorter than c and has ``least`` letters or more.

    A string that is null or no longer than ``least`` has none. Pieces are made row by row: their number grows with the square of
    the length beyond ``least``, memory doesn't.
    """
    size = F.length(c)
    sized = df.withColumn("_n", F.explode(F.when(size > least, F.sequence(least, size - 1))))
    placed = sized.withColumn("_i", F.explode(F.sequence(F.lit(1), size - F.col("_n") + 1)))
    return placed.withColumn(into, F.substring(c, F.col("_i"), F.col("_n"))).drop("_n", "_i")
