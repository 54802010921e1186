"""The driver's tables read as listing tables, so that every operator runs on data that grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for now.
TODAY = "1996-06-15"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as raw postings: a customer's orders of one priority are one listing seen on five boards."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey"))
    return j.select(
        F.col("o_orderkey").cast("string").alias("id"), F.col("c_name").alias("company"), F.col("o_orderpriority").alias("title"),
        F.concat(F.lit("board"), F.pmod("o_orderkey", F.lit(5))).alias("source"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("deadline"),
        F.col("c_mktsegment").alias("category"), F.concat(F.lit("https://board.example/"), F.col("o_orderkey")).alias("url"),
        F.col("o_orderkey").alias("ord"), F.col("o_totalprice").alias("score"), F.col("o_orderdate").alias("last_seen_at"),
    )
