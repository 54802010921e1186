"""Employer ratings joined to companies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import pieces


def rating_aggregate(links: DataFrame, *, per_query: int = 12) -> DataFrame:
    """One row for each query, source and company: best url by priority, last name, last rating and count; complete ones, 12 a query at most.

    links: (query_id, source, company_key, pos, url, priority, name, rating, review_count).
    """
    last = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("pos", F.col(c).alias("v"))))["v"].alias(c)
    g = links.groupBy("query_id", "source", "company_key").agg(F.max_by("url", F.struct("priority", -F.col("pos"))).alias("url"), last("name"), last("rating"), last("review_count"), F.min("pos").alias("pos"))
    g = g.withColumns({"rating": text.bounded(F.round("rating", 1), 0, 5, "decimal(2,1)"), "review_count": text.bounded(F.col("review_count"), 0, 10_000_000, "int")}).where("name IS NOT NULL AND rating IS NOT NULL AND review_count IS NOT NULL")
    return g.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "source").orderBy("pos"))).where(F.col("_r") <= per_query).drop("_r", "pos")


def company_lookup(companies: DataFrame, ratings: DataFrame, *, ratio: float = 0.5) -> DataFrame:
    """Each company with its rating by equal key, else the candidate whose key holds or is held by it with the best length ratio.

    companies: (company_id, key), ratings: (rating_id, key). Ratings of one key count as the first of them, and of equally good
    candidates the first stands. Empty and null keys match nothing. The longer key's pieces are joined to the shorter
    key, the ratings' pieces summed up to their best one before, so keys that begin alike or repeat meet nothing in vain.
    """
    size, least = F.length("key"), F.greatest(F.lit(1), F.floor(F.length("key") * ratio)).cast("int")
    rated = ratings.where("key <> ''").groupBy("key").agg(F.min("rating_id").alias("rating_id"))
    wanted = companies.where("key <> ''").select("key").distinct()
    exact = wanted.join(rated, "key").select("key", "rating_id", F.lit("ok").alias("status"), F.lit(1.0).alias("ratio"))
    rest = wanted.join(rated, "key", "left_anti")
    inside = pieces.proper_pieces(rest, "key", least).withColumn("ratio", F.length("piece") / size)
    holding = inside.join(rated.withColumnRenamed("key", "piece"), "piece").select("key", "rating_id", "ratio")
    longest = pieces.proper_pieces(rated, "key", least).withColumn("ratio", F.length("piece") / size)
    best_of = lambda df, by: df.where(F.col("ratio") >= ratio).groupBy(by).agg(F.min(F.struct((-F.col("ratio")).alias("q"), "rating_id")).alias("b")).select(by, "b.rating_id", (-F.col("b.q")).alias("ratio"))
    held = rest.join(best_of(longest, "piece").withColumnRenamed("piece", "key"), "key").select("key", "rating_id", "ratio")
    found = best_of(holding.unionByName(held), "key").select("key", "rating_id", F.lit("candidate").alias("status"), "ratio")
    return companies.join(exact.unionByName(found), "key").select("company_id", "rating_id", "status", "ratio")


def select_candidates(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates that a user chose (company_id, rating_id) become ratings."""
    picks = chosen.select("company_id", "rating_id", F.lit(True).alias("_c"))
    return found.join(picks, ["company_id", "rating_id"], "left").withColumn("status", F.when(F.col("_c"), "ok").otherwise(F.col("status"))).drop("_c")
