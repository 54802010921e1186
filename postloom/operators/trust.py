"""How far a snapshot can be trusted: state of each source, posting and the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import spread


def source_status(runs: DataFrame, postings: DataFrame, *, now: Column, stale_hours: float = 24, external_hours: float = 24) -> DataFrame:
    """A3: a row for each source of runs (source_id, name, status, last_attempt_at, last_success_at, fresh, external, error).

    freshness is fresh, cached, fallback, stale or unavailable, data_origin live, cache, imported-cache, fallback-cache or none.
    Rows kept of a source whose run failed or found nothing are a fallback.
    """
    counts = postings.groupBy("source_entry_id").agg(F.count("*").alias("count"))
    s = runs.join(counts, runs["source_id"] == counts["source_entry_id"], "left").drop("source_entry_id").withColumn("count", F.coalesce("count", F.lit(0)))
    has, failed = F.col("count") > 0, F.col("status").isin("error", "needs_review")
    limit = F.when(F.col("external"), F.lit(max(stale_hours, external_hours))).otherwise(F.lit(stale_hours))
    old = F.coalesce((F.unix_timestamp(now) - F.unix_timestamp("last_success_at")) > limit * 3600, F.lit(False))
    fallback = has & failed
    origin = F.when(fallback, "fallback-cache").when(F.col("external"), "imported-cache").when(F.col("fresh") & F.col("status").isin("success", "empty"), "live").when(has | F.col("last_success_at").isNotNull(), "cache").otherwise("none")
    shown = F.when(F.col("status") == "success", "auto").when((F.col("status") == "error") & has, "stale").when(F.col("status") == "idle", "pending").otherwise(F.col("status"))
    s = s.withColumns({"is_fallback": fallback, "stale": old | failed | (has & F.col("last_success_at").isNull()), "data_origin": origin, "collection_status": F.col("status"), "status": shown})
    fresh = F.when(F.col("is_fallback"), "fallback").when(F.col("stale"), "stale").when(F.col("data_origin") == "live", "fresh").when(F.col("data_origin").isin("cache", "imported-cache"), "cached").otherwise("unavailable")
    return s.withColumn("freshness", fresh).withColumn("from_cache", (F.col("count") > 0) & (F.col("data_origin") != "live")).drop("fresh")


def posting_trust(links: DataFrame, status: DataFrame, *, key: str = "entity", entry: str = "source_entry_id", salts: int = 8) -> DataFrame:
    """A row for each posting: its trust state from the states of its sources, and when it was last collected.

    Links meet their sources, and then their postings, in parts of bounded size; each source stands in ``salts`` copies, so the
    links of a large one are dealt over as many parts. Repeated links say nothing new, so they stay.
    """
    n = links.count()
    s = status.select(F.col("source_id").alias(entry), "freshness", "is_fallback", "stale", "from_cache", "last_success_at").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    dealt = spread(links.select(key, entry, F.pmod(F.xxhash64(key), F.lit(salts)).cast("int").alias("_salt")), entry, "_salt", rows=n)
    met = spread(dealt.join(s, [entry, "_salt"], "left").drop("_salt", entry), key, rows=n)
    known = met.groupBy(key).agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for c, n in ((F.col("freshness") == "fresh", "has_fresh"), (F.col("is_fallback"), "has_fallback"), (F.col("stale"), "has_stale"), (F.col("from_cache"), "served_from_cache"))], F.max("last_success_at").alias("last_collected_at"))
    rest = F.col("has_fallback") | F.col("has_stale") | F.col("served_from_cache")
    state = F.when(F.col("has_fresh"), F.when(rest, "mixed").otherwise("fresh")).when(F.col("has_fallback"), "fallback").when(F.col("has_stale"), "stale").when(F.col("served_from_cache"), "cached").otherwise("unknown")
    return known.withColumn("trust_state", state).withColumn("stale", ~F.col("has_fresh") & F.col("has_stale"))


def snapshot_rollup(status: DataFrame, postings: DataFrame, *, raw_count: Column, in_progress: bool = False, write_failed: bool = False) -> DataFrame:
    """One row: sources by state, rows raw, merged, visible and for review, category counts, trust state, why it's empty."""
    n = lambda c, name: F.count_if(c).alias(name)
    src = status.agg(
        F.count("*").alias("sources"), n(F.col("freshness") == "fresh", "fresh"), n(F.col("data_origin").isin("cache", "imported-cache"), "cached"), n(F.col("is_fallback"), "fallback"), n(F.col("stale"), "stale"), n(F.col("collection_status") == "error", "failed"), n(F.col("data_origin") == "none", "unavailable"),
        n((F.col("data_origin") != "none") & ~F.col("stale") & ~F.col("is_fallback"), "current"), n(F.col("from_cache"), "cached_rows"), F.max("last_success_at").alias("last_success_at"), F.max("last_attempt_at").alias("last_attempt_at"),
    )
    rows = postings.agg(F.count("*").alias("merged"), n(~F.col("needs_review"), "visible"), n(F.col("needs_review"), "review"), n(~F.col("needs_review") & (F.col("category") == "health"), "health"), n(~F.col("needs_review") & (F.col("category") == "clinical"), "clinical"))
    one = src.crossJoin(rows).withColumn("raw", raw_count).withColumn("duplicates_removed", F.greatest(F.lit(0), F.col("raw") - F.col("merged")))  # one row each
    empty = F.when(F.col("failed") > 0, "unavailable").otherwise("collecting" if in_progress else "empty")
    full = (
        F.when((F.col("fallback") > 0) | (F.col("failed") > 0) | F.lit(write_failed), "partial")
        .when((F.col("stale") > 0) & (F.col("current") == 0), "stale")
        .when((F.col("stale") > 0) | ((F.col("fresh") > 0) & (F.col("cached_rows") > 0)), "mixed")
        .when(F.col("fresh") > 0, "fresh")
        .when(F.col("cached_rows") > 0, "cached")
        .otherwise("unknown")
    )
    why = F.when(F.col("merged") == 0, F.lit("collecting") if in_progress else F.when(F.col("last_success_at").isNotNull(), "no_results").otherwise("no_cache"))
    return one.withColumn("trust_state", F.when(F.col("merged") == 0, empty).otherwise(full)).withColumn("empty_reason", why)


def carry_over(new: DataFrame, previous: DataFrame, runs: DataFrame) -> DataFrame:
    """The rows of sources that succeeded, and the previous rows of those that failed or found nothing.

    runs: (source_id, status). A source without new rows keeps its previous ones.
    """
    failed = runs.where(F.col("status") == "error").select("source_id")
    got = new.join(failed, "source_id", "left_anti")
    has = got.select("source_id").distinct()
    return got.unionByName(previous.join(has, "source_id", "left_anti"), allowMissingColumns=True)


def run_outcome(runs: DataFrame, new: DataFrame, previous: DataFrame) -> DataFrame:
    """The status of each run after the guard: an empty result over previous rows needs a review."""
    n = lambda df, name: df.groupBy("source_id").agg(F.count("*").alias(name))
    j = runs.join(n(new, "n_new"), "source_id", "left").join(n(previous, "n_old"), "source_id", "left").fillna(0, ["n_new", "n_old"])
    return j.withColumn("status", F.when(F.col("status") == "error", "error").when((F.col("n_new") == 0) & (F.col("n_old") > 0), "needs_review").when(F.col("n_new") == 0, "empty").otherwise("success"))


def refresh_complete(started: Column, completed: Column, requested: Column, in_progress: Column) -> Column:
    """The published run began and ended after the request and none is under way."""
    return F.coalesce((started >= requested) & (completed >= requested) & ~in_progress, F.lit(False))
