"""Collection and state that follows from run to run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import urls
from ..storage import spread
from .feed import last_pointer, publish, read_published, snapshot_hash  # noqa: F401


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """All sources in one frame, each row tagged with its entry."""
    out = None
    for entry, df in frames.items():
        df = df.withColumn("source_entry_id", F.lit(entry))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    if out is None:
        raise ValueError("no source given")
    return out


def seen_state(sights: DataFrame, previous: DataFrame | None = None, *, keys: Sequence[str] = ("source", "id"), at: str = "seen_at") -> DataFrame:
    """First and last sight of each key, over new sights and the state before."""
    new = sights.groupBy(*keys).agg(F.min(at).alias("first_seen_at"), F.max(at).alias("last_seen_at"))
    if previous is not None:
        new = new.unionByName(previous.select(*keys, "first_seen_at", "last_seen_at")).groupBy(*keys).agg(F.min("first_seen_at").alias("first_seen_at"), F.max("last_seen_at").alias("last_seen_at"))
    return new.withColumn("first_seen_at", F.least("first_seen_at", "last_seen_at"))


def merge_query_results(hits: DataFrame, runs: DataFrame, previous: DataFrame | None = None, *, key: str = "id", label: str = "query_label", order: str = "query_ord") -> DataFrame:
    """One row for each listing that any query found: the last query's fields and all queries' labels.

    runs: (query_label, ok). Previous rows that a failed query had found and no query finds now stay. If all queries failed the
    run has no result: previous rows stay as they are.
    """
    good = hits.join(runs.where("ok").select(label), label, "left_semi")
    fields = [c for c in hits.columns if c not in (key, label, order)]
    found = good.groupBy(key).agg(F.max_by(F.struct(*fields), order).alias("_f"), F.array_sort(F.collect_set(label)).alias("search_keywords")).select(key, "_f.*", "search_keywords")
    if previous is None:
        return found
    failed = runs.where("NOT ok").select(F.col(label).alias("_l")).distinct()
    owned = previous.select(key, F.explode("search_keywords").alias("_l")).join(failed, "_l").select(key).distinct()
    return found.unionByName(previous.join(owned, key, "left_semi").join(found.select(key), key, "left_anti"), allowMissingColumns=True)


def merge_pages(rows: DataFrame, keys: Sequence[str], *, page: str = "page_no", position: str = "pos", keep: str = "last", stop_when_stale: bool = False) -> DataFrame:
    """Pages of one query in one list: of rows with a key the first or last stays; optionally pages from the first that adds nothing go."""
    if stop_when_stale:
        first = rows.groupBy(*keys).agg(F.min(page).alias(page))
        fresh = first.select(page).distinct()
        dry = rows.select(page).distinct().join(fresh, page, "left_anti").agg(F.min(page).alias("_end"))
        rows = rows.join(F.broadcast(dry), F.col("_end").isNull() | (F.col(page) < F.col("_end"))).drop("_end")  # one row
    order = F.struct(page, position)
    pick = F.max_by if keep == "last" else F.min_by
    return rows.groupBy(*keys).agg(pick(F.struct(*[c for c in rows.columns if c not in keys]), order).alias("_r")).select(*keys, "_r.*")


def require_complete_batch(rows: DataFrame, pages: DataFrame, *, batch: str = "batch_id", max_rows: int = 450) -> tuple[DataFrame, DataFrame]:
    """Rows of batches whose pages are all there and not empty, and the rows of the others.

    pages: (batch_id, page_no, n_pages, n_rows); without n_pages the last page that came is the last. A batch over max_rows is refused.
    Pages and rows are dealt by batch into parts of bounded size.
    """
    need = F.max("n_pages" if "n_pages" in pages.columns else "page_no")
    rows, pages = spread(rows, batch, rows=rows.count()), spread(pages, batch, rows=pages.count())
    whole = pages.groupBy(batch).agg(F.count_distinct("page_no").alias("have"), need.alias("need"), F.min("n_rows").alias("least"), F.sum("n_rows").alias("rows")).where((F.col("have") == F.col("need")) & (F.col("least") > 0) & (F.col("rows") <= max_rows)).select(batch)
    return rows.join(whole, batch, "left_semi"), rows.join(whole, batch, "left_anti")


def import_feed(rows: DataFrame, existing: DataFrame, *, now: Column, host: str, cap: int = 450, position: str = "pos") -> tuple[DataFrame, DataFrame]:
    """A feed replaces the rows imported before; returns them and (received, inserted, updated, rejected).

    A row counts if its id is numeric, its url https under the host with the id in its path, its title not blank; of
    one id the first counts; rows after the first ``cap`` valid ones are rejected, which is the import's limit.
    """
    url = F.col("url")
    ok = F.coalesce(F.col("id").rlike(r"^[0-9]+$") & (F.lower(urls.part(url, "PROTOCOL")) == "https") & urls.host_matches(url, host) & (F.regexp_extract(urls.part(url, "PATH"), r"(\d+)/?$", 1) == F.col("id")) & (F.trim("title") != ""), F.lit(False))
    valid = rows.where(ok)
    firsts = valid.withColumn("_r", F.row_number().over(Window.partitionBy("id").orderBy(position))).where("_r = 1").drop("_r")
    kept = firsts.orderBy(position).limit(cap)
    before = existing.select("id", F.col("first_seen_at").alias("_first"))
    out = kept.join(before, "id", "left").withColumn("_new", F.col("_first").isNull()).withColumn("first_seen_at", F.coalesce("_first", now)).withColumn("last_seen_at", now)
    received = rows.agg(F.count("*").alias("received"))
    stats = out.agg(F.count_if("_new").alias("inserted"), F.count_if(~F.col("_new")).alias("updated")).crossJoin(received)  # one row each
    return out.drop("_first", "_new"), stats.select("received", "inserted", "updated", (F.col("received") - F.col("inserted") - F.col("updated")).alias("rejected"))


def due_details(postings: DataFrame, cache: DataFrame, *, now: Column, key: str = "url_key", ttl_hours: float = 6, retry_minutes: float = 30) -> DataFrame:
    """Postings whose detail is missing or older than the TTL, and wasn't tried within the retry time."""
    c = cache.select(F.col(key), "checked_at", "attempted_at")
    j = postings.join(c, key, "left")
    old = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("checked_at") > ttl_hours * 3600, F.lit(True))
    rested = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp("attempted_at") > retry_minutes * 60, F.lit(True))
    return j.where(old & rested)


def upsert_details(cache: DataFrame, fetched: DataFrame, *, key: str = "url_key") -> DataFrame:
    """The newest attempt of each key, with the detail of the newest verified one: a failure doesn't lose it."""
    both = cache.unionByName(fetched, allowMissingColumns=True)
    good = F.when(F.col("verified"), F.col("attempted_at"))
    rest = [c for c in both.columns if c not in (key, "attempted_at", "verified", "checked_at")]
    return both.groupBy(key).agg(F.max("attempted_at").alias("attempted_at"), F.max(F.when(F.col("verified"), F.col("checked_at"))).alias("checked_at"), F.coalesce(F.bool_or("verified"), F.lit(False)).alias("verified"), F.max_by(F.struct(*rest), F.struct(good.isNotNull(), F.coalesce(good, F.col("attempted_at")))).alias("_d")).select(key, "attempted_at", "checked_at", "verified", "_d.*")


def append_feedback(feedback: DataFrame, path: str) -> None:
    """One row for each submission, by day; texts trimmed, blank ones left out."""
    rows = feedback.withColumn("message", F.trim("message")).where("message <> ''").withColumn("created_date", F.to_date("created_at"))
    rows.write.mode("append").partitionBy("created_date").parquet(path)


def list_feedback(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """The newest n (1 to 500) submissions."""
    return spark.read.parquet(path).orderBy(F.desc("created_at"), "id").limit(min(500, max(1, n)))


def export_state(df: DataFrame, *, version: int = 1) -> DataFrame:
    """Each row as JSON with its version."""
    return df.select(F.to_json(F.struct(F.lit(version).alias("version"), F.struct("*").alias("state"))).alias("json"))


def import_state(lines: DataFrame, schema: str, *, version: int = 1) -> tuple[DataFrame, DataFrame]:
    """The rows of valid lines, and the lines that are no JSON or of another version."""
    parsed = lines.withColumn("p", F.from_json("json", f"version int, state struct<{schema}>"))
    ok = F.coalesce((F.col("p.version") == version) & F.col("p.state").isNotNull(), F.lit(False))
    return parsed.where(ok).select("p.state.*"), parsed.where(~ok).select("json")
