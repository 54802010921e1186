"""Per-user state folded from event tables: saved, viewed, applied, notified."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .applications import application_state  # noqa: F401
from .components import connected_components
from .select import cap_per_key, identities

# The steps of an application.
NEXT_STATUS = {"interested": "preparing", "preparing": "applied", "applied": "interview", "interview": "final"}


def fold_events(events: DataFrame, key_cols: Sequence[str], op_col: str, ts_col: str, *, seq_col: str | None = None) -> DataFrame:
    """The last operation of each key, and the number of operations so far as its revision. Only partial sums are shuffled."""
    order = F.struct(ts_col, *([seq_col] if seq_col else []))
    rest = [c for c in events.columns if c not in (*key_cols, op_col, ts_col)]
    return events.groupBy(*key_cols).agg(F.max_by(F.struct(op_col, ts_col, *rest), order).alias("_l"), F.count("*").alias("revision")).select(*key_cols, "_l.*", "revision")


def saved_set(mutations: DataFrame) -> DataFrame:
    """(owner, job_key, seq) of what is saved after all mutations (owner, seq, action save or remove, job_key)."""
    last = mutations.groupBy("owner", "job_key").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"))
    return last.where("action = 'save'").drop("action")


def mark_viewed(views: DataFrame, *, newest: int = 200) -> DataFrame:
    """The latest view of each user and job, the newest 200 of each user."""
    last = views.groupBy("user_id", "job_id").agg(F.max("viewed_at").alias("viewed_at"))
    return cap_per_key(last, ["user_id"], "viewed_at", newest, tie="job_id")


def advance_checkpoint(pages: DataFrame, *, now: Column) -> DataFrame:
    """T4: the high-water mark of each user: the latest of min(last success, now) over usable pages; it never goes back."""
    usable = ~F.coalesce(F.col("error"), F.lit(False)) & ~F.coalesce(F.col("in_progress"), F.lit(False))
    return pages.groupBy("user_id").agg(F.max(F.when(usable, F.least("last_success_at", now))).alias("checked_at"))


def valid_times(df: DataFrame, at: str, *, now: Column, ttl_days: float = 7, skew_minutes: float = 5) -> DataFrame:
    """Rows whose time is neither too old nor in the future."""
    age = F.unix_timestamp(now) - F.unix_timestamp(at)
    return df.where(age.between(-skew_minutes * 60, ttl_days * 86400))


def resolve_alias(keys: DataFrame, snapshots: DataFrame, *, key: str = "job_key") -> DataFrame:
    """Each key of keys (user_id, job_key) with all names of the saved snapshots that have it (one hop)."""
    names = snapshots.select("user_id", "ord", F.explode(identities(snapshots)).alias("alias"))
    hit = keys.select("user_id", F.col(key).alias("alias"), F.col(key).alias("given")).join(names, ["user_id", "alias"]).select("user_id", "given", "ord")
    other = hit.join(names, ["user_id", "ord"]).select("user_id", F.col("given").alias(key), "alias")
    return other.union(keys.select("user_id", F.col(key), F.col(key).alias("alias"))).distinct()


def resolve_snapshots(saved: DataFrame, live: DataFrame, *, fields: Sequence[str]) -> DataFrame:
    """Saved rows with the live row's fields where there is one: by dedupe key, else by id."""
    pick = lambda c, name: live.where(F.col(c).isNotNull()).groupBy(c).agg(F.min_by(F.struct(*fields), "ord").alias(name))
    j = saved.join(pick("dedupe_key", "_a"), "dedupe_key", "left").join(pick("id", "_b"), "id", "left")
    return j.withColumns({c: F.coalesce(F.col(f"_a.{c}"), F.col(f"_b.{c}"), F.col(c)) for c in fields}).withColumn("is_live", F.col("_a").isNotNull() | F.col("_b").isNotNull()).drop("_a", "_b")


def merge_snapshots(a: DataFrame, b: DataFrame, *, fields: Sequence[str], at: str = "updated_at", saved: str = "saved_at") -> DataFrame:
    """Two sets in one: rows that share any identity are one; each field from the newest row that has it, the earliest save."""
    both = a.unionByName(b, allowMissingColumns=True).withColumn("ord", F.xxhash64(F.to_json(F.struct("*"))))
    names = both.select("ord", F.explode(identities(both)).alias("n"))
    hub = names.groupBy("n").agg(F.min("ord").alias("hub"))
    comps = connected_components(names.join(hub, "n").select(F.col("ord").alias("l"), F.col("hub").alias("r")).distinct())
    rows = both.join(comps.withColumnRenamed("id", "ord"), "ord").drop("ord")
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(at, F.col(c).alias("v"))))["v"].alias(c)
    return rows.groupBy("component").agg(*[newest(c) for c in fields], F.min(saved).alias(saved), F.max(at).alias(at)).drop("component")


def replace_keep_protected(local: DataFrame, remote: DataFrame, applications: DataFrame, *, key: str = "job_key") -> DataFrame:
    """The remote set, and local rows with an application, which win over remote ones of their key."""
    kept = local.join(applications.select(key).distinct(), key, "left_semi")
    return kept.unionByName(remote.join(kept.select(key), key, "left_anti"), allowMissingColumns=True)


def overlay_legacy(ids: DataFrame, live: DataFrame, *, key: str = "id") -> tuple[DataFrame, DataFrame]:
    """U8: old ids with their live rows, and the ids that are still pending."""
    return ids.join(live, key), ids.join(live.select(key), key, "left_anti")


def rekey(refs: DataFrame, mapping: DataFrame, *, key: str = "job_key") -> DataFrame:
    """References under the new key where there is one (old_key, new_key)."""
    m = mapping.select(F.col("old_key").alias(key), "new_key")
    return refs.join(m, key, "left").withColumn(key, F.coalesce("new_key", key)).drop("new_key")


def next_status(status: Column) -> Column:
    """The step after a status."""
    return F.create_map(*[F.lit(x) for kv in NEXT_STATUS.items() for x in kv])[status]


def application_schedule(due: Column, interview: Column, applied: Column, status: Column, today: Column) -> Column:
    """(kind, date, timing): the date that matters next and whether it is overdue, today or upcoming."""
    kind = F.when((status == "interview") & interview.isNotNull(), "interview").when(status.isin("interested", "preparing") & due.isNotNull(), "due").when(applied.isNotNull(), "applied")
    date = F.when(kind == "interview", interview).when(kind == "due", due).otherwise(applied)
    return F.struct(kind.alias("kind"), date.alias("date"), F.when(date < today, "overdue").when(date == today, "today").when(date > today, "upcoming").alias("timing"))


def deadline_alerts(saved: DataFrame, postings: DataFrame, *, today: Column, days: Sequence[int] = (3, 1, 0)) -> DataFrame:
    """An alert for each saved posting whose deadline is 3, 1 or 0 days ahead."""
    j = saved.join(postings.select("job_key", "deadline_at"), "job_key").withColumn("days", F.datediff("deadline_at", today)).where(F.col("days").isin(*days))
    return j.select(F.concat_ws(":", F.lit("deadline"), "user_id", "job_key", F.col("days").cast("string")).alias("id"), "user_id", "job_key", "days", "deadline_at")


def upsert_notifications(old: DataFrame, new: DataFrame, *, at: str = "scheduled_at") -> DataFrame:
    """One row for each id, the newest by ``at``, new rows after old ones; the first created_at and a time of reading stay.

    With type and job_key among the columns, a job has one schedule notification: the newest, with what it was before
    as far as no other one of the job came between.
    """
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    if {"type", "job_key"} <= set(both.columns):
        owner = [c for c in ("user_id", "job_key") if c in both.columns]
        tied = F.coalesce((F.col("type") == "schedule") & F.col("job_key").isNotNull(), F.lit(False))
        order = F.struct("_new", at, "id")
        named = [F.col(c).alias(f"_{c}") for c in owner]
        last = both.where(tied).groupBy(*named).agg(F.max_by("id", order).alias("_last"))
        on = tied
        for c in owner:
            on &= F.col(c).eqNullSafe(F.col(f"_{c}"))
        held = both.join(last, on, "left")
        other = tied & (F.col("id") != F.col("_last"))
        breaks = held.where(other).groupBy(*[F.col(f"_{c}") for c in owner]).agg(F.max(order).alias("_break")).withColumnsRenamed({f"_{c}": f"_b_{c}" for c in owner})
        on = tied
        for c in owner:
            on &= F.col(c).eqNullSafe(F.col(f"_b_{c}"))
        held = held.where(~other).join(breaks, on, "left").where(F.col("_break").isNull() | (order > F.col("_break")))
        both = held.select(both.columns)
    fixed = [c for c in ("created_at",) if c in both.columns]
    rest = [c for c in both.columns if c not in ("id", "read_at", "_new", *fixed)]
    first = [F.min(c).alias(c) for c in fixed]
    return both.groupBy("id").agg(F.max_by(F.struct(*rest), F.struct("_new", at)).alias("_r"), *first, F.max("read_at").alias("read_at")).select("id", "_r.*", *fixed, "read_at")


def unread_count(notifications: DataFrame) -> DataFrame:
    """Unread rows of each user."""
    return notifications.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def user_counts(saved: DataFrame, hidden: DataFrame, notifications: DataFrame) -> DataFrame:
    """What each user has saved and hidden, and unread notifications; 0 where there are none."""
    one = lambda df, n, c=F.lit(1): df.select("user_id", F.lit(n).alias("kind"), c.cast("int").alias("n"))  # noqa: E731, B008
    rows = one(saved.dropDuplicates(["user_id", "job_key"]), "saved").union(one(hidden.dropDuplicates(["user_id", "job_key"]), "hidden")).union(one(notifications, "unread", F.col("read_at").isNull()))
    of = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k)
    return rows.groupBy("user_id").agg(of("saved"), of("hidden"), of("unread"))


def adjacent_compaction(mutations: DataFrame, *, keep: int = 100) -> DataFrame:
    """Of mutations in a row with one key the last stays, then the newest 100 of each owner."""
    w = Window.partitionBy("owner").orderBy("seq")
    last = mutations.withColumn("_n", F.lead("job_key").over(w)).where(F.col("_n").isNull() | (F.col("_n") != F.col("job_key"))).drop("_n")
    return cap_per_key(last, ["owner"], "seq", keep)


def sliding_admission(events: DataFrame, *, key: str, at: str, limit: int, seconds: float, tie: str) -> DataFrame:
    """Events with ``admitted``: fewer than ``limit`` admitted ones of the key lie within the window before.

    A refused event doesn't count, so rows are taken one after another; a key's rows come sorted and in pieces, with only the last
    ``limit`` admitted times kept.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now_key, times = None, []
        for b in batches:
            flags = []
            for k, t in zip(b["_key"].to_pylist(), b[at].to_pylist(), strict=True):
                if k != now_key:
                    now_key, times = k, []
                times = [x for x in times if (t - x).total_seconds() < seconds]
                flags.append(len(times) < limit)
                if flags[-1]:
                    times.append(t)
            own = [c for c in b.schema.names if c != "_key"]
            yield pa.RecordBatch.from_arrays([*[b[c] for c in own], pa.array(flags, pa.bool_())], [*own, "admitted"])

    named = events.withColumn("_key", F.to_json(F.struct(F.col(key).alias("k"))))  # a null key is a key of its own
    dealt = named.repartition("_key").sortWithinPartitions("_key", at, tie)
    return dealt.mapInArrow(run, f"{fields}, admitted boolean")


def rate_view(events: DataFrame, *, key: str, at: str, seconds: int) -> DataFrame:
    """Events with the number of the key's events in the window that ends with each."""
    w = Window.partitionBy(key).orderBy(F.unix_timestamp(at)).rangeBetween(-seconds, 0)
    return events.withColumn("in_window", F.count("*").over(w))
