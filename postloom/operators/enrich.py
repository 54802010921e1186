"""What details taught about postings: a state that merges in any order, laid over postings by any shared identity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..storage import stored
from .components import connected_components

# Ranks of experience domains and of the evidence for them, and the limits of a cache entry.
DOMAIN_RANKS = {"clinical": 2, "health-manager": 2, "nursing-general": 1, "unspecified": 0}
STRENGTHS = {"title-context": 1, "explicit": 2, "explicit-detail": 3}
IDS_KEPT, URLS_KEPT = 12, 4


def _rank(names: dict[str, int], c: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c], F.lit(0))


def _names(c: str, df: DataFrame, kind: str) -> Column:
    """Identities of a kind with its letter before them, so that an id and an address never meet."""
    if c not in df.columns:
        return F.array().cast("array<string>")
    values = F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda v: v.isNotNull() & (F.trim(v) != ""))
    return F.transform(values, lambda v: F.concat(F.lit(kind), F.trim(v)))


def details_state(details: DataFrame, fields: Sequence[str]) -> DataFrame:
    """One row of state for each verified detail: (names, checked_at, f_<field>, domains).

    details have ids, urls, checked_at, verified, the fields, and experience_domain with evidence_field, evidence and strength. A field
    is (time, value), null where the detail doesn't know it; domains has at most one entry for each domain: (strength, time, field, excerpt).
    """
    known = details.where(F.coalesce("verified", F.lit(False)) & F.col("checked_at").isNotNull())
    names = F.array_distinct(F.concat(_names("ids", known, "i"), _names("urls", known, "u")))
    value = lambda c: text.meaningful(F.col(c), compose=False) if dict(known.dtypes)[c] == "string" else F.col(c)
    cols = [F.when(value(c).isNotNull(), F.struct(F.col("checked_at").alias("at"), F.col(c).alias("v"))).alias(f"f_{c}") for c in fields]
    fits = F.col("experience_domain").isin(*DOMAIN_RANKS) & F.col("strength").isin(*STRENGTHS) & (F.coalesce("evidence", F.lit("")) != "")
    entry = F.struct(F.col("experience_domain").alias("domain"), _rank(STRENGTHS, F.col("strength")).alias("strength"), F.col("checked_at").alias("at"), F.col("evidence_field").alias("field"), F.col("evidence").alias("excerpt"))
    domains = F.when(fits, F.array(entry)).otherwise(F.array().cast(f"array<{_DOMAIN}>"))
    return known.select(names.alias("names"), "checked_at", *cols, domains.alias("domains")).where(F.size("names") > 0)


_DOMAIN = "struct<domain:string,strength:int,at:timestamp,field:string,excerpt:string>"


def merge_states(*states: DataFrame) -> DataFrame:
    """States in one, a row for each group of rows that share an identity, directly or through others.

    Of each field the newest value stays (of one time the largest), of each domain its strongest, then newest evidence. These are maxima, so
    batches merge in any order, grouping and number with one result. Merged state has ``entry``, its smallest name.
    """
    parts = [s.drop("entry") for s in states]
    both = parts[0]
    for s in parts[1:]:
        both = both.unionByName(s)
    rows = stored(both.withColumn("first", F.array_min("names")), "enrich-rows")
    # rows are vertices under their first names; a name that one alone has links nothing
    named = rows.select(F.col("first").alias("r"), F.explode("names").alias("name"))
    links = named.withColumn("l", F.min("r").over(Window.partitionBy("name"))).where("l <> r").select("l", "r")
    entries = stored(connected_components(links), "enrich-entries")
    own = rows.join(entries.withColumnRenamed("id", "first"), "first", "left").withColumn("entry", F.coalesce("component", "first"))
    fields = [c for c in both.columns if c.startswith("f_")]
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_set("names")))).alias("names")
    merged = own.groupBy("entry").agg(F.max("checked_at").alias("checked_at"), names, *[F.max(c).alias(c) for c in fields])
    best = own.select("entry", F.explode("domains").alias("d")).groupBy("entry", F.col("d.domain").alias("domain"))
    best = best.agg(F.max(F.struct("d.strength", "d.at", "d.field", "d.excerpt")).alias("b"))
    one = F.struct("domain", F.col("b.strength").alias("strength"), F.col("b.at").alias("at"), F.col("b.field").alias("field"), F.col("b.excerpt").alias("excerpt"))
    domains = best.groupBy("entry").agg(F.array_sort(F.collect_list(one)).alias("domains"))
    out = merged.join(domains, "entry", "left")
    return out.select("entry", "names", "checked_at", *fields, F.coalesce("domains", F.array().cast(f"array<{_DOMAIN}>")).alias("domains"))


def limited(state: DataFrame) -> DataFrame:
    """State with at most 12 ids and 4 addresses an entry, the limit of what is exported; merging takes whole states."""
    own = lambda kind, n: F.slice(F.filter("names", lambda x: F.substring(x, 1, 1) == kind), 1, n)
    return state.withColumn("names", F.concat(own("i", IDS_KEPT), own("u", URLS_KEPT)))


def settled_domain(domains: Column) -> Column:
    """The entry of the most specific domain; null if there is none or two of the same specific rank contradict."""
    ranked = F.transform(domains, lambda d: F.struct(_rank(DOMAIN_RANKS, d["domain"]).alias("rank"), d["strength"].alias("strength"), d.alias("d")))
    top = F.array_max(ranked)
    rivals = F.size(F.filter(ranked, lambda r: r["rank"] == top["rank"]))
    return F.when((F.size(domains) > 0) & (rivals == 1), top["d"])


def enrich(postings: DataFrame, state: DataFrame, fields: Sequence[str], *, now: Column, key: str = "ord", ttl_days: float = 7) -> DataFrame:
    """Postings with what the state knows of them; ``key`` names a row.

    A posting is meant by its id and source_ids, else by its url and alternate_urls: an entry that shares an id goes before
    all that share an address, and of several the newest counts, then the first by name. Only fields (the whitelist) that are
    unknown are filled. A domain is laid over a vaguer one, or one of the same name with weaker evidence; two specific domains that
    contradict leave the posting's own. Entries over the TTL or more than 5 minutes ahead don't count. A hit sets ``enriched``,
    ``detail_checked_at`` and clears profile_key, so that tiers are worked out anew.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("checked_at")
    live = stored(state.where(age.between(-300, ttl_days * 86400)), "enrich-live")
    one = lambda c: F.array(F.col(c)) if c in postings.columns else F.array().cast("array<string>")
    many = lambda c: F.coalesce(F.col(c), F.array().cast("array<string>")) if c in postings.columns else F.array().cast("array<string>")
    named = postings.select(key, F.concat(one("id"), many("source_ids")).alias("ids"), F.concat(one("url"), many("alternate_urls")).alias("urls"))
    meant = named.select(key, F.explode(F.array_distinct(F.concat(_names("ids", named, "i"), _names("urls", named, "u")))).alias("name"))
    held = live.select("entry", "checked_at", F.explode("names").alias("name"))
    met = meant.join(held, "name").select(key, "entry", F.struct((F.substring("name", 1, 1) == "i").cast("int").alias("by_id"), "checked_at").alias("order"))
    first = Window.partitionBy(key).orderBy(F.desc("order"), "entry")
    hit = met.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(key, "entry")
    facts = live.select("entry", F.col("checked_at").alias("detail_checked_at"), *[F.col(f"f_{c}.v").alias(f"_f_{c}") for c in fields], settled_domain(F.col("domains")).alias("_d"))
    j = postings.join(hit.join(facts, "entry").drop("entry"), key, "left")
    unknown = lambda c: text.meaningful(F.col(c), compose=False).isNull() if dict(postings.dtypes)[c] == "string" else F.col(c).isNull()
    j = j.withColumns({c: F.when(unknown(c), F.coalesce(F.col(f"_f_{c}"), F.col(c))).otherwise(F.col(c)) for c in fields if c in postings.columns})
    j = j.withColumn("enriched", F.col("detail_checked_at").isNotNull())
    if "experience_domain" in postings.columns:
        now_rank, new_rank = _rank(DOMAIN_RANKS, F.col("experience_domain")), _rank(DOMAIN_RANKS, F.col("_d.domain"))
        stronger = F.col("_d.strength") > _rank(STRENGTHS, F.col("evidence_strength"))
        same = F.coalesce(F.col("experience_domain") == F.col("_d.domain"), F.lit(False))
        over = F.col("_d").isNotNull() & F.when(now_rank == 0, True).when(same, stronger).otherwise(new_rank > now_rank)
        strength = F.create_map(*[F.lit(x) for k, v in STRENGTHS.items() for x in (v, k)])[F.col("_d.strength")]
        j = j.withColumn("_over", F.coalesce(over, F.lit(False)))
        j = j.withColumns({"evidence_strength": F.when(F.col("_over"), strength).otherwise(F.col("evidence_strength")), "experience_domain": F.when(F.col("_over"), F.col("_d.domain")).otherwise(F.col("experience_domain"))})
    if "profile_key" in postings.columns:
        j = j.withColumn("profile_key", F.when(~F.col("enriched"), F.col("profile_key")))
    return j.drop("_d", "_over", *[f"_f_{c}" for c in fields])
