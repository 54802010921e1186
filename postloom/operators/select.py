"""Filters, orders, pages and discovery over postings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from .ranks import ordered_parts, prefix_sums

ANY = "전체"


def text_match(haystack: Column, query: str, special: dict[str, Column] | None = None) -> Column:
    """the whole query as a substring; if a word of it is special, each word by itself, the special one by its condition."""
    words = query.strip().lower().split()
    if special and any(w in special for w in words):
        out = F.lit(True)
        for w in words:
            out &= special[w] if w in special else haystack.contains(w)
        return out
    return haystack.contains(query.strip().lower())


def employment_match(c: Column, wanted: str) -> Column:
    """unknown employment fits only the choice for unknown; a regular post must not be an irregular one."""
    if wanted == ANY:
        return F.lit(True)
    if wanted == "원문 확인":
        return c.isNull() | c.rlike("^(?:|-|원문 확인|미표기)$")
    return F.coalesce(c.rlike("(?<!비)정규직") if wanted == "정규직" else c.contains(wanted), F.lit(False))


def age_limit(published: Column, first_seen: Column, today: Column, days: int = 30) -> Column:
    """not older than the limit; undated rows stay."""
    return F.coalesce(F.datediff(today, F.coalesce(published, first_seen)) <= days, F.lit(True))


def title_keep(title: Column, keep: str, drop: str | None = None) -> Column:
    """the title holds one pattern and not the other."""
    return title.rlike(keep) & ~title.rlike(drop) if drop else title.rlike(keep)


def not_closed(status: Column, receipt: Column, end: Column, deadline: Column, now: Column, today: Column) -> Column:
    """closed neither by status, receipt text, end time nor date."""
    shut = [F.coalesce(x, F.lit(False)) for x in (status.isin("expired", "closed"), receipt.rlike("마감|종료|완료"), end <= now, deadline < today)]
    return ~(shut[0] | shut[1] | shut[2] | shut[3])


def deadline_bucket(days: Column, status: Column, bucket: str) -> Column:
    """The deadline choices of a list query."""
    return {"오늘 마감": status == "today", "3일 이내": days.between(0, 3), "7일 이내": days.between(0, 7), "상시채용": status == "rolling", "마감됨": status == "closed", "원문 확인": status == "unknown"}[bucket]


def filter_postings(df: DataFrame, filters: dict, *, today: Column) -> DataFrame:
    """rows that meet every supplied filter, as one condition.

    query (over search_text), care_role, region (name, code, or 서울·경기), employment (any of a list), experience, source,
    department, work_pattern, facility_type, non_shift_only, availability (open rows up to 30 days old, or closed
    ones) and deadline. Unknown names are refused.
    """
    if unknown := set(filters) - {"query", "care_role", "region", "employment", "experience", "source", "department", "work_pattern", "facility_type", "non_shift_only", "availability", "deadline"}:
        raise ValueError(f"no such filter: {', '.join(sorted(unknown))}")
    keep = F.lit(True)
    chosen = lambda name: filters.get(name) not in (None, "", ANY, "all")
    if filters.get("query"):
        keep &= text_match(F.col("search_text"), filters["query"], {"pa": F.col("care_role") == "pa"} if "care_role" in df.columns else None)
    for name in ("care_role", "source", "department", "work_pattern", "facility_type"):
        if chosen(name):
            keep &= F.col(name) == filters[name]
    if chosen("region"):
        region, code = F.coalesce(F.col("region"), F.lit("")), F.coalesce(F.col("region_code"), F.lit(""))
        want = filters["region"]
        keep &= region.rlike("서울|경기") | code.isin("11", "41") if want == "서울·경기" else region.contains(want) | (code == ("11" if want == "서울" else want))
    wanted = [filters["employment"]] if isinstance(filters.get("employment"), str) else list(filters.get("employment") or [])
    if wanted and ANY not in wanted:
        any_of = F.lit(False)
        for w in wanted:
            any_of |= employment_match(F.col("employment_type"), w)
        keep &= any_of
    if chosen("experience"):
        keep &= F.col("experience_level").rlike("신입|무관") if filters["experience"] == "신입·무관" else F.col("experience_level") == filters["experience"]
    if filters.get("non_shift_only"):
        keep &= F.col("non_shift_rank") <= 1
    if chosen("availability") or chosen("deadline"):
        days = F.datediff("deadline_at", today)
        status = dates.deadline_label(F.col("deadline_at"), F.coalesce(F.col("deadline"), F.lit("")), today)
        if chosen("availability"):
            keep &= status == "closed" if filters["availability"] == "마감됨" else (status != "closed") & age_limit(F.col("published_at"), F.to_date("first_seen_at"), today)
        if chosen("deadline"):
            keep &= deadline_bucket(days, status, filters["deadline"])
    return df.where(keep)


#: Orders by name, as functions of the day; the position of a row decides between equals.
ORDERS = {
    "recommended": lambda today: [F.col("tier_order").asc(), (F.col("tier_score") - dates.age_penalty(dates.listing_age(F.col("published_at"), F.to_date("first_seen_at"), today))).desc(), F.col("non_shift_rank").asc(), F.col("work_life_score").desc(), F.coalesce("published_at", F.to_date("first_seen_at")).desc(), F.col("first_seen_at").desc(), F.collate("title", "KO").asc(), F.col("ord").asc()],
    "tier_latest": lambda today: [F.col("tier_order").asc(), F.coalesce("published_at", F.to_date("first_seen_at")).desc(), F.col("first_seen_at").desc(), F.col("tier_score").desc(), F.col("non_shift_rank").asc(), F.col("work_life_score").desc(), F.collate("title", "KO").asc(), F.col("ord").asc()],
    "latest": lambda today: [F.col("published_at").desc_nulls_last(), F.col("first_seen_at").desc(), F.col("ord").asc()],
    "deadline": lambda today: [F.when(F.datediff("deadline_at", today) >= 0, F.datediff("deadline_at", today)).asc_nulls_last(), F.col("first_seen_at").desc(), F.col("ord").asc()],
    "fit": lambda today: [F.element_at(F.create_map(*[F.lit(x) for p in (("strong", 0), ("partial", 1), ("review", 2)) for x in p]), F.col("recommendation")).asc_nulls_last(), F.col("first_seen_at").desc(), F.col("ord").asc()],
    "snapshot": lambda today: [F.col("last_seen_at").desc(), F.col("deadline_at").asc_nulls_last(), F.col("ord").asc()],
    "saved": lambda today: [F.when(F.datediff("deadline_at", today) >= 0, 0).when(F.col("deadline_at").isNull(), 1).otherwise(2).asc(), F.datediff("deadline_at", today).asc_nulls_last(), F.col("ord").asc()],
    "hidden": lambda today: [F.col("hidden_at").desc_nulls_last(), F.col("ord").asc()],
}


def sorted_postings(df: DataFrame, order: str, *, today: Column) -> DataFrame:
    return df.orderBy(*ORDERS[order](today))


def stable_page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int = 24, *, max_limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """One page and (offset, limit, total, has_more, next_offset). The page comes from a top-k, not from a sort of all rows."""
    if offset < 0:
        raise ValueError("an offset is not negative")
    limit = min(max_limit, max(1, limit))
    page = df.orderBy(*order).limit(offset + limit).offset(offset) if offset else df.orderBy(*order).limit(limit)
    total = df.agg(F.count("*").alias("total"))
    left = F.least(F.lit(limit), F.greatest(F.lit(0), F.col("total") - offset))
    return page, total.select(F.lit(offset).alias("offset"), F.lit(limit).alias("limit"), "total", (F.col("total") > offset + left).alias("has_more"), (offset + left).alias("next_offset"))


def numbered(df: DataFrame, order: Sequence[Column], into: str = "position") -> DataFrame:
    """Every row with its place in the order, from 0; ranges of the order are counted side by side."""
    return prefix_sums(ordered_parts(df, order, "numbered"), F.lit(1), order, into).drop("part")


def histogram(df: DataFrame, c: str = "tier") -> DataFrame:
    """Rows for each value, over the whole filtered set."""
    return df.groupBy(c).agg(F.count("*").alias("n"))


def identities(df: DataFrame, columns: Sequence[str] = ("id", "dedupe_key", "job_key"), arrays: Sequence[str] = ("source_ids",)) -> Column:
    """All non-empty names under which a row may be meant."""
    own = [F.array(*[F.col(c) for c in columns if c in df.columns])] + [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in arrays if c in df.columns]
    return F.array_distinct(F.filter(F.concat(*own), lambda x: x.isNotNull() & (F.trim(x) != "")))


def in_ids(df: DataFrame, ids: DataFrame, *, key: str = "ord", anti: bool = False, id_col: str = "id") -> DataFrame:
    """Rows with (or, anti, without) an identity in ids; ``key`` names a row."""
    named = df.select(key, F.explode(identities(df)).alias("_id"))
    hit = named.join(ids.select(F.col(id_col).alias("_id")).distinct(), "_id").select(key).distinct()
    return df.join(hit, key, "left_anti" if anti else "left_semi")


def discover(df: DataFrame, mode: str, since: Column | None, seen: DataFrame, applied: DataFrame, *, key: str = "ord", at: str = "first_seen_at") -> tuple[DataFrame, DataFrame]:
    """Rows of a mode (new, unseen, all) and the counts of all modes over the whole set.

    Unseen rows have no identity among seen or applied; new ones are unseen and, after a first visit, strictly later than since.
    """
    if mode not in ("new", "unseen", "all"):
        raise ValueError(f"mode is new, unseen or all, not {mode}")
    named = df.select(key, F.explode(identities(df)).alias("id"))
    mark = lambda ids, name: named.join(ids.select(F.col(ids.columns[0]).alias("id")).distinct(), "id").select(key).distinct().withColumn(name, F.lit(True))
    marked = df.join(mark(applied, "_applied"), key, "left").join(mark(seen, "_seen"), key, "left")
    marked = marked.withColumn("is_applied", F.coalesce("_applied", F.lit(False))).withColumn("is_unseen", ~F.col("is_applied") & ~F.coalesce("_seen", F.lit(False)))
    marked = marked.withColumn("is_new", F.col("is_unseen") & (F.lit(True) if since is None else F.coalesce(F.col(at) > since, F.lit(False)))).drop("_applied", "_seen")
    counts = marked.agg(F.count_if("is_new").alias("new_count"), F.count_if("is_unseen").alias("unseen_count"), F.count("*").alias("all_count"), F.count_if("is_applied").alias("applied_count"))
    keep = F.lit(True) if mode == "all" else F.col(f"is_{mode}")
    return marked.where(keep), counts


def fair_interleave(df: DataFrame, group: str, host: str, score: str, *, tie: str = "ord", pattern: tuple[int, int] = (2, 1), unique: str | None = None) -> DataFrame:
    """Rows with ``slot``, the place in a list that takes turns: first a group's hosts, then ``pattern`` rows of group 0 and group 1.

    Within a host the best score comes first, hosts take turns in order of their best row; when one group runs out the other goes on.
    Of rows that share ``unique`` the best one stays. Ranks inside a host and the order of turns are both numbered in
    ranges, so neither a host nor a group has to fit in a task.
    """
    best = [F.col(score).desc_nulls_last(), F.col(tie).asc()]
    if unique:
        df = df.withColumn("_r", F.row_number().over(Window.partitionBy(unique).orderBy(*best))).where("_r = 1").drop("_r")
    hosts = ordered_parts(df, [F.col(group).asc(), F.col(host).asc(), *best], "interleave-hosts")
    ranked = prefix_sums(hosts, F.lit(1), best, "_turn", [group, host]).drop("part")
    head = ranked.where("_turn = 0").select(F.col(group).alias("_g"), F.col(host).alias("_h"), F.col(score).alias("_best"), F.col(tie).alias("_tie"))
    ranked = ranked.join(head, (F.col(group) == F.col("_g")) & F.col(host).eqNullSafe(F.col("_h"))).drop("_g", "_h")
    order = [F.col("_turn").asc(), F.col("_best").desc_nulls_last(), F.col("_tie").asc()]
    parts = ordered_parts(ranked, [F.col(group).asc(), *order], "interleave")
    n = prefix_sums(parts, F.lit(1), order, "_n", [group])
    a, b = pattern
    slot = F.when(F.col(group) == 0, F.floor(F.col("_n") / a) * (a + b) + F.col("_n") % a).otherwise(F.floor(F.col("_n") / b) * (a + b) + a + F.col("_n") % b)
    return n.withColumn("slot", slot).drop("part", "_n", "_turn", "_best", "_tie")


def cap_per_key(df: DataFrame, keys: Sequence[str], newest: str, n: int, *, tie: str | None = None) -> DataFrame:
    """The n newest rows of each key; a limit that is the feature. Spark cuts each key map-side."""
    order = [F.col(newest).desc_nulls_last()] + ([F.col(tie).asc()] if tie else [])
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_r") <= n).drop("_r")


def unique_by(df: DataFrame, keys: Sequence[str], position: str, *, values: str = "first") -> DataFrame:
    """One row for each key, at its first position, with its first or last values."""
    row = F.struct(*[F.col(c) for c in df.columns if c not in (*keys, position)])
    pick = F.min_by(row, position) if values == "first" else F.max_by(row, position)
    return df.groupBy(*keys).agg(F.min(position).alias(position), pick.alias("_row")).select(*keys, position, "_row.*")


def group_budget(df: DataFrame, order: Sequence[Column], budget: int) -> DataFrame:
    """The first rows over all groups, in the order of groups."""
    return df.orderBy(*order).limit(budget)


def facet_values(df: DataFrame, c: str) -> DataFrame:
    """The distinct values of a column or array column, sorted."""
    array = dict(df.dtypes)[c].startswith("array")
    return df.select(F.explode(c).alias("value") if array else F.col(c).alias("value")).where("value IS NOT NULL").distinct().orderBy("value")


#: Region presets of the second board.
PRESETS = {"metro": ("11", "28", "41"), "metro-all": ("11", "28", "41", None)}


def second_board_filter(df: DataFrame, *, today: Column, query: str = "", role: str | None = None, region: str | None = None, employment: str | None = None, experience: str | None = None, deadline: str | None = None) -> DataFrame:
    """text, tag, region (a preset, ``remote`` or a code), employment, experience class and deadline (active, today, open) of the second board."""
    keep = F.col("search_text").contains(query.strip().lower()) if query.strip() else F.lit(True)
    if role:
        keep &= F.array_contains("ai_tags", role)
    if region == "remote":
        keep &= F.coalesce(F.col("is_remote"), F.lit(False))
    elif region in PRESETS:
        codes = [c for c in PRESETS[region] if c]
        near = F.col("region_code").isin(*codes)
        keep &= near | F.col("region_code").isNull() | F.coalesce(F.col("is_remote"), F.lit(False)) if None in PRESETS[region] else near
    elif region:
        keep &= F.col("region_code") == region
    if employment:
        keep &= F.col("employment_type") == employment
    if experience:
        keep &= {"entry": F.coalesce("experience_years", F.lit(0)) == 0, "junior": F.coalesce("experience_years", F.lit(0)) <= 3, "senior": F.col("experience_years") >= 4}[experience]
    if deadline:
        days = F.datediff("deadline_at", today)
        keep &= {"active": F.coalesce(days >= 0, F.lit(True)), "today": days == 0, "open": F.col("deadline_at").isNull()}[deadline]
    return df.where(keep)


ORDERS |= {
    "second_board": lambda today: [F.element_at(F.create_map(*[F.lit(x) for kv in (("S", 0), ("A", 1), ("B", 2), ("C", 3), ("exclude", 4)) for x in kv]), F.col("ai_tier")).asc(), F.col("ai_score").desc(), F.col("deadline_at").asc_nulls_last(), F.col("last_seen_at").desc(), F.col("ord").asc()],
    "published": lambda today: [F.col("published_at").desc_nulls_last(), F.col("last_seen_at").desc(), F.col("ord").asc()],
    "recent": lambda today: [F.col("first_seen_at").desc_nulls_last(), F.col("ord").asc()],
}


def job_by_any_id(wanted: DataFrame, *frames: DataFrame, key: str = "ord", id_col: str = "id") -> DataFrame:
    """For each wanted id the first row that has it under any name, frames in order of preference."""
    out = None
    for rank, df in enumerate(frames):
        named = df.select(F.col(key).alias("_key"), F.explode(identities(df)).alias(id_col)).withColumn("_rank", F.lit(rank))
        out = named if out is None else out.unionByName(named)
    best = out.join(wanted.select(id_col).distinct(), id_col).groupBy(id_col).agg(F.min(F.struct("_rank", "_key")).alias("_b"))
    return best.select(id_col, F.col("_b._rank").alias("frame"), F.col("_b._key").alias(key))


def collection_stats(runs: DataFrame) -> DataFrame:
    """A10: requested, successful and failed queries of each source. runs: (source_id, query_label, ok)."""
    return runs.groupBy("source_id").agg(F.count("*").alias("requested"), F.count_if("ok").alias("successful"), F.count_if(~F.col("ok")).alias("failures"))


def with_region_info(df: DataFrame) -> DataFrame:
    """region_group, is_remote and is_metro of each row, from region, title and, where it is known, region_code."""
    info = text.region_info(F.col("region"), F.col("title"), F.col("region_code") if "region_code" in df.columns else None)
    return df.withColumn("_info", info).withColumns({n: F.col(f"_info.{n}") for n in ("region_group", "is_remote", "is_metro")}).drop("_info")


#: What a request may ask.
MODES = ("new", "unseen", "all")
MAX_IDS, MAX_ID, MAX_JSON, MAX_LIMIT = 2000, 512, 24_000, 100
RESERVED = ("__proto__", "constructor", "prototype")


def validate_requests(requests: DataFrame, *, strict: bool = False) -> DataFrame:
    """list requests with ``problem`` (null if there is none) and their page, ids and instant made plain.

    requests: any of filters, profile (JSON objects), hidden, ids (JSON arrays), mode, since, seen, applied (arrays of ids), offset and
    limit; what is null or absent takes its default. ``strict`` fails the job at the first request with a problem.
    """
    has = set(requests.columns)
    kind = lambda c: F.schema_of_variant(F.try_parse_json(c))
    form = lambda c, word: F.col(c).isNotNull() & ((F.length(c) > MAX_JSON) | ~F.coalesce(kind(F.col(c)).startswith(word), F.lit(False)))
    unsafe = lambda x: x.isNull() | (F.trim(x) == "") | F.trim(x).isin(*RESERVED) | (F.length(x) > MAX_ID)
    faults = [(form(c, "OBJECT"), c) for c in ("filters", "profile") if c in has] + [(form(c, "ARRAY"), c) for c in ("hidden", "ids") if c in has]
    if "mode" in has:
        faults.append((F.col("mode").isNotNull() & ~F.col("mode").isin(*MODES), "mode"))
    if "since" in has:
        faults.append((F.col("since").isNotNull() & dates.strict_iso(F.col("since")).isNull(), "since"))
    faults += [((F.size(c) > MAX_IDS) | F.exists(c, unsafe), c) for c in ("seen", "applied") if c in has]
    problem = F.coalesce(*[F.when(c, F.lit(n)) for c, n in faults], F.lit(None).cast("string"))
    whole = lambda c: F.coalesce(F.when(F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)).cast("double").cast("long"), F.lit(0))
    fixed = {"problem": problem}
    if "offset" in has:
        fixed["offset"] = F.greatest(F.lit(0), whole("offset"))
    if "limit" in has:
        fixed["limit"] = F.least(F.lit(MAX_LIMIT), F.greatest(F.lit(1), F.when(whole("limit") == 0, 24).otherwise(whole("limit"))))
    for c in ("seen", "applied"):
        if c in has:
            fixed[c] = F.array_sort(F.array_distinct(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x))))
    out = requests.withColumns(fixed)
    return out.withColumn("problem", F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.lit("wrong request: "), "problem"))).cast("string")) if strict else out
