"""Queries against postings: three-valued matches, intents and their ranks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.rules import js
from .ranks import ordered_parts, prefix_sums

MATCHED, MISMATCHED, UNKNOWN = "matched", "mismatched", "unknown"
OUTCOMES = {"confirmed": 0, "needs_review": 1, "mismatched": 2}

# Roles, their aliases and the words that name them; employment kinds; words that carry no wish.
ROLE_WORDS = {"health-manager": r"보건\s*관리|보건직|보건·산업", "occupational-nurse": r"산업\s*간호|사업장\s*간호|보건·산업", "clinical-nurse": r"임상\s*간호|간호사|간호직"}
ALIASES = {"health_manager": "health-manager", "occupational_nurse": "occupational-nurse", "clinical_nurse": "clinical-nurse", "보건관리자": "health-manager", "산업간호사": "occupational-nurse", "임상 간호사": "clinical-nurse", "regular": "정규직", "contract": "계약직", "part_time": "시간제"}
KINDS = (("정규직|공무직", "regular"), ("계약직|기간제|촉탁직|파견직", "contract"), ("시간제|파트타임|아르바이트", "part_time"))
QUALIFICATIONS = (r"간호사\s*(?:면허|자격증?)", "간호사 면허"), ("산업위생관리기사", "산업위생관리기사"), ("산업안전기사", "산업안전기사"), ("인간공학기사", "인간공학기사"), ("대기환경기사", "대기환경기사")
STOP_WORDS = ("추천", "공고", "채용", "일자리", "찾아줘", "보여줘", "원해", "가능한", "가능", "없는", "간호사", "직무", "근무")

#: What free texts and qualifications say.
WORDS = {
    "named_generic": r"임상\s*간호|병원\s*간호",
    "no_contract": r"(?:계약직|기간제).{0,5}(?:싫|제외|말고|빼)",
    "no_shift": r"(?:야간|나이트|밤근무|3교대|교대).{0,8}(?:없|제외|싫|말고|안\s*하|피하)|주간\s*근무|데이\s*근무|데이만|상근만",
    "particles": "(?:에서|으로|부터|까지|이면|이고|이나|거나|하고|위주로|정도로)$",
    "known_kinds": "정규직|계약직|기간제|시간제|파트|신입|경력|무관|야간|나이트|교대",
    "entry": r"신입|경력\s*무관|무경력|경력\s*(?:없|상관)|졸업\s*예정",
    "experienced": r"경력직|경력\s*\d+|\d+년\s*이상|경력\s*간호",
    "week": r"이번\s*주|일주일",
    "closing": r"마감\s*임박",
    "salary": "연봉|월급|급여|만원",
    "commute": r"출퇴근|통근|분\s*이내|가까운|거리",
    "must_day": r"(?:오늘|\d+\s*일\s*이내|이번\s*주).{0,4}(?:만|꼭|무조건|반드시)",
    "must_role": r"보건\s*관리자|산업\s*간호사|간호사",
    "must_level": r"신입|경력직|경력\s*무관",
    "licence": r"간호사\s*(?:면허|면허증|자격증?)\s*(?:소지자|소지|필수|보유|가능)?|간호사\s*면허로\s*지원",
    "barred": r"간호사\s*(?:면허|자격)(?:만으로는)?\s*(?:지원\s*)?(?:불가|제외|인정하지\s*않)",
    "safety": "산업(?:안전(?:관리)?|위생관리)기사|건설안전기사|인간공학기사",
    "composite": r"안전\s*[·ㆍ/&+]\s*보건|보건\s*[·ㆍ/&+]\s*안전|안전보건",
    "only": "필수|소지자만|자격요건",
}
WORKPLACES = ("검진센터", "외래", "병동", "수술실", "중환자실", "응급실", "인공신장실", "감염관리", "보험심사", "연구간호", "보건교사")


def _strings(c: str) -> Column:
    """An array column without null, blank and repeated entries; null is empty."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def normalize_criteria(criteria: DataFrame) -> DataFrame:
    """One row for each query with all its conditions: arrays without blanks, aliases by their names, no negative salary.

    Columns that criteria lacks are empty; required qualifications default to the nurse's licence and daytime work to wanted.
    """
    arrays = ("role_tags", "qualifications", "regions", "employment_types", "experience_levels", "keywords", "excluded_patterns", "excluded_keywords")
    df = criteria.withColumns({c: F.array().cast("array<string>") for c in arrays if c not in criteria.columns} | {c: F.lit(None).cast(t) for c, t in (("weekday_daytime", "boolean"), ("salary_minimum", "bigint")) if c not in criteria.columns})
    names = F.create_map(*[F.lit(x) for kv in ALIASES.items() for x in kv])
    named = lambda c: F.array_distinct(F.transform(_strings(c), lambda x: F.coalesce(F.try_element_at(names, x), x)))
    df = df.withColumns({c: named(c) if c in ("role_tags", "employment_types") else _strings(c) for c in arrays})
    return df.withColumns({"qualifications": F.when(F.size("qualifications") == 0, F.array(F.lit("간호사 면허"))).otherwise(F.col("qualifications")), "weekday_daytime": F.coalesce("weekday_daytime", F.lit(True)), "salary_minimum": F.when(F.col("salary_minimum") >= 0, F.col("salary_minimum"))})


def criteria_rows(criteria: DataFrame) -> DataFrame:
    """(query_id, side, condition, value): one row for each wish of each query."""
    one = lambda side, name: F.transform(F.col(name), lambda v: F.struct(F.lit(side).alias("side"), F.lit(name).alias("condition"), v.alias("value")))
    parts = [one("required", c) for c in ("role_tags", "qualifications", "regions")] + [one("preferred", c) for c in ("employment_types", "experience_levels", "keywords")] + [one("excluded", c) for c in ("excluded_patterns", "excluded_keywords")]
    return normalize_criteria(criteria).select("query_id", F.explode(F.concat(*parts)).alias("r")).select("query_id", "r.*")


def eligibility(raw: Column, duties: Column) -> Column:
    """(qualifications, status, composite): what a text lists and whether a nurse's licence is enough."""
    own = raw.rlike(js(WORDS["licence"]))
    barred = raw.rlike(js(WORDS["barred"]))
    safety = raw.rlike(WORDS["safety"])
    both = duties.rlike(WORDS["composite"]) & safety & ~own
    only = safety & raw.rlike(WORDS["only"]) & ~own
    status = F.when(barred | (only & ~both), "ineligible").when(own, "eligible").otherwise("unknown")
    return F.struct(text.all_labels(raw, [(js(p), v) for p, v in QUALIFICATIONS]).alias("qualifications"), status.alias("status"), both.alias("composite"))


def query_blocks(queries: DataFrame, size: int = 4096) -> Iterator[DataFrame]:
    """Queries in blocks of at most about ``size`` rows, so that each can be broadcast; one pass over the postings each."""
    order = [F.col("query_id")]
    parts = prefix_sums(ordered_parts(queries, order, "queries"), F.lit(1), order, "_n").withColumn("_block", F.floor(F.col("_n") / size)).drop("_n", "part")
    blocks = [r["_block"] for r in parts.select("_block").distinct().orderBy("_block").collect()]
    for b in blocks:
        yield parts.where(F.col("_block") == b).drop("_block")


def _against(postings: DataFrame, queries: DataFrame, judge, block: int) -> DataFrame:
    """judge(pairs) over every query and posting: the stated set of queries, block by block, against all rows."""
    out = None
    for b in query_blocks(queries, block):
        renamed = b.select(*[F.col(c).alias(c if c == "query_id" else f"q_{c}") for c in b.columns])
        pairs = judge(postings.crossJoin(F.broadcast(renamed)))  # at most ``block`` queries
        out = pairs if out is None else out.unionByName(pairs)
    return judge(postings.limit(0).crossJoin(queries.limit(0).select(*[F.col(c).alias(c if c == "query_id" else f"q_{c}") for c in queries.columns]))) if out is None else out


def _any(values: Column, test) -> Column:
    return F.exists(values, test)


def posting_roles() -> Column:
    """The roles of a posting: its tags and those that its text names."""
    named = text.all_labels(F.col("search_text"), [(js(w), r) for r, w in ROLE_WORDS.items()])
    return F.array_union(F.coalesce("role_tags", F.array().cast("array<string>")), named)


def judged(p: DataFrame, *, roles: Column | None = None, hits: str | None = None) -> DataFrame:
    """Pairs of a posting and a query (columns q_...) with the status of each condition, the counts and the outcome.

    roles and hits name what is known of the posting already: its roles, and those of the stated words that it holds.
    """
    tri = lambda asked, yes, no: F.when(asked, F.when(yes, MATCHED).when(no, MISMATCHED).otherwise(UNKNOWN))
    some = lambda c: F.size(f"q_{c}") > 0
    roles = posting_roles() if roles is None else roles
    listed, el = F.col("eligibility.qualifications"), F.col("eligibility.status")
    licence = F.array_contains("q_qualifications", "간호사 면허")
    qualified = _any(listed, lambda q: (q != "간호사 면허") & F.array_contains(F.col("q_qualifications"), q)) | ((el == "eligible") & licence)
    region = F.coalesce(F.col("region"), F.lit(""))
    day = F.col("schedule.weekday_daytime")
    s = lambda f: F.col(f"schedule.{f}")
    has = lambda x: F.when(x.rlike(r"3\s*교대"), s("kind") == "three_shift").when(x.rlike(r"2\s*교대"), s("kind") == "two_shift").when(x.rlike("(?i)야간|나이트|night"), s("night")).when(x.rlike(r"(?i)당직|온\s*콜|on[ -]?call"), s("on_call")).when(x.rlike("교대"), s("shift"))
    lacks = lambda x: F.when(x.rlike("(?i)야간|나이트|night"), s("night") == False).when(x.rlike(r"(?i)당직|온\s*콜|on[ -]?call"), s("on_call") == False).when(x.rlike("교대"), s("shift") == False)  # noqa: E712, E731
    words = F.coalesce(F.col("search_text"), F.lit(""))
    if hits is None:
        blocked = _any(F.col("q_excluded_keywords"), lambda k: words.contains(F.lower(k)))
        liked = _any(F.col("q_keywords"), lambda k: words.contains(F.lower(k)))
    else:
        blocked, liked = (F.arrays_overlap(F.col(hits), F.col(c)) for c in ("q_excluded_keywords", "q_keywords"))
    level = F.coalesce(F.col("experience_level"), F.lit(""))
    kinds = F.coalesce("employment_types", F.array().cast("array<string>"))
    p = p.withColumns({
        "required_role": tri(some("role_tags"), F.arrays_overlap(roles, "q_role_tags"), F.size(roles) > 0),
        "required_qualification": tri(some("qualifications"), (el != "ineligible") & qualified, el == "ineligible"),
        "required_region": tri(some("regions"), _any(F.col("q_regions"), lambda r: region.contains(r)), region != ""),
        "required_weekday_daytime": tri(F.col("q_weekday_daytime"), day == "confirmed", day == "mismatched"),
        "excluded_patterns": F.when(some("excluded_patterns"), F.when(_any(F.col("q_excluded_patterns"), lambda x: F.coalesce(has(x), F.lit(False))), MISMATCHED).when(F.forall(F.col("q_excluded_patterns"), lambda x: F.coalesce(lacks(x), F.lit(False))), MATCHED).otherwise(UNKNOWN)),
        "excluded_keywords": F.when(some("excluded_keywords"), F.when(blocked, MISMATCHED).when(F.col("checked"), MATCHED).otherwise(UNKNOWN)),
        "preferred_employment": tri(some("employment_types"), F.arrays_overlap(kinds, "q_employment_types"), F.size(kinds) > 0),
        "preferred_experience": tri(some("experience_levels"), _any(F.col("q_experience_levels"), lambda x: F.when(x == "신입·무관", level.rlike("신입|무관")).otherwise(level.contains(x))), level != ""),
        "preferred_salary": tri(F.col("q_salary_minimum").isNotNull(), F.col("salary_minimum") >= F.col("q_salary_minimum"), F.col("salary_minimum") < F.col("q_salary_minimum")),
        "preferred_keywords": F.when(some("keywords"), F.when(liked, MATCHED).when(F.col("checked"), MISMATCHED).otherwise(UNKNOWN)),
    })
    decisive = [c for c in p.columns if c.startswith(("required_", "excluded_"))]
    every = decisive + [c for c in p.columns if c.startswith("preferred_")]
    count = lambda cols, v: sum((F.when(F.col(c) == v, 1).otherwise(0) for c in cols), F.lit(0))
    p = p.withColumns({"confirmed_count": count(every, MATCHED), "unknown_count": count(every, UNKNOWN), "mismatched_count": count(every, MISMATCHED), "overall": F.when(count(decisive, MISMATCHED) > 0, "mismatched").when(count(decisive, UNKNOWN) > 0, "needs_review").otherwise("confirmed")})
    p = p.withColumn("top_recommendation", (F.col("overall") == "confirmed") & ~F.coalesce("stale", F.lit(False)) & ~F.coalesce("eligibility.composite", F.lit(False)))
    p = p.select("query_id", "ord", *every, "confirmed_count", "unknown_count", "mismatched_count", "overall", "top_recommendation", "published_at")
    return p


def match_queries(postings: DataFrame, criteria: DataFrame, *, top: int | None = None, block: int = 4096) -> DataFrame:
    """Every query against every posting, with a status for each condition and the outcome: the report on a few
    stated queries. Many of them, mismatched pairs left out, are for :func:`query_index.match_stored`.

    postings have ord, search_text, role_tags, eligibility (of :func:`eligibility`), region, schedule (of schedule_of),
    employment_types, experience_level, salary_minimum, checked (detail seen), stale and published_at. A condition is matched,
    mismatched, unknown, or null if not asked. Any mismatch of required or excluded ones decides, then any unknown. With ``top``
    only each query's best rows stay: a limit of the report.
    """
    judge = lambda p: _ranked(judged(p), RANK_MATCH(), top)
    pairs = _against(postings, normalize_criteria(criteria), judge, block)
    return pairs.drop("published_at")


def RANK_MATCH() -> list[Column]:
    """Best recommendation, outcome, most confirmed, fewest unknown, newest, position."""
    order = F.create_map(*[F.lit(x) for kv in OUTCOMES.items() for x in kv])
    return [F.desc("top_recommendation"), order[F.col("overall")].asc(), F.desc("confirmed_count"), F.asc("unknown_count"), F.col("published_at").desc_nulls_last(), F.asc("ord")]


def _ranked(pairs: DataFrame, order: list[Column], top: int | None) -> DataFrame:
    if top is None:
        return pairs
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= top)


def match_conditions(matches: DataFrame) -> DataFrame:
    """One row for each asked condition of each pair."""
    names = [c for c in matches.columns if c.startswith(("required_", "excluded_", "preferred_"))]
    rows = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("condition"), F.col(c).alias("status"))) for c in names]))
    return matches.select("query_id", "ord", F.explode(rows).alias("r")).select("query_id", "ord", "r.*")


def extract_intent(queries: DataFrame, *, text_col: str = "text", length: int = 400) -> DataFrame:
    """Wishes of a free text: regions, roles, employment, experience, words to hold and to avoid, days to the deadline, must-haves."""
    q = F.substring(F.trim(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), r"\s+", " ")), 1, length)
    regions = [n for n, _ in text.REGIONS]
    must = lambda words: q.rlike(f"(?:{words}).{{0,4}}(?:만|꼭|필수|무조건|반드시)")
    no_contract = q.rlike(WORDS["no_contract"])
    no_shift = q.rlike(WORDS["no_shift"])
    solid = F.replace(q, F.lit(" "), F.lit(""))
    tokens = F.transform(F.split(F.regexp_replace(q, r"[()\[\]{}.,!?/\\:;\"']", " "), r"\s+"), lambda w: F.regexp_replace(w, WORDS["particles"], ""))
    own = F.slice(F.filter(tokens, lambda w: (F.length(w) >= 2) & ~w.isin(*STOP_WORDS, *regions) & ~w.rlike(WORDS["known_kinds"])), 1, 8)
    hold = F.concat(F.array_compact(F.array(F.when(q.contains("상근"), F.lit("상근")).when(q.rlike(r"주간|데이\s*근무"), F.lit("주간")), *[F.when(solid.contains(w), F.lit(w)) for w in WORKPLACES])), own)
    avoid = F.concat(F.when(no_shift, F.array(*[F.lit(w) for w in ("야간", "나이트", "N-KEEP", "3교대", "교대근무")])).otherwise(F.array().cast("array<string>")), F.when(no_contract, F.array(F.lit("계약직"), F.lit("기간제"))).otherwise(F.array().cast("array<string>")))
    kinds = F.array_compact(F.array(*[F.when(q.rlike(p) & (~no_contract if k == "contract" else F.lit(True)), F.lit(k)) for p, k in KINDS]))
    named = F.regexp_extract(q, r"(\d+)\s*일\s*이내", 1).try_cast("int")
    musts = [("role", must(WORDS["must_role"])), ("region", must("|".join(regions))), ("employment", must("정규직|계약직|기간제|시간제")), ("experience", must(WORDS["must_level"])), ("deadline", q.rlike(WORDS["must_day"]))]
    roles = text.all_labels(q, [(js(w), r) for r, w in ROLE_WORDS.items()])
    generic = (F.size(roles) > 1) & ~q.rlike(WORDS["named_generic"])  # a specific role says more than "nurse"
    specific = F.when(generic, F.array_remove(roles, "clinical-nurse")).otherwise(roles)
    return queries.withColumns({
        "regions": F.array_compact(F.array(*[F.when(q.contains(n), F.lit(n)) for n in regions])), "role_tags": specific, "employment_types": kinds,
        "experience_level": F.when(q.rlike(WORDS["entry"]), "entry").when(q.rlike(WORDS["experienced"]), "experienced").otherwise("any"),
        "include_keywords": F.slice(F.array_distinct(hold), 1, 10), "exclude_keywords": F.slice(F.array_distinct(avoid), 1, 10),
        "deadline_days": F.when(named.isNotNull(), F.least(named, F.lit(90))).when(q.rlike(WORDS["week"]), 7).when(q.rlike(WORDS["closing"]), 3),
        "unresolved": F.array_compact(F.array(F.when(q.rlike(WORDS["salary"]), F.lit("salary")), F.when(q.rlike(WORDS["commute"]), F.lit("commute")))),
        "required_fields": F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in musts])),
    })


def score_intents(postings: DataFrame, intents: DataFrame, *, top: int | None = None, block: int = 4096) -> DataFrame:
    """Every intent against every posting: score 0 to 100, matched rows best first.

    postings have ord, title, search_text, region, employment (labels), experience (entry, experienced or null) and deadline_days. Points: 10 to
    begin with, region 24 or -28, role up to 38 or -32, employment 15 or -14, experience 9 or -8, words 6 each up to 18,
    an avoided word -70, deadline 8 or -8. Matched: 22 or more, no avoided word, no must-have missed.
    """

    def judge(p: DataFrame) -> DataFrame:
        asked = lambda c: F.size(f"q_{c}") > 0
        solid = F.replace(F.lower(F.coalesce("search_text", F.lit(""))), F.lit(" "), F.lit(""))
        bare = lambda k: F.replace(F.lower(k), F.lit(" "), F.lit(""))
        region = _any(F.col("q_regions"), lambda r: F.coalesce("region", F.lit("")).contains(r))
        quality = lambda r: F.coalesce(*[F.when((r == n) & F.coalesce("title", F.lit("")).rlike(js(w)), 2).when((r == n) & F.coalesce("search_text", F.lit("")).rlike(js(w)), 1) for n, w in ROLE_WORDS.items()], F.lit(0))
        found = F.filter(F.transform(F.col("q_role_tags"), quality), lambda n: n > 0)
        role = F.when(F.size(found) > 0, F.least(F.lit(38), F.when(F.array_max(found) == 2, 32).otherwise(18) + (F.size(found) - 1) * 3)).otherwise(-32)
        kinds = F.coalesce("employment", F.array().cast("array<string>"))
        job = F.arrays_overlap(kinds, "q_employment_types")
        want, level = F.col("q_experience_level"), F.col("experience")
        right = F.coalesce(level == want, want == "entry")
        words = F.size(F.filter(F.col("q_include_keywords"), lambda k: (F.length(bare(k)) >= 2) & solid.contains(bare(k))))
        blocked = _any(F.col("q_exclude_keywords"), lambda k: solid.contains(bare(k)))
        days, limit = F.col("deadline_days"), F.col("q_deadline_days")
        need = lambda n: F.array_contains("q_required_fields", n)
        off = {"region": asked("regions") & ~region, "role": asked("role_tags") & (F.size(found) == 0), "employment": asked("employment_types") & (F.size(kinds) > 0) & ~job, "experience": (want != "any") & level.isNotNull() & ~right, "deadline": F.coalesce(days > limit, F.lit(False))}
        points = (
            F.lit(10) + F.when(asked("regions"), F.when(region, 24).otherwise(-28)).otherwise(0) + F.when(asked("role_tags"), role).otherwise(0)
            + F.when(asked("employment_types"), F.when(job, 15).when(F.size(kinds) > 0, -14).otherwise(0)).otherwise(0) + F.when(want != "any", F.when(right, 9).when(level.isNotNull(), -8).otherwise(0)).otherwise(0)
            + F.least(F.lit(18), words * 6) + F.when(blocked, -70).otherwise(0) + F.when(limit.isNotNull() & days.isNotNull(), F.when(days <= limit, 8).otherwise(-8)).otherwise(0)
        )
        hard = F.lit(False)
        for n, c in off.items():
            hard |= need(n) & c
        p = p.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), points))).where(~blocked & ~hard & (F.col("score") >= 22)).select("query_id", "ord", "score", "deadline_days")
        return _ranked(p, [F.desc("score"), F.coalesce("deadline_days", F.lit(999)).asc(), F.asc("ord")], top)

    return _against(postings, intents, judge, block)


def recommend(postings: DataFrame, profiles: DataFrame, *, top: int | None = None, block: int = 4096) -> DataFrame:
    """Every profile against every posting: strong, partial or review, with the counts behind it."""

    def judge(p: DataFrame) -> DataFrame:
        asked = lambda c: F.size(f"q_{c}") > 0
        roles = F.array_union(F.coalesce("role_tags", F.array().cast("array<string>")), text.all_labels(F.coalesce("search_text", F.lit("")), [(js(w), r) for r, w in ROLE_WORDS.items()]))
        role = F.arrays_overlap(roles, "q_role_tags")
        known = F.coalesce("region", F.lit("")) != ""
        region = _any(F.col("q_regions"), lambda r: F.coalesce("region", F.lit("")).contains(r))
        kinds = F.coalesce("employment_types", F.array().cast("array<string>"))
        job = F.arrays_overlap(kinds, "q_employment_types")
        liked = F.size(F.filter(F.col("q_keywords"), lambda k: F.coalesce("search_text", F.lit("")).contains(F.lower(k))))
        barred = F.size(F.filter(F.col("q_excluded_keywords"), lambda k: F.coalesce("search_text", F.lit("")).contains(F.lower(k))))
        reasons = role.cast("int") + region.cast("int") + job.cast("int") + F.least(F.lit(2), liked)
        poor = F.when(known, 1).otherwise(0) + F.when(F.size(kinds) > 0, 1).otherwise(0) + F.when(F.col("experience_level").isNotNull(), 1).otherwise(0) < 2
        unsure = F.coalesce("needs_review", F.lit(False)) | (F.size(roles) == 0) | poor
        differs = (asked("regions") & ~region & known) | (asked("employment_types") & ~job & (F.size(kinds) > 0))
        level = F.when(unsure | differs, "review").when(role & (region | ~asked("regions")) & (reasons >= 2) & (barred == 0), "strong").when(~role | (barred > 0), "review").otherwise("partial")
        p = p.select("query_id", "ord", level.alias("recommendation"), reasons.alias("n_reasons"), barred.alias("n_excluded"), "first_seen_at")
        rank = F.create_map(*[F.lit(x) for kv in (("strong", 0), ("partial", 1), ("review", 2)) for x in kv])
        return _ranked(p, [rank[F.col("recommendation")].asc(), F.col("first_seen_at").desc_nulls_last(), F.asc("ord")], top)

    return _against(postings, normalize_criteria(profiles), judge, block)
