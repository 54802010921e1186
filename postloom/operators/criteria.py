"""Criteria, profiles, intents and list filters: what a user wants, from one form to another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .match import normalize_criteria

# Words of avoided work and the pattern each stands for, the first that fits; words of wanted daytime work; the open choice.
AVOIDED = ((r"3\s*교대|삼교대", "3교대"), (r"2\s*교대|이교대", "2교대"), (r"(?i)야간|나이트|night", "야간"), (r"(?i)당직|온\s*콜|on[ -]?call", "당직·온콜"))
NIGHT, SHIFT, WITHOUT = r"(?i)야간|나이트|night", "교대", r"\s*제외$"
DAYTIME, DAYTIME_WORDS = "상근·주간", r"주간|상근|월\s*[~\-–—]\s*금|주\s*5\s*일"
ANY, DAYTIME_FILTER = "전체", "주중·주간 확인"
LEVELS = {"entry": "신입·무관", "experienced": "경력"}
QUERY_LENGTH = 300

_LISTS = ("role_tags", "qualifications", "regions", "employment_types", "experience_levels", "keywords", "excluded_patterns", "excluded_keywords")


def _none() -> Column:
    return F.array().cast("array<string>")


def _list(df: DataFrame, c: str) -> Column:
    """The values of a list column without blanks and repeats; none if the column is missing or null."""
    if c not in df.columns:
        return _none()
    return F.array_distinct(F.filter(F.transform(F.coalesce(F.col(c), _none()), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "")))


def _query(df: DataFrame) -> Column:
    return F.substring(F.trim(F.coalesce(F.col("query"), F.lit(""))), 1, QUERY_LENGTH) if "query" in df.columns else F.lit("")


def profile_to_criteria(profiles: DataFrame) -> DataFrame:
    """Profiles (query_id and lists) as normalized criteria.

    ``3교대 제외`` among wanted patterns and avoided words of nights and shifts become avoided patterns; other avoided words stay
    words. Daytime is wanted if required_weekday_daytime isn't false, or where that is null if ``상근·주간`` is a wanted pattern.
    """
    wanted, words = _list(profiles, "work_patterns"), _list(profiles, "excluded_keywords")
    from_wanted = F.array_compact(F.array(*[F.when(F.array_contains(wanted, f"{p} 제외"), F.lit(p)) for p in ("3교대", "2교대")]))
    of_word = lambda w: F.array_compact(F.array(F.when(w.rlike(NIGHT), F.lit("야간")), F.when(w.rlike(SHIFT), F.regexp_replace(w, WITHOUT, ""))))
    daytime = F.array_contains(wanted, DAYTIME)
    if "required_weekday_daytime" in profiles.columns:
        daytime = F.coalesce(F.col("required_weekday_daytime"), daytime)
    pay = F.col("salary_minimum").cast("long") if "salary_minimum" in profiles.columns else F.lit(None).cast("long")
    return normalize_criteria(
        profiles.select(
            "query_id", _query(profiles).alias("query"), _list(profiles, "role_tags").alias("role_tags"), _list(profiles, "qualifications").alias("qualifications"), _list(profiles, "region_codes").alias("regions"),
            daytime.alias("weekday_daytime"), _list(profiles, "employment_types").alias("employment_types"), _list(profiles, "experience_levels").alias("experience_levels"), pay.alias("salary_minimum"),
            _list(profiles, "preferred_keywords").alias("keywords"), F.concat(_list(profiles, "excluded_work_patterns"), from_wanted, F.flatten(F.transform(words, of_word))).alias("excluded_patterns"),
            F.filter(words, lambda w: ~w.rlike(f"{NIGHT}|{SHIFT}")).alias("excluded_keywords"),
        )
    )


def criteria_to_profile(criteria: DataFrame) -> DataFrame:
    """Criteria as profiles; the one wanted pattern is ``상근·주간`` where daytime is wanted."""
    c = normalize_criteria(criteria)
    return c.select(
        "query_id", "role_tags", "qualifications", F.col("regions").alias("region_codes"), F.col("weekday_daytime").alias("required_weekday_daytime"), "employment_types", "experience_levels",
        F.col("keywords").alias("preferred_keywords"), F.col("excluded_patterns").alias("excluded_work_patterns"), "excluded_keywords",
        F.when(F.col("weekday_daytime"), F.array(F.lit(DAYTIME))).otherwise(_none()).alias("work_patterns"),
    )


def intent_to_criteria(intents: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """Intents (of ``match.extract_intent``) laid over the current criteria of their query, or over empty ones.

    Stated roles, regions, employment and level take the place of the current ones; words to hold are added, words to avoid become the
    pattern that they name, else are added too. Daytime words in the intent ask for daytime work.
    """
    base = normalize_criteria(current if current is not None else intents.select("query_id").limit(0))
    base = base.select(F.col("query_id").alias("_q"), *[F.col(c).alias(f"b_{c}") for c in (*_LISTS, "weekday_daytime", "salary_minimum")], _query(base).alias("b_query"))
    j = intents.join(base, F.col("query_id") == F.col("_q"), "left")
    old = lambda c: F.coalesce(F.col(f"b_{c}"), _none())
    over = lambda c: F.when(F.size(_list(intents, c)) > 0, _list(intents, c)).otherwise(old(c))
    avoid, hold = _list(intents, "exclude_keywords"), _list(intents, "include_keywords")

    def named(w: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, name in reversed(AVOIDED):
            out = F.when(w.rlike(p), F.lit(name)).otherwise(out)
        return out

    summary = F.coalesce(F.col("summary"), F.lit("")) if "summary" in intents.columns else F.lit("")
    says_day = F.concat_ws(" ", summary, F.array_join(hold, " ")).rlike(DAYTIME_WORDS)
    level = F.create_map(*[F.lit(x) for k, v in LEVELS.items() for x in (k, v)])[F.coalesce("experience_level", F.lit("any"))]
    query = _query(intents)
    return normalize_criteria(
        j.select(
            "query_id", F.when(query != "", query).otherwise(F.coalesce("b_query", F.lit(""))).alias("query"), over("role_tags").alias("role_tags"), old("qualifications").alias("qualifications"), over("regions").alias("regions"),
            (says_day | F.coalesce("b_weekday_daytime", F.lit(True))).alias("weekday_daytime"), over("employment_types").alias("employment_types"),
            F.when(level.isNotNull(), F.array(level)).otherwise(old("experience_levels")).alias("experience_levels"), F.col("b_salary_minimum").alias("salary_minimum"),
            F.concat(old("keywords"), hold).alias("keywords"), F.concat(old("excluded_patterns"), F.array_compact(F.transform(avoid, named))).alias("excluded_patterns"),
            F.concat(old("excluded_keywords"), F.filter(avoid, lambda w: named(w).isNull())).alias("excluded_keywords"),
        )
    )


def criteria_to_filters(criteria: DataFrame) -> DataFrame:
    """Criteria as the filters of a list: a single wish of a kind is its filter, else ``전체``."""
    c = normalize_criteria(criteria)
    one = lambda col: F.when(F.size(col) == 1, F.get(F.col(col), F.lit(0))).otherwise(ANY)
    return c.select(
        "query_id", _query(c).alias("query"), one("regions").alias("region"), one("employment_types").alias("employment"), one("experience_levels").alias("experience"),
        F.when(F.col("weekday_daytime"), DAYTIME_FILTER).otherwise(ANY).alias("work_pattern"),
    )
