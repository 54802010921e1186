"""Why a posting is recommended to a profile: reasons, what is missing, what is ruled out, what to check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import js
from .match import ROLE_WORDS

# Labels, what speaks against clinical work, and what texts say of work patterns.
ROLE_LABELS = {"health-manager": "보건관리자", "occupational-nurse": "산업간호사", "clinical-nurse": "임상 간호사"}
NOT_CLINICAL = r"(?i)보건\s*관리(?:자|직|담당)?|산업\s*(?:간호|보건)|사업장\s*간호|건강\s*관리실|보험\s*심사|심사\s*(?:평가\s*)?간호|적정\s*진료|손해\s*사정|health[-_ ]manager|occupational[-_ ]nurse|insurance[-_ ](?:review|claims)"
UNKNOWN = "원문 확인"
PATTERNS = {"상근·주간": r"(?i)상근|주간근무|주간 전담|데이 전담|d[-_ ]?keep|day 근무", "2교대": r"2\s*교대|이교대", "3교대": r"3\s*교대|삼교대", "야간전담": r"야간전담|나이트전담|night only"}
DENIED = r"\s*(?:없|제외|안\s*함|하지\s*않)"
DENIALS = {"2교대": rf"(?:2\s*교대|이교대)(?:\s*근무)?{DENIED}", "3교대": rf"(?:3\s*교대|삼교대)(?:\s*근무)?{DENIED}", "야간": rf"(?:야간|나이트|night)(?:\s*(?:전담|근무))?{DENIED}", "교대": rf"(?:교대근무|교대)(?:\s*근무)?{DENIED}"}
CONSTRAINTS = (("3교대", r"3\s*교대|삼교대"), ("2교대", r"2\s*교대|이교대"), ("야간", r"야간|나이트|night"), ("교대", r"교대"))
CONFLICTS = {"야간": (("3교대", "야간전담"), r"야간|나이트|night"), "교대": (("2교대", "3교대", "야간전담"), r"(?:2|3)\s*교대|이교대|삼교대|야간전담"), "3교대": (("3교대",), PATTERNS["3교대"]), "2교대": (("2교대",), PATTERNS["2교대"])}
SHOWN = 4


def _by(value: Column, cases: dict[str, Column], other: Column) -> Column:
    out = other
    for k, c in cases.items():
        out = F.when(value == k, c).otherwise(out)
    return out


def _constraint(value: Column) -> Column:
    """The work that a word or wish is about, the first that fits; empty if none."""
    low, out = F.lower(value), F.lit("")
    for name, pattern in reversed(CONSTRAINTS):
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def _verdict(constraint: Column, known: Column, said: Column) -> Column:
    """What a posting is to someone who avoids a kind of work: ``denies`` it, has it (``conflict``), has another pattern (``avoids``), or ``unclear``."""
    no = F.lit(False)
    denies = _by(constraint, {k: said.rlike(p) for k, p in DENIALS.items()}, no)
    conflict = _by(constraint, {k: known.isin(*names) | said.rlike(p) for k, (names, p) in CONFLICTS.items()}, no)
    other = _by(constraint, {"3교대": known != "3교대", "2교대": known != "2교대", "야간": known == "상근·주간", "교대": known == "상근·주간"}, no)
    return F.when(denies, "denies").when(conflict, "conflict").when(other & (known != UNKNOWN), "avoids").otherwise("unclear")


def explained(pairs: DataFrame) -> DataFrame:
    """C17: pairs of a posting and a profile (its columns as q_...) with level, reasons, missing, excluded and cautions.

    Postings have search_text (lower case), role_tags, region, employment and experience (as displayed), work_pattern and needs_review;
    profiles role_tags, regions, employment_types, experience_levels, keywords, work_patterns and excluded_keywords. Nulls are
    unknown or not asked. At most four reasons are shown, those of avoided work first. Pairs come from any join, such as
    the index over stored queries.
    """
    none = F.array().cast("array<string>")
    q = lambda c: F.coalesce(F.col(f"q_{c}"), none) if f"q_{c}" in pairs.columns else none
    text, tags = F.coalesce(F.col("search_text"), F.lit("")), F.coalesce(F.col("role_tags"), none)
    shown = lambda c: F.coalesce(F.nullif(F.trim(F.col(c)), F.lit("")), F.lit(UNKNOWN))
    region, employment, experience, known = shown("region"), shown("employment"), shown("experience"), shown("work_pattern")
    evidence = F.concat_ws(" ", F.array_join(tags, " "), text)
    office = evidence.rlike(js(NOT_CLINICAL))
    label = lambda r: _by(r, {k: F.lit(v) for k, v in ROLE_LABELS.items()}, r)
    names = lambda r: _by(r, {k: evidence.rlike(js(p)) for k, p in ROLE_WORDS.items()}, F.lit(False))
    fits = lambda r: ~((r == "clinical-nurse") & office) & (F.array_contains(tags, r) | names(r) | text.contains(F.lower(label(r))))
    roles = F.filter(q("role_tags"), fits)
    first = lambda arr: F.get(arr, F.lit(0))
    places = F.filter(q("regions"), lambda r: region.contains(r))
    kinds = F.filter(q("employment_types"), lambda e: F.when(e == UNKNOWN, employment == UNKNOWN).when(employment == UNKNOWN, e == "전체").when(e == "정규직", employment.rlike("(?<!비)정규직")).otherwise(employment.contains(e)))
    levels = F.filter(q("experience_levels"), lambda v: experience.contains(v) | ((v == "신입·무관") & experience.rlike("신입|무관")))
    liked = F.slice(F.filter(q("keywords"), lambda k: text.contains(F.lower(k))), 1, 2)
    said = F.concat(F.lower(F.coalesce("work_pattern", F.lit(""))), F.lit(" "), text)
    item = lambda reason=None, out=None, caution=None: F.struct(F.lit(reason).cast("string").alias("reason") if not isinstance(reason, Column) else reason.alias("reason"), F.lit(out).cast("string").alias("out") if not isinstance(out, Column) else out.alias("out"), F.lit(caution).cast("string").alias("caution"))
    check = item(caution="근무형태 확인 필요")

    def avoided(constraint: Column, reason: Column, out: Column) -> Column:
        verdict = _verdict(constraint, known, said)
        return F.when(verdict.isin("denies", "avoids"), item(reason)).when(verdict == "conflict", item(None, out)).otherwise(check)

    def wished(p: Column) -> Column:
        blocked = F.lower(F.regexp_replace(p, r"\s*제외$", ""))
        has = _by(p, {k: said.rlike(js(v)) for k, v in PATTERNS.items()}, F.lit(False)) | (known == p)
        unsure = p.isin(*PATTERNS) & (known == UNKNOWN)
        return F.when(p.endswith("제외"), F.when(_constraint(blocked) != "", avoided(_constraint(blocked), p, blocked))).when(has, item(p)).when(unsure, check)

    def barred(k: Column) -> Column:
        plain = F.when(text.contains(F.lower(k)), item(None, k)).otherwise(item(caution="제외 조건 여부 확인 필요"))
        return F.when(_constraint(k) != "", avoided(_constraint(k), F.concat(k, F.lit(" 제외")), k)).otherwise(plain)

    work = F.array_compact(F.concat(F.transform(q("work_patterns"), wished), F.transform(F.filter(q("excluded_keywords"), lambda k: k != ""), barred)))
    some = lambda c: F.size(q(c)) > 0
    off = {
        "역할": (some("role_tags") & (F.size(roles) == 0), F.when(F.array_contains(q("role_tags"), "clinical-nurse") & office, "선택한 임상 역할과 다름")),
        "지역": (some("regions") & (F.size(places) == 0) & (region != UNKNOWN), F.lit("지역 조건과 다름")),
        "고용형태": (some("employment_types") & (F.size(kinds) == 0) & (employment != UNKNOWN), F.lit("고용형태 조건과 다름")),
    }
    p = pairs.withColumns({"_work": work, "_own": F.concat(F.array_compact(F.array(label(first(roles)), first(places), first(kinds), first(levels))), liked)})
    part = lambda f: F.array_distinct(F.array_compact(F.col(f"_work.{f}")))
    all_reasons = F.array_distinct(F.concat("_own", F.array_compact(F.col("_work.reason"))))
    n_reasons = F.size("_own") + F.size(F.array_compact(F.col("_work.reason")))
    ends = lambda r: r.endswith("제외")
    poor = sum((F.when(c != UNKNOWN, 1).otherwise(0) for c in (region, employment, experience)), F.lit(0)) < 2
    unsure = F.coalesce(F.col("needs_review"), F.lit(False)) | (F.size(tags) == 0) | poor
    good = (F.size(roles) > 0) & ((F.size(places) > 0) | ~some("regions")) & (n_reasons >= 2) & (F.size(part("out")) == 0)
    level = F.when(unsure | off["지역"][0] | off["고용형태"][0], "review").when(good, "strong").when((F.size(roles) == 0) | (F.size(part("out")) > 0), "review").otherwise("partial")
    return p.withColumns({
        "level": level, "reasons": F.slice(F.concat(F.filter(all_reasons, ends), F.filter(all_reasons, lambda r: ~ends(r))), 1, SHOWN),
        "missing": F.array_compact(F.array(*[F.when(miss, F.lit(name)) for name, (miss, _) in off.items()])), "excluded": part("out"),
        "cautions": F.array_distinct(F.concat(F.array_compact(F.array(*[F.when(miss, said_) for miss, said_ in off.values()])), part("caution"))),
    }).drop("_work", "_own")
