"""Cleaning, keys and small facts of listing text, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers count it; Java's own class is narrower.
WS = r"[\s\x0B   -     　﻿]"

# What stands for "unknown" in the four contexts that have it.
UNKNOWN = {
    "listing": r"^(?:|[-·]|(?:경력|지역|고용형태)?\s*미표기|원문\s*확인|공고\s*확인|정보\s*확인)$",
    "display": r"^(?:|-|미표기|경력 미표기|지역 미표기|원문 확인|정보 확인)$",
    "match": r"^(?:|-|·|미표기|원문\s*확인|정보\s*확인|확인\s*필요)$",
    "detail": r"^(?:|-|·|미표기|원문\s*(?:공고)?\s*확인|공고\s*확인|정보\s*확인|협의)$",
}
LEGAL_MARKS = r"\(\s*(?:주|재|사|학|의)\s*\)|㈜"
LEGAL_NAMES = "주식회사|유한회사|의료법인|재단법인|사단법인|사회복지법인|학교법인"
HIRING_WORDS = "채용공고|모집공고|채용|모집|구인|영입|공개"
PLACEHOLDER_COMPANY = "등록기관|기관정보확인"
REGIONS = (("서울", "11"), ("부산", "26"), ("대구", "27"), ("인천", "28"), ("광주", "29"), ("대전", "30"), ("울산", "31"), ("세종", "36"), ("경기", "41"), ("강원", "51"), ("충북", "43"), ("충남", "44"), ("전북", "52"), ("전남", "46"), ("경북", "47"), ("경남", "48"), ("제주", "50"))
METRO = ("서울", "경기", "인천")
REMOTE = r"(?i)재택|원격|리모트|remote|자율\s*근무"
EMPLOYMENT = (("정규직", "정규직"), ("계약직|촉탁직|파견직", "계약직"), ("기간제", "기간제"), ("시간제|파트타임|아르바이트", "시간제"), ("인턴", "인턴"), ("일용", "일용직"))


def _composed(text: pa.Array) -> pa.Array:
    return pa.array([t if t is None or t.isascii() else unicodedata.normalize("NFKC", t) for t in text.to_pylist()], pa.string())


def nfkc(c: Column) -> Column:
    """Unicode compatibility composition; Spark SQL has no function for it."""
    return F.arrow_udf(_composed, "string")(c)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often ``use`` names it; branches would work it out each again."""
    return F.transform(F.array(value), use)[0]


def clean_text(c: Column, *, compose: bool = True) -> Column:
    """Composed, without zero-width characters, white space squeezed and trimmed; null becomes empty.

    The other functions take text that is composed already, unless told otherwise: a Python function can't run inside the
    lambdas that some of them use.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    c = F.regexp_replace(nfkc(c) if compose else c, "[​﻿]", "")
    return F.trim(F.regexp_replace(c, WS + "+", " "))


def meaningful(c: Column, preset: str = "listing", *, compose: bool = False) -> Column:
    """The cleaned text, or null where it says nothing."""
    return let(clean_text(c, compose=compose), lambda text: F.when(~text.rlike(UNKNOWN[preset]), text))


def compact_key(c: Column, *, compose: bool = False) -> Column:
    """Lower case letters and digits only."""
    return F.regexp_replace(F.lower(clean_text(c, compose=compose)), r"[^\p{L}\p{N}]+", "")


def without_legal(clean: Column) -> Column:
    """A cleaned company name without its legal form."""
    return F.regexp_replace(F.regexp_replace(clean, LEGAL_MARKS, " "), f"(?:{LEGAL_NAMES}|법인)", " ")


def company_tokens(c: Column, *, compose: bool = False) -> Column:
    """The sorted tokens of a company name without its legal form."""
    return tokens_of(without_legal(clean_text(c, compose=compose)))


def tokens_of(bare: Column) -> Column:
    """The sorted tokens of a name that :func:`without_legal` gave."""
    tokens = F.split(bare, r"[\s·,./()\[\]|]+")
    return F.array_sort(F.filter(F.transform(tokens, lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")), lambda t: t != ""))


def company_key(c: Column, *, compose: bool = False) -> Column:
    """One key for a name whatever the order of its words."""
    return F.array_join(company_tokens(c, compose=compose), "")


def company_compact_key(c: Column, *, compose: bool = False) -> Column:
    """P5: one key for a name whatever its spacing."""
    return compact_of(without_legal(clean_text(c, compose=compose)))


def compact_of(bare: Column) -> Column:
    """P5, of a name that :func:`without_legal` gave."""
    return F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", "")


def title_key(title: Column, company: Column, *, compose: bool = False) -> Column:
    """The title without notice words, date ranges, legal forms and the company's own name (unless nothing else is left)."""
    return title_key_of(clean_text(title, compose=compose), company_tokens(company, compose=compose))


def title_key_of(clean: Column, tokens: Column) -> Column:
    """P6 from a cleaned title and the tokens of the company; words of Hangul are looked for only in titles that have some."""
    t = F.regexp_replace(clean, r"^새로운\s*글\s*", "")
    t = F.regexp_replace(t, r"\(\s*\d{1,2}\s*[./-]\s*\d{1,2}\s*[~∼-]\s*\d{1,2}\s*[./-]\s*\d{1,2}\s*\)", "")
    t = F.regexp_replace(t, r"\(\s*주\s*\)|㈜", "")
    t = F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+", "")

    def bare_of(t: Column) -> Column:
        for pattern, to in ((LEGAL_NAMES, ""), ("촉탁직", "촉탁"), ("신입경력|경력무관", ""), (HIRING_WORDS, ""), ("채$", "")):
            t = F.regexp_replace(t, pattern, to)
        return t

    own = F.filter(tokens, lambda x: F.length(x) > 1)
    without = lambda t: F.aggregate(own, t, lambda acc, x: F.replace(acc, x, F.lit("")))
    plain = let(t, lambda t: F.when(t.rlike("[가-힣]"), bare_of(t)).otherwise(t))
    return let(plain, lambda t: let(without(t), lambda bare: F.when(bare != "", bare).otherwise(t)))


def dedupe_key(company: Column, title: Column, source: Column, row_id: Column, *, compose: bool = False) -> Column:
    """Company and title, or source and id where the company is only a placeholder."""
    clean = lambda c: clean_text(c, compose=compose)
    c, t = company_key(company, compose=compose), title_key(title, company, compose=compose)
    return let(c, lambda c: let(t, lambda t: key_of(c, t, clean(source), clean(row_id)))) if not compose else key_of(c, t, clean(source), clean(row_id))


def key_of(company_key: Column, title_key: Column, source: Column, row_id: Column) -> Column:
    """P7 from keys and cleaned text."""
    own = F.concat_ws(":", F.lit("source"), source, row_id)
    nameless = (company_key == "") | (title_key == "") | company_key.rlike(PLACEHOLDER_COMPANY)
    return F.when(nameless, own).otherwise(F.concat_ws(":", company_key, title_key))


def dedupe_keys(company: Column, title: Column, *, compose: bool = False) -> Column:
    """All keys under which a row may meet another: both forms of the company with the title."""
    names = company_key(company, compose=compose), company_compact_key(company, compose=compose)
    return keys_of(*names, title_key(title, company, compose=compose))


def keys_of(company_key: Column, compact_key: Column, title_key: Column) -> Column:
    """All keys, from the parts."""
    known = lambda c: (c != "") & ~c.rlike(PLACEHOLDER_COMPANY)
    names = F.filter(F.array_distinct(F.array(company_key, compact_key)), known)
    none = F.array().cast("array<string>")
    return let(title_key, lambda t: F.when(t == "", none).otherwise(F.transform(names, lambda c: F.concat_ws(":", c, t))))


def first_label(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The value of the first pattern that the text holds, else null."""
    return F.coalesce(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules])


def all_labels(text: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Distinct values of all patterns that the text holds, in order of the rules."""
    return F.array_distinct(F.array_compact(F.array(*[F.when(text.rlike(p), F.lit(v)) for p, v in rules])))


def region_code(c: Column, *, compose: bool = False) -> Column:
    """The code of the first region in list order that the text names."""
    return let(meaningful(c, compose=compose), lambda text: first_label(text, REGIONS))


def region_info(region: Column, title: Column, code: Column | None = None) -> Column:
    """The region's name by code, else the first one that the text names; whether work is remote; whether the region is metropolitan."""
    named = F.nullif(F.regexp_extract(F.coalesce(region, F.lit("")), "|".join(n for n, _ in REGIONS), 0), F.lit(""))
    by_code = F.create_map(*[F.lit(x) for n, c in REGIONS for x in (c, n)])[code] if code is not None else None
    group = named if by_code is None else F.coalesce(by_code, named)
    remote = F.concat_ws(" ", region, title).rlike(REMOTE)
    return let(group, lambda g: F.struct(g.alias("region_group"), remote.alias("is_remote"), F.coalesce(g.isin(*METRO), F.lit(False)).alias("is_metro")))


def location_parts(c: Column, *, compose: bool = False) -> Column:
    """(text, region, district)."""
    text = meaningful(c, "match", compose=compose)
    district = F.regexp_extract(text, r"([가-힣]{1,10}(?:시|구|군))(?:\s|$)", 1)
    return F.struct(text.alias("text"), first_label(text, [(n, n) for n, _ in REGIONS]).alias("region"), F.when(district != "", district).alias("district"))


def employment_type(c: Column, *, strict_regular: bool = False, compose: bool = False) -> Column:
    """Labels joined by a dot, else the text itself. Unless strict, a text with 비정규직 counts as 정규직 too."""
    rules = [(("(?<!비)정규직" if strict_regular else p) if v == "정규직" else p, v) for p, v in EMPLOYMENT]
    said = lambda text: let(all_labels(text, rules), lambda found: F.when(F.size(found) > 0, F.array_join(found, "·")).otherwise(text))
    return let(meaningful(c, compose=compose), said)


def employment_display(*fields: Column, compose: bool = False) -> Column:
    """All values of the fields without unknown ones and those that are a part of a longer one."""
    parts = F.flatten(F.array(*[F.split(F.coalesce(meaningful(f, "display", compose=compose), F.lit("")), r"\s*[·,/]\s*") for f in fields]))
    values = F.array_distinct(F.filter(parts, lambda x: x != ""))
    return F.array_join(F.filter(values, lambda x: ~F.exists(values, lambda y: (y != x) & y.contains(x))), "·")


def experience_level(c: Column, *, compose: bool = False) -> Column:
    """Open to all, newcomer, experienced, or the text itself."""
    either, none, some = r"경력\s*무관|신입\s*·?\s*경력|신입\s*/\s*경력", "신입|졸업예정", r"경력|\d+\s*년"
    level = lambda text: F.when(text.rlike(either), "경력무관").when(text.rlike(none), "신입").when(text.rlike(some), "경력").otherwise(text)
    return let(meaningful(c, compose=compose), level)


def years_required(c: Column) -> Column:
    """P20: the largest number of years named, up to 20."""
    years = F.transform(F.regexp_extract_all(c, F.lit(r"(?<!\d)(\d{1,2})\s*년"), F.lit(1)), lambda y: y.try_cast("int"))
    return F.array_max(F.filter(years, lambda y: y <= 20))


def salary_range(c: Column) -> Column:
    """(minimum, maximum, unit) in won; an amount in 만원 counts ten thousand, unit is year, month or hour."""
    text = F.regexp_replace(c, ",", "")
    amounts = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?\s*만?\s*원)"), F.lit(1)), lambda a: (F.regexp_extract(a, r"(\d+(?:\.\d+)?)", 1).try_cast("double") * F.when(a.contains("만"), 10_000).otherwise(1)).cast("long"))
    unit = F.when(text.rlike("시급|시간당"), "hour").when(text.rlike("월급|월\\s|월\\d|월$"), "month").when(text.rlike("연봉|연\\s|년"), "year")
    return F.struct(F.array_min(amounts).alias("minimum"), F.array_max(amounts).alias("maximum"), F.when(F.size(amounts) > 0, unit).alias("unit"))


def annual_salary(c: Column) -> Column:
    """Won a year of a monthly or yearly amount between 10 and 300 million."""
    s = salary_range(c)
    year = F.when(s["unit"] == "month", s["minimum"] * 12).when(s["unit"] == "year", s["minimum"])
    return F.when(year.between(10_000_000, 300_000_000), year)


def split_clauses(c: Column) -> Column:
    """The trimmed, non-empty clauses of a text."""
    parts = F.split(F.coalesce(c, F.lit("")), r"[\n\r]+|(?<=[.!?。])\s+|\s*[•▪■□◆◇○●※]\s*|;\s*")
    return F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: p != "")


def first_evidence(fields: Sequence[tuple[str, Column]], pattern: str, *, width: int = 140) -> Column:
    """(field, excerpt) of the first field that holds the pattern; the excerpt is centred on the match."""
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("field"), F.coalesce(c, F.lit("")).alias("value")) for n, c in fields]), lambda x: x["value"].rlike(pattern))
    return F.transform(F.slice(found, 1, 1), lambda x: F.struct(x["field"].alias("field"), excerpt_around(x["value"], pattern, width).alias("excerpt")))[0]


def excerpt_around(text: Column, pattern: str, width: int = 140) -> Column:
    """P25: up to ``width`` characters around the first match, with an ellipsis where text is left out."""
    at = F.regexp_instr(text, F.lit(pattern))
    start = F.greatest(F.lit(1), F.least(at - width // 3, F.length(text) - width + 1))
    body = F.trim(F.substring(text, start, F.lit(width)))
    whole = F.concat(F.when(start > 1, "…").otherwise(""), body, F.when(start + width - 1 < F.length(text), "…").otherwise(""))
    return F.when(at == 0, F.lit(None).cast("string")).when(F.length(text) <= width, text).otherwise(whole)


def search_text(*columns: Column) -> Column:
    """All given columns in lower case, joined by spaces."""
    return F.lower(F.concat_ws(" ", *columns))


def fingerprint(c: Column, length: int = 500) -> Column:
    """What is left of a text in lower case without white space, punctuation and symbols, up to a length."""
    return F.substring(F.regexp_replace(F.lower(c), r"[\s\p{P}\p{S}]+", ""), 1, length)


def first_of(*columns: Column) -> Column:
    """The first value that isn't null or blank."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns])


def bounded(c: Column, low: float, high: float, kind: str = "double") -> Column:
    """The value as a number if it lies in the bounds, else null."""
    v = c.try_cast(kind)
    return F.when(v.between(low, high), v)


def split_title_facts(title: Column) -> Column:
    """Employment, working hours and headcount that a title or text names."""
    hours = F.regexp_extract(title, r"(\d{1,2}:\d{2}\s*[~-]\s*\d{1,2}:\d{2})", 1)
    count = F.regexp_extract(title, r"(?<!\d)(\d{1,3})\s*명", 1)
    return F.struct(F.array_join(all_labels(title, EMPLOYMENT), "·").alias("employment"), F.nullif(hours, F.lit("")).alias("hours"), count.try_cast("int").alias("headcount"))


def undo_negations(text: Column, scrubs: Sequence[str]) -> Column:
    """The text with each scrub pattern taken out, in order, before positive tests."""
    for s in scrubs:
        text = F.regexp_replace(text, s, " ")
    return text
