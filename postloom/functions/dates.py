"""Dates of listings: published, deadline and what follows from them. Every function takes its own ``now``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, meaningful

TZ = "Asia/Seoul"
# The notations of dates that listings use.
_FULL = r"(?:^|\D)((?:19|20)\d{2})\s*(?:[./-]|년\s*)\s*(\d{1,2})\s*(?:[./-]|월\s*)\s*(\d{1,2})(?:\s*일)?"
_ISO = r"^(?:19|20)\d{2}-\d{2}-\d{2}\z"
_SHORT_YEAR = r"(?:^|\D)(\d{2})\s*[./-]\s*(\d{1,2})\s*[./-]\s*(\d{1,2})(?:\D|$)"
_MONTH_DAY = r"(?:^|[^\d])([01]?\d)\s*[./-]\s*([0-3]?\d)(?:\D|$)"


def local_day(ts: Column, tz: str = TZ) -> Column:
    """The calendar day of an instant. The session's time zone is taken as UTC."""
    return F.to_date(F.from_utc_timestamp(ts, tz))


def real_date(year: Column, month: Column, day: Column) -> Column:
    """The date, or null if the calendar has none."""
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month.try_cast("int"), day.try_cast("int"))
    return F.try_to_date(text, "yyyy-MM-dd")


def _group(text: Column, pattern: str, i: int) -> Column:
    return F.regexp_extract(text, pattern, i)


def _dated(text: Column, month_day: Column) -> Column:
    """The date that a full, short-year or month-and-day notation gives; a full one that is no date gives none."""
    full = real_date(*[_group(text, _FULL, i) for i in (1, 2, 3)])
    short = real_date(F.concat(F.lit("20"), _group(text, _SHORT_YEAR, 1)), _group(text, _SHORT_YEAR, 2), _group(text, _SHORT_YEAR, 3))
    return F.when(text.rlike(_FULL), full).when(text.rlike(_SHORT_YEAR), short).when(text.rlike(_MONTH_DAY), month_day)


def _iso_or(raw: Column, found: str, other: Column) -> Column:
    """(date, kind) of a plain ISO date, read as such: no other notation fits it; else ``other``."""
    raw = raw.cast("string")
    date = raw.try_cast("date")
    return F.when(raw.rlike(_ISO), F.struct(date.alias("date"), F.when(date.isNotNull(), found).otherwise("unknown").alias("kind"))).otherwise(other)


def _in_year(text: Column, year: Column) -> Column:
    return real_date(year.cast("string"), _group(text, _MONTH_DAY, 1), _group(text, _MONTH_DAY, 2))


def parse_published(raw: Column, observed: Column, *, tz: str = TZ, compose: bool = False) -> Column:
    """(date, kind). Relative words count from the day of observation; a month and day lie at most 7 days ahead, else a year back."""

    def read(text: Column, today: Column) -> Column:
        ago = -_group(text, r"(\d+)\s*일\s*전", 1).try_cast("int")
        days = F.when(text.rlike("그제|그저께"), -2).when(text.rlike("어제"), -1).when(text.rlike(r"오늘|방금|\d+\s*(?:분|시간)\s*전"), 0).otherwise(ago)
        late = lambda this: F.when(this > F.date_add(today, 7), _in_year(text, F.year(today) - 1)).otherwise(this)
        stamp = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T"), local_day(F.try_to_timestamp(text), tz))
        date = F.coalesce(stamp, _dated(text, let(_in_year(text, F.year(today)), late)))
        relative = lambda days: F.struct(F.date_add(today, days).alias("date"), F.lit("relative").alias("kind"))
        explicit = lambda date: F.struct(date.alias("date"), F.when(date.isNotNull(), "explicit").otherwise("unknown").alias("kind"))
        return let(days, lambda days: F.when(days.isNotNull(), relative(days)).otherwise(let(date, explicit)))

    return _iso_or(raw, "explicit", let(meaningful(raw, compose=compose), lambda text: let(local_day(observed, tz), lambda today: read(text, today))))


def parse_deadline(raw: Column, observed: Column, *, tz: str = TZ, compose: bool = False) -> Column:
    """(date, kind): always open, until filled, fixed or unknown; a month and day lie within 180 days."""

    def read(text: Column, today: Column) -> Column:
        left = _group(text, r"(?i)D\s*-\s*(\d+)", 1).try_cast("int")
        days = F.when(text.rlike("오늘"), 0).when(text.rlike("내일"), 1).otherwise(left)
        last, following = _in_year(text, F.year(today) - 1), _in_year(text, F.year(today) + 1)
        near = lambda this: F.when(this < F.date_sub(today, 180), following).when(this > F.date_add(today, 180), last).otherwise(this)
        open_kind = F.when(text.contains("상시"), "always").when(text.rlike(r"채용\s*시"), "until-filled")
        date = F.coalesce(F.date_add(today, days), _dated(text, let(_in_year(text, F.year(today)), near)))
        opened = lambda kind: F.struct(F.lit(None).cast("date").alias("date"), kind.alias("kind"))
        dated = lambda date: F.struct(date.alias("date"), F.when(date.isNotNull(), "fixed").otherwise("unknown").alias("kind"))
        return let(open_kind, lambda kind: F.when(kind.isNotNull(), opened(kind)).otherwise(let(date, dated)))

    return _iso_or(raw, "fixed", let(meaningful(raw, compose=compose), lambda text: let(local_day(observed, tz), lambda today: read(text, today))))


def deadline_state(date: Column, kind: Column, today: Column, *, soon: int = 3) -> Column:
    """P10: (status, days): expired, today, closing-soon, upcoming, open or unknown."""
    days = F.datediff(date, today)
    dated = F.when(days < 0, "expired").when(days == 0, "today").when(days <= soon, "closing-soon").otherwise("upcoming")
    return F.struct(F.when(date.isNotNull(), dated).when(kind.isin("always", "until-filled"), "open").otherwise("unknown").alias("status"), days.alias("days"))


def deadline_label(date: Column, text: Column, today: Column) -> Column:
    """The second vocabulary: closed, today, soon, open, rolling, unknown."""
    days = F.datediff(date, today)
    return F.when(text.rlike("마감됨|접수마감|채용완료|모집완료"), "closed").when(text.rlike("상시|수시|채용시"), "rolling").when(days < 0, "closed").when(days == 0, "today").when(days <= 7, "soon").when(days.isNotNull(), "open").otherwise("unknown")


def days_until(text: Column, at: Column, now: Column) -> Column:
    """``D-n`` of the text, else elapsed days up to the instant, begun ones counted whole."""
    named = F.regexp_extract(text, r"(?i)D\s*-\s*(\d+)", 1).try_cast("int")
    return F.coalesce(named, F.ceil((F.unix_timestamp(at) - F.unix_timestamp(now)) / 86400).cast("int"))


def strict_iso(c: Column) -> Column:
    """The instant of a real date or a zoned timestamp; anything else is null."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(c))


def next_run(now: Column, slots: tuple[str, ...] = ("09:00", "12:00", "18:00"), tz: str = TZ) -> Column:
    """The next of the daily slots after an instant, as an instant."""
    local = F.from_utc_timestamp(now, tz)
    at = [F.to_timestamp(F.concat(F.date_format(F.date_add(F.to_date(local), d), "yyyy-MM-dd"), F.lit(f" {s}:00"))) for d in (0, 1) for s in sorted(set(slots))]
    return F.to_utc_timestamp(F.array_min(F.filter(F.array(*at), lambda x: x > local)), tz)


def listing_age(published: Column, first_seen: Column, today: Column) -> Column:
    """Whole days since publication, else since first seen."""
    return F.datediff(today, F.coalesce(published, first_seen))


def freshness(age: Column) -> Column:
    """New up to 3 days, recent up to 14, else stale."""
    return F.when(age.isNull(), "unknown").when(age <= 3, "new").when(age <= 14, "recent").otherwise("stale")


def age_penalty(age: Column) -> Column:
    """Points that the recommended order takes off."""
    return F.when(age.isNull() | (age <= 7), 0).when(age <= 14, 2).when(age <= 28, 5).otherwise(9)
