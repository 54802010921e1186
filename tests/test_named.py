"""Functions that no query reaches."""

import datetime as dt

from pyspark.sql import functions as F

from postloom.functions import text
from postloom.operators import classify, incremental, match, resolve, sections, select, trust, userstate

NOW = dt.datetime(2026, 7, 11, 9)


def values(df, *cols):
    return [r[0] if len(r) == 1 else tuple(r) for r in df.select(*cols).collect()]


def test_places_excerpts_and_title_facts(spark):
    df = spark.createDataFrame([("서울 강남구 역삼동",), ("경기 성남시",), ("원문 확인",), (None,)], "t string")
    got = values(df, text.location_parts(F.col("t")))
    assert [(x and (x["region"], x["district"])) for x in got] == [("서울", "강남구"), ("경기", "성남시"), (None, None), (None, None)]
    long = spark.createDataFrame([("가" * 300 + "표적" + "나" * 300,), ("짧은 표적",), ("없음",), (None,)], "t string")
    got = values(long, text.excerpt_around(F.col("t"), "표적"))
    assert got[0].startswith("…") and got[0].endswith("…") and "표적" in got[0] and len(got[0]) <= 142 and got[1:] == ["짧은 표적", None, None]
    facts = values(spark.createDataFrame([("계약직 간호사 3명 (09:00~18:00)",), ("간호사",)], "t string"), text.split_title_facts(F.col("t")))
    assert (facts[0]["employment"], facts[0]["hours"], facts[0]["headcount"]) == ("계약직", "09:00~18:00", 3) and facts[1]["headcount"] is None


def test_filters_of_employment_title_and_closing(spark):
    df = spark.createDataFrame([("정규직",), ("비정규직",), ("계약직",), (None,), ("-",)], "e string")
    keep = lambda wanted: values(df, select.employment_match(F.col("e"), wanted))
    assert keep("정규직") == [True, False, False, False, False] and keep("계약직") == [False, False, True, False, False]
    assert [bool(x) for x in keep("원문 확인")] == [False, False, False, True, True] and keep(select.ANY) == [True] * 5
    titles = spark.createDataFrame([("간호사 모집",), ("간호조무사 모집",), ("요리사",)], "t string")
    assert values(titles, select.title_keep(F.col("t"), "간호", "조무")) == [True, False, False] and values(titles, select.title_keep(F.col("t"), "간호")) == [True, True, False]
    day = NOW.date()
    rows = [("upcoming", None, None, day), ("expired", None, None, None), (None, "접수마감", None, None), (None, None, NOW - dt.timedelta(hours=1), None), (None, None, None, day - dt.timedelta(days=1)), (None, None, None, None)]
    closing = spark.createDataFrame(rows, "status string, receipt string, ends timestamp, deadline date")
    open_ = select.not_closed(*[F.col(c) for c in ("status", "receipt", "ends", "deadline")], F.lit(NOW), F.lit(day))
    assert values(closing, open_) == [True, False, False, False, False, True]


def test_budget_reviews_and_hidden_opportunities(spark):
    groups = spark.createDataFrame([(g, i) for g in (2, 1) for i in range(3)], "g int, i int")
    assert values(select.group_budget(groups, [F.col("g"), F.col("i")], 4), "g", "i") == [(1, 0), (1, 1), (1, 2), (2, 0)]
    kept, review = resolve.partition_review(spark.createDataFrame([(1, True), (2, False)], "i int, needs_review boolean"))
    assert values(kept, "i") == [2] and values(review, "i") == [1]
    rows = [(0, "B", "pa", "confirmed", None, None, 50), (1, "C", None, "likely", "외래", dt.date(2026, 8, 1), 60), (2, "S", "pa", "confirmed", None, None, 99), (3, "B", None, "unknown", None, None, 70)]
    df = spark.createDataFrame(rows, "ord int, tier string, care_role string, non_shift string, day_signal string, deadline_at date, tier_score int")
    got = classify.hidden_opportunities(df).collect()
    assert [r["ord"] for r in got] == [1, 0] and got[1]["reasons"] == ["PA·전담 직무 명시", "상근·주간 확인"]
    assert got[0]["cautions"] == ["근무표·교대 여부 원문 확인"] and got[1]["cautions"] == ["지원 마감일 확인"]


def test_ranks_of_matches(spark):
    rows = [(0, "confirmed", False, 3, 1, None), (1, "needs_review", False, 9, 0, None), (2, "confirmed", True, 1, 0, None), (3, "confirmed", False, 3, 0, None)]
    df = spark.createDataFrame(rows, "ord int, overall string, top_recommendation boolean, confirmed_count int, unknown_count int, published_at date")
    assert values(df.orderBy(*match.RANK_MATCH()), "ord") == [2, 3, 0, 1]


def test_sources_headings_and_times(spark):
    both = incremental.union_sources({"a": spark.createDataFrame([(1,)], "x int"), "b": spark.createDataFrame([(2, "y")], "x int, z string")})
    assert sorted(values(both, "source_entry_id", "x", "z"), key=str) == [("a", 1, None), ("b", 2, "y")]
    lines = spark.createDataFrame([("[담당 업무]",), ("- 자격요건:",), ("담당업무 안내",)], "line string")
    assert values(lines, sections.heading_key(F.col("line"), {"담당업무": "duties", "자격요건": "qualifications"})) == ["duties", "qualifications", None]
    t = lambda **k: NOW + dt.timedelta(**k)
    times = spark.createDataFrame([(1, t(days=-6)), (2, t(days=-8)), (3, t(minutes=4)), (4, t(minutes=6)), (5, None)], "i int, at timestamp")
    assert sorted(values(userstate.valid_times(times, "at", now=F.lit(NOW)), "i")) == [1, 3]
    runs = spark.createDataFrame([(t(hours=1), t(hours=2), False), (t(hours=-1), t(hours=2), False), (t(hours=1), t(hours=2), True), (None, None, False)], "s timestamp, c timestamp, p boolean")
    assert values(runs, trust.refresh_complete(F.col("s"), F.col("c"), F.lit(NOW), F.col("p"))) == [True, False, False, False]


def test_keys_snapshots_and_legacy(spark):
    snaps = spark.createDataFrame([("u", 1, "i1", "d1", "k1"), ("u", 2, "i2", None, "k2"), ("v", 3, "i1", "d9", "k9")], "user_id string, ord int, id string, dedupe_key string, job_key string")
    keys = spark.createDataFrame([("u", "d1"), ("u", "lost")], "user_id string, job_key string")
    assert sorted(values(userstate.resolve_alias(keys, snaps), "job_key", "alias")) == [("d1", "d1"), ("d1", "i1"), ("d1", "k1"), ("lost", "lost")]
    saved = spark.createDataFrame([("d1", "x", "old"), ("dx", "i2", "old"), ("dy", "iy", "old")], "dedupe_key string, id string, title string")
    live = spark.createDataFrame([(0, "d1", "i1", "new1"), (1, "d2", "i2", "new2"), (2, "d1", "i9", "later")], "ord int, dedupe_key string, id string, title string")
    got = userstate.resolve_snapshots(saved, live, fields=["title"])
    assert sorted(values(got, "dedupe_key", "title", "is_live")) == [("d1", "new1", True), ("dx", "new2", True), ("dy", "old", False)]
    local, remote = spark.createDataFrame([("a", "mine"), ("b", "mine")], "job_key string, v string"), spark.createDataFrame([("a", "theirs"), ("c", "theirs")], "job_key string, v string")
    apps = spark.createDataFrame([("a",)], "job_key string")
    assert sorted(values(userstate.replace_keep_protected(local, remote, apps), "job_key", "v")) == [("a", "mine"), ("c", "theirs")]
    ids = spark.createDataFrame([("i1",), ("gone",)], "id string")
    known, pending = userstate.overlay_legacy(ids, live)
    assert values(known, "title") == ["new1"] and values(pending, "id") == ["gone"]


def test_remembered_details(spark):
    schema = "entry string, ids array<string>, urls array<string>, checked_at int, experience string"
    cache = spark.createDataFrame([("e", ["a"], ["u"], 1, "old"), ("f", ["b"], [], 2, "other")], schema)
    new = spark.createDataFrame([("e", ["c"], [], 5, "new"), ("g", ["d"], [], 6, "unproved")], schema).withColumn("verified", F.col("entry") == "e")
    got = {r["entry"]: r for r in sections.remember_enrichment(cache, new).collect()}
    assert set(got) == {"e", "f"} and got["e"]["ids"] == ["a", "c"] and got["e"]["experience"] == "new"
    assert [r["entry"] for r in sections.remember_enrichment(cache, new, keep=1).collect()] == ["e"]


def test_source_registry(spark):
    from postloom.sources import registry

    r = registry.registry(spark)
    assert {x["mode"]: x["count"] for x in r.groupBy("mode").count().collect()} == {"auto": 33, "bridge": 1, "link": 6}
    assert r.where("name is null or not url like 'https://%'").count() == 0 and r.select("source_id").distinct().count() == 40
    df = spark.createDataFrame([("직행",), ("New Board",), (None,)], "source string")
    assert values(registry.with_source(df), "source_id", "source_mode") == [("zighang", "auto"), ("new board", "link"), (None, "link")]
