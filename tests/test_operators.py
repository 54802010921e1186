import datetime as dt
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from postloom.operators import classify, incremental, match, reputation, sections, select, trust, userstate
from postloom.operators.ranks import ordered_parts, prefix_sums



def TODAY():  # noqa: N802
    return F.lit("2026-07-11").cast("date")



def NOW():  # noqa: N802
    return F.lit("2026-07-11 00:00:00").cast("timestamp")



def test_prefix_sums(spark):
    df = spark.range(1000).selectExpr("id", "id % 7 AS g", "id % 13 AS v")
    order = [F.col("g"), F.col("id")]
    got = prefix_sums(ordered_parts(df, order, "t"), F.col("v"), order[1:], "before", ["g"]).toPandas()
    want = df.toPandas().sort_values(["g", "id"])
    want["before"] = want.groupby("g").v.cumsum() - want.v
    assert got.set_index("id").before.to_dict() == want.set_index("id").before.to_dict()


def test_interleave_head(spark):
    rows = [(f"snubh{i}", 0, "snubh", 90 - i) for i in range(3)] + [("ncc", 0, "ncc", 80), ("yuhs", 0, "yuhs", 70)] + [(f"feed{i}", 1, "feed", 99 - i) for i in range(100)] + [("general2", 1, "general", 60), ("feed0", 1, "feed", 99)]
    df = spark.createDataFrame([(*r, i, f"https://x/{r[0]}") for i, r in enumerate(rows)], "id string, g int, host string, score int, ord int, url string")
    got = [r["id"] for r in select.fair_interleave(df, "g", "host", "score", unique="url").orderBy("slot").collect()]
    assert got[:6] == ["snubh0", "ncc", "feed0", "yuhs", "snubh1", "general2"] and len(got) == 106 and got[6:9] == ["snubh2", "feed1", "feed2"]


def test_pages_cover_the_set(spark):
    df = spark.range(75).selectExpr("id AS ord", "id % 5 AS score")
    order = [F.desc("score"), F.asc("ord")]
    seen, offset = [], 0
    while True:
        page, meta = select.stable_page(df, order, offset, 24)
        seen += [r["ord"] for r in page.collect()]
        m = meta.first()
        assert m["total"] == 75
        if not m["has_more"]:
            break
        offset = m["next_offset"]
    assert seen == [r["ord"] for r in df.orderBy(*order).collect()]
    assert select.stable_page(df, order, 0, 900)[0].count() == 75 and select.stable_page(df, order, 0, 900)[1].first()["limit"] == 100
    with pytest.raises(ValueError):
        select.stable_page(df, order, -1, 5)


def test_filters(spark):
    rows = [(0, "서울 중구", "11", "정규직", "2026-07-12"), (1, "경기", "41", "비정규직", "2026-07-20"), (2, "부산", "26", None, "2026-07-01"), (3, None, None, "계약직", None)]
    df = spark.createDataFrame(rows, "ord int, region string, region_code string, employment_type string, d string").withColumns({"deadline_at": F.to_date("d"), "deadline": F.lit(""), "published_at": F.lit("2026-07-01").cast("date"), "first_seen_at": NOW(), "search_text": F.lit("icu nurse")})
    ids = lambda f: [r["ord"] for r in select.filter_postings(df, f, today=TODAY()).orderBy("ord").collect()]
    assert ids({"region": "서울·경기"}) == [0, 1] and ids({"employment": ["정규직"]}) == [0] and ids({"employment": "원문 확인"}) == [2] and ids({"deadline": "3일 이내"}) == [0]
    assert ids({"availability": "진행 중"}) == [0, 1, 3] and ids({"availability": "마감됨"}) == [2] and ids({"query": "ICU"}) == [0, 1, 2, 3] and ids({"region": "전체"}) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        ids({"colour": "red"})


def test_discovery(spark):
    df = spark.createDataFrame([(0, "a", ["x"], "2026-07-01"), (1, "b", [], "2026-07-05"), (2, "c", [], None), (3, "d", ["y"], "2026-07-09")], "ord int, id string, source_ids array<string>, t string").withColumn("first_seen_at", F.to_timestamp("t"))
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id string")
    since = F.lit("2026-07-05").cast("timestamp")
    rows, counts = select.discover(df, "new", since, ids("b"), ids("y"))
    assert rows.count() == 0 and counts.first().asDict() == {"new_count": 0, "unseen_count": 2, "all_count": 4, "applied_count": 1}
    assert sorted(r["ord"] for r in select.discover(df, "new", None, ids("b"), ids("y"))[0].collect()) == [0, 2]
    assert [r["ord"] for r in select.in_ids(df, ids("x", "d")).orderBy("ord").collect()] == [0, 3] and select.in_ids(df, ids("x"), anti=True).count() == 3


def test_trust(spark):
    runs = spark.createDataFrame([("a", "success", True), ("b", "error", False), ("c", "idle", False), ("d", "success", False)], "source_id string, status string, fresh boolean").withColumns({"name": F.col("source_id"), "external": F.lit(False), "last_success_at": F.when(F.col("source_id") != "c", NOW()), "last_attempt_at": NOW()})
    rows = spark.createDataFrame([("a",), ("b",), ("d",)], "source_entry_id string")
    s = trust.source_status(runs, rows, now=NOW())
    got = {r["source_id"]: (r["status"], r["data_origin"], r["freshness"]) for r in s.collect()}
    assert got == {"a": ("auto", "live", "fresh"), "b": ("stale", "fallback-cache", "fallback"), "c": ("pending", "none", "unavailable"), "d": ("auto", "cache", "cached")}
    links = spark.createDataFrame([(1, "a"), (1, "b"), (2, "d"), (3, "zz"), (4, "a")], "entity int, source_entry_id string")
    assert {r["entity"]: r["trust_state"] for r in trust.posting_trust(links, s).collect()} == {1: "mixed", 2: "cached", 3: "unknown", 4: "fresh"}
    posts = spark.createDataFrame([(False, "health"), (True, "clinical")], "needs_review boolean, category string")
    assert trust.snapshot_rollup(s, posts, raw_count=F.lit(3)).first()["trust_state"] == "partial"
    empty = trust.snapshot_rollup(s, posts.limit(0), raw_count=F.lit(0)).first()
    assert empty["trust_state"] == "unavailable" and empty["empty_reason"] == "no_results"


def test_runs_keep_what_failed(spark):
    s = "source_id string, id int"
    old, new = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], s), spark.createDataFrame([("a", 9), ("b", 8)], s)
    runs = spark.createDataFrame([("a", "success"), ("b", "error"), ("c", "success")], "source_id string, status string")
    assert sorted(tuple(r) for r in trust.carry_over(new, old, runs).collect()) == [("a", 9), ("b", 2), ("c", 3)]
    assert {r["source_id"]: r["status"] for r in trust.run_outcome(runs, new, old).collect()} == {"a": "success", "b": "error", "c": "needs_review"}


def test_pages_stop(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "b"), (2, 1, "c"), (3, 0, "a"), (4, 0, "z")], "page_no int, pos int, k string")
    assert sorted(r["k"] for r in incremental.merge_pages(rows, ["k"], stop_when_stale=True).collect()) == ["a", "b", "c"]
    assert incremental.merge_pages(rows, ["k"], keep="first").where("k = 'b'").first()["page_no"] == 1


def test_publish_and_read(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.range(10)
    assert incremental.read_published(spark, path) is None
    assert not incremental.publish(df.limit(0), path, version=1, day="d1")
    assert incremental.publish(df, path, version=2, day="d1") and not incremental.publish(df.orderBy(F.desc("id")), path, version=3, day="d1")
    assert incremental.publish(df.union(df), path, version=4, day="d1")
    assert incremental.read_published(spark, path, day="d2").where("stale").count() == 20


def test_feedback_and_state(spark, tmp_path):
    fb = spark.createDataFrame([(1, " hi ", "2026-07-01 00:00:00"), (2, " ", "2026-07-02 00:00:00"), (3, "yo", "2026-07-03 00:00:00")], "id int, message string, t string").withColumn("created_at", F.to_timestamp("t"))
    incremental.append_feedback(fb, str(tmp_path / "f"))
    assert [r["id"] for r in incremental.list_feedback(spark, str(tmp_path / "f"), 1).collect()] == [3]
    lines = incremental.export_state(spark.createDataFrame([(1, "a")], "id int, k string")).union(spark.createDataFrame([("no json",), ('{"version":9,"state":{"id":1}}',)], "json string"))
    good, bad = incremental.import_state(lines, "id int, k string")
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and bad.count() == 2


def test_details(spark):
    t = lambda h: dt.datetime(2026, 7, 11) - dt.timedelta(hours=h)
    cache = spark.createDataFrame([("a", t(7), t(7), True, "old"), ("b", t(1), t(1), True, "x"), ("c", t(9), t(0.2), True, "y")], "url_key string, checked_at timestamp, attempted_at timestamp, verified boolean, detail string")
    posts = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "url_key string")
    assert sorted(r["url_key"] for r in incremental.due_details(posts, cache, now=NOW()).collect()) == ["a", "d"]
    new = spark.createDataFrame([("a", None, t(0), False, None)], cache.schema)
    kept = incremental.upsert_details(cache, new).where("url_key = 'a'").first()
    assert kept["detail"] == "old" and kept["verified"] and kept["attempted_at"] == t(0)


def test_user_state(spark):
    m = spark.createDataFrame([("u", 1, "save", "a"), ("u", 2, "remove", "a"), ("u", 3, "save", "b"), ("u", 4, "save", "b"), ("v", 5, "save", "a")], "owner string, seq int, action string, job_key string")
    assert sorted((r["owner"], r["job_key"]) for r in userstate.saved_set(m).collect()) == [("u", "b"), ("v", "a")]
    assert sorted(r["seq"] for r in userstate.adjacent_compaction(m).collect()) == [2, 4, 5]
    a = spark.createDataFrame([("u", "j", 1, "applied", None), ("u", "j", 2, "final", "accepted"), ("u", "j", 3, "nonsense", None)], "user_id string, job_key string, seq int, status string, final_result string").withColumn("updated_at", F.col("seq"))
    assert userstate.application_state(a).first()["final_result"] == "accepted"
    saved = spark.createDataFrame([("u", "j"), ("u", "k")], "user_id string, job_key string")
    posts = spark.createDataFrame([("j", dt.date(2026, 7, 14)), ("k", dt.date(2026, 7, 13))], "job_key string, deadline_at date")
    assert [r["job_key"] for r in userstate.deadline_alerts(saved, posts, today=TODAY()).collect()] == ["j"]
    old = spark.createDataFrame([("n", 1, "r1")], "id string, scheduled_at int, read_at string")
    assert userstate.upsert_notifications(old, spark.createDataFrame([("n", 2, None)], old.schema)).first().asDict() == {"id": "n", "scheduled_at": 2, "read_at": "r1"}
    pages = spark.createDataFrame([("u", dt.datetime(2026, 7, 12), False), ("u", dt.datetime(2026, 7, 1), False), ("u", dt.datetime(2026, 7, 10), True)], "user_id string, last_success_at timestamp, error boolean").withColumn("in_progress", F.lit(False))
    assert userstate.advance_checkpoint(pages, now=NOW()).first()["checked_at"] == dt.datetime(2026, 7, 11)
    refs = spark.createDataFrame([("a",), ("b",)], "job_key string")
    assert sorted(r[0] for r in userstate.rekey(refs, spark.createDataFrame([("a", "z")], "old_key string, new_key string")).collect()) == ["b", "z"]


def test_merged_snapshots(spark):
    s = "id string, dedupe_key string, title string, saved_at int, updated_at int"
    a, b = spark.createDataFrame([("1", "k", "old", 1, 1), ("2", None, "x", 2, 2)], s), spark.createDataFrame([("9", "k", "new", 5, 5)], s)
    got = userstate.merge_snapshots(a, b, fields=["id", "dedupe_key", "title"]).orderBy("saved_at").collect()
    assert [(r["title"], r["saved_at"], r["updated_at"]) for r in got] == [("new", 1, 5), ("x", 2, 2)]


def test_admission_is_sequential(spark):
    rng = random.Random(1)
    rows = [(i, f"k{rng.randint(0, 3)}", dt.datetime(2026, 1, 1) + dt.timedelta(seconds=rng.randint(0, 3000))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, key string, at timestamp")
    got = {r["id"]: r["admitted"] for r in userstate.sliding_admission(df, key="key", at="at", limit=3, seconds=100, tie="id").collect()}
    for k in {r[1] for r in rows}:
        times = []
        for i, _, t in sorted((r for r in rows if r[1] == k), key=lambda r: (r[2], r[0])):
            times = [x for x in times if (t - x).total_seconds() < 100]
            assert got[i] == (len(times) < 3)
            if got[i]:
                times.append(t)


def test_schedules(spark):
    cases = {"주 5일 09:00~18:00": ("weekday_daytime", False, "confirmed"), "3교대 근무": ("three_shift", True, "shift"), "교대근무 없음": (None, False, "confirmed"), "야간 전담": ("night", None, "shift"), "상근직, 당직 있음": (None, None, "conflict"), "협의": (None, None, "unknown"), "3교대 없음": (None, None, "unknown")}
    df = spark.createDataFrame([(k,) for k in cases], "work_hours string").withColumn("title", F.lit(""))
    for r in classify.with_facets(df).collect():
        kind, shift, state = cases[r["work_hours"]]
        assert (r["schedule"]["kind"], r["schedule"]["shift"], r["non_shift"]) == (kind, shift, state), r["work_hours"]


def test_tiers(spark):
    rows = [("감염관리 간호사 모집", "서울대학교병원", "정규직", "주 5일 09:00~18:00", "간호사 면허 소지자", "연봉 5,200만원", "서울"), ("병동 간호사 3교대", "한빛병원", "정규직", "3교대", "", "", "서울"), ("외래 간호사", "한빛의원", "계약직", "", "", "", "부산")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, title string, company string, employment string, work_hours string, qualifications string, salary string, region string").withColumn("deadline_at", F.lit("2026-08-01").cast("date"))
    got = classify.application_tier(classify.with_facets(df), today=TODAY()).orderBy("ord").collect()
    assert got[0]["tier"] == "S" and got[0]["tier_score"] >= 82 and got[0]["tier_dimensions"]["organization"] == 20
    assert got[1]["tier"] == "exclude" and got[2]["tier"] == "exclude" and got[2]["care_role"] == "outpatient"
    second = classify.classify_second_board(df.select("title", "company").union(spark.createDataFrame([("LLM 서비스 기획 PM", "네이버")], "title string, company string"))).collect()
    assert [r["ai_tier"] for r in second][:3] == ["exclude"] * 3 and second[3]["ai_tags"] == ["기획·PM", "LLM"]


def test_specialty(spark):
    t = spark.createDataFrame([("감염관리 경력 3년 이상 필수",), ("감염관리 경력 우대",), ("간호사 면허",)], "t string")
    assert [r[0] for r in t.select(classify.specialty_requirement(F.col("t"))).collect()] == ["감염관리 실무 경력", None, None]


def test_matches(spark):
    p = spark.createDataFrame([(0, "보건관리자 간호사 면허 소지자", "서울", "주 5일 09:00~18:00"), (1, "병동 간호사", "부산", "3교대"), (2, "보건관리자", "서울", "")], "ord int, search_text string, region string, hours string")
    p = p.select("ord", "search_text", F.array().cast("array<string>").alias("role_tags"), match.eligibility(F.col("search_text"), F.lit("")).alias("eligibility"), "region", classify.schedule_of(F.col("hours")).alias("schedule"), F.array(F.lit("정규직")).alias("employment_types"), F.lit("신입").alias("experience_level"), F.lit(40_000_000).cast("long").alias("salary_minimum"), F.lit(True).alias("checked"), F.lit(False).alias("stale"), F.lit(None).cast("date").alias("published_at"))
    c = spark.createDataFrame([(1, ["health_manager"], ["서울", " "], ["regular"], 30_000_000, ["야간", "교대"], ["요양"])], "query_id int, role_tags array<string>, regions array<string>, employment_types array<string>, salary_minimum long, excluded_patterns array<string>, excluded_keywords array<string>")
    got = {r["ord"]: r for r in match.match_queries(p, c, block=1).collect()}
    assert got[0]["overall"] == "confirmed" and got[0]["top_recommendation"] and got[0]["mismatched_count"] == 0
    assert got[1]["overall"] == "mismatched" and got[1]["excluded_patterns"] == "mismatched" and got[2]["overall"] == "needs_review"
    assert [r["ord"] for r in match.match_queries(p, c, top=2).orderBy("rank").collect()] == [0, 2]
    assert match.match_conditions(match.match_queries(p, c)).where("status = 'unknown'").count() > 0
    assert match.criteria_rows(c).where("condition = 'regions'").count() == 1 and match.match_queries(p, c.limit(0)).count() == 0


def test_intents(spark):
    q = spark.createDataFrame([(1, "서울에서 정규직 보건관리자만, 야간 없는 곳 7일 이내")], "query_id int, text string")
    i = match.extract_intent(q)
    r = i.first()
    assert r["regions"] == ["서울"] and r["employment_types"] == ["regular"] and "health-manager" in r["role_tags"] and "야간" in r["exclude_keywords"] and r["deadline_days"] == 7 and "role" in r["required_fields"]
    rows = [(0, "보건관리자 채용", "보건관리자 채용 한빛", "서울", ["regular"], "entry", 3), (1, "보건관리자 야간", "보건관리자 야간", "서울", ["regular"], None, 3), (2, "요리사", "요리사", "부산", [], None, None)]
    p = spark.createDataFrame(rows, "ord int, title string, search_text string, region string, employment array<string>, experience string, deadline_days int")
    got = match.score_intents(p, i).collect()
    assert [x["ord"] for x in got] == [0] and got[0]["score"] >= 80
    prof = spark.createDataFrame([(1, ["health-manager"], ["서울"], ["정규직"])], "query_id int, role_tags array<string>, regions array<string>, employment_types array<string>")
    rec = match.recommend(p.withColumns({"role_tags": F.array().cast("array<string>"), "employment_types": F.array(F.lit("정규직")), "experience_level": F.lit("신입"), "needs_review": F.lit(False), "first_seen_at": NOW()}), prof)
    assert {x["ord"]: x["recommendation"] for x in rec.collect()} == {0: "strong", 1: "strong", 2: "review"}


def test_sections(spark):
    d = spark.createDataFrame([(1, "회사 소개\n\n담당업무\n- 간호\n계속\n- 교육\n자격요건: 면허\n[우대사항]\n경력"), (2, None)], "doc_id int, text string")
    lines = sections.assign_sections(sections.lines_of(d, key="doc_id"), key="doc_id")
    got = [(r["section"], r["line"]) for r in lines.orderBy("pos").collect()]
    assert got[0] == ("introduction", "회사 소개") and ("duties", "- 간호") in got and ("preferred", "경력") in got
    items = [r["value"] for r in sections.join_continuations(lines, key="doc_id").orderBy("pos").collect()]
    assert "- 간호 계속" in items
    pairs = sections.label_value_pairs(sections.lines_of(d, key="doc_id"), key="doc_id", labels={"자격요건": "q", "담당업무": "d"}).orderBy("pos").collect()
    assert [(r["label"], r["value"]) for r in pairs] == [("d", "- 간호"), ("q", "면허")]
    runs = sections.group_runs(spark.createDataFrame([(1, i, k) for i, k in enumerate("aabba")], "d int, pos int, k string"), key="d", kind="k", value="pos")
    assert [list(r["values"]) for r in runs.orderBy("run_no").collect()] == [[0, 1], [2, 3], [4]]
    h = sections.highlights(sections.lines_of(d, key="doc_id"), [("a", "간호|교육"), ("b", "간호|교육")], key="doc_id").first()
    assert [x["line"] for x in h["highlights"]] == ["- 간호", "- 교육"]
    r = spark.range(1).select(sections.recruitment_steps(F.lit("1. 서류 → 2. 면접 → 면접 → 발표")), sections.benefits(F.lit("4대보험, 기숙사 / 식대")), sections.drop_contained(F.array(F.lit("abc"), F.lit("b"), F.lit("x"))), sections.capture_between(F.lit("A: one B: two"), "A:", "B:"), sections.best_fact(F.lit("-"), F.lit("협의"), F.lit("ok"))).first()
    assert r[0] == ["서류", "면접", "발표"] and r[1] == ["4대보험", "기숙사", "식대"] and r[2] == ["abc", "x"] and r[3] == "one" and r[4] == "ok"


def test_enrichment(spark):
    posts = spark.createDataFrame([("a", "u1", "-", "p"), ("b", "u2", "정규직", "p"), ("c", "u3", None, "p")], "id string, url string, employment string, profile_key string")
    t = dt.datetime(2026, 7, 10)
    cache = spark.createDataFrame([("e1", ["a"], [], t, "계약직"), ("e2", [], ["u1", "u2"], t, "시간제"), ("e3", ["c"], [], dt.datetime(2026, 1, 1), "old")], "entry string, ids array<string>, urls array<string>, checked_at timestamp, employment string")
    got = {r["id"]: (r["employment"], r["profile_key"]) for r in sections.enrich_by_identity(posts, cache, fields=["employment"], now=NOW()).collect()}
    assert got == {"a": ("계약직", None), "b": ("정규직", None), "c": (None, "p")}
    ev = sections.clause_evidence(spark.createDataFrame([(1, "병원 경력. 중환자실 경력 3년."), (2, "중환자실 경력. 수술실 경력.")], "id int, text string"), [("clinical", "경력", 1), ("icu", "중환자실", 2), ("or", "수술실", 2)], key="id")
    assert {r["id"]: r["domain"] for r in ev.collect()} == {1: "icu", 2: "unspecified"}
    own = spark.createDataFrame([(1, "a", "text one")], "id int, section string, value string")
    more = spark.createDataFrame([(1, "a", "other"), (1, "b", "Text, one!"), (1, "c", "new")], own.schema)
    assert sorted(r["section"] for r in sections.fill_missing_sections(own, more, key="id").collect()) == ["a", "c"]


def test_companies(spark):
    c = spark.createDataFrame([(1, "hanbit"), (2, "hanbitmedical"), (3, "zz"), (4, "other")], "company_id int, key string")
    r = spark.createDataFrame([(10, "hanbit"), (11, "hanbitmed"), (12, "th")], "rating_id int, key string")
    found = reputation.company_lookup(c, r)
    assert {(x["company_id"], x["rating_id"], x["status"]) for x in found.collect()} == {(1, 10, "ok"), (2, 11, "candidate")}
    picked = reputation.select_candidates(found, spark.createDataFrame([(2, 11)], "company_id int, rating_id int"))
    assert picked.where("status = 'ok'").count() == 2
    links = spark.createDataFrame([(1, "s", "k", 0, "u0", 1, "n", 4.5, 10), (1, "s", "k", 1, "u1", 3, None, None, None), (1, "s", "x", 2, "u", 1, "m", 9.0, 3)], "query_id int, source string, company_key string, pos int, url string, priority int, name string, rating double, review_count int")
    got = reputation.rating_aggregate(links).collect()
    assert len(got) == 1 and got[0]["url"] == "u1" and float(got[0]["rating"]) == 4.5


def test_orders(spark):
    df = spark.createDataFrame([(0, 1, 80, "2026-07-10"), (1, 0, 90, "2026-06-01"), (2, 0, 92, "2026-05-01")], "ord int, tier_order int, tier_score int, p string").withColumns({"published_at": F.to_date("p"), "first_seen_at": NOW(), "non_shift_rank": F.lit(0), "work_life_score": F.lit(0), "title": F.lit("가"), "deadline_at": F.to_date("p"), "last_seen_at": NOW()})
    order = lambda n: [r["ord"] for r in select.sorted_postings(df, n, today=TODAY()).collect()]
    assert order("recommended") == [2, 1, 0] and order("latest") == [0, 1, 2] and order("tier_latest") == [1, 2, 0] and order("snapshot") == [2, 1, 0]
    pd.testing.assert_frame_equal(select.unique_by(df.select("tier_order", "ord", "tier_score"), ["tier_order"], "ord").orderBy("ord").toPandas()[["tier_order", "ord"]].astype(int), pd.DataFrame({"tier_order": [1, 0], "ord": [0, 1]}).astype(int))
