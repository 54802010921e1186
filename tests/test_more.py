import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import reputation, sections, select
from postloom.sources import registry


def test_second_board(spark):
    day = F.lit("2026-07-11").cast("date")
    df = spark.createDataFrame([(0, "llm pm", ["LLM"], "11", False, 0, "2026-07-11", "S", 90), (1, "data", ["데이터"], "26", True, 5, None, "B", 50), (2, "ml", ["ML"], None, False, None, "2026-07-01", "A", 70)], "ord int, search_text string, ai_tags array<string>, region_code string, is_remote boolean, experience_years int, d string, ai_tier string, ai_score int").withColumns({"deadline_at": F.to_date("d"), "employment_type": F.lit("정규직"), "last_seen_at": day, "published_at": day, "first_seen_at": day})
    ids = lambda **f: sorted(r["ord"] for r in select.second_board_filter(df, today=day, **f).collect())
    assert ids(region="metro") == [0] and ids(region="metro-all") == [0, 1, 2] and ids(region="remote") == [1] and ids(experience="senior") == [1] and ids(deadline="active") == [0, 1] and ids(role="ML") == [2] and ids(query="LLM") == [0]
    assert [r["ord"] for r in select.sorted_postings(df, "second_board", today=day).collect()] == [0, 2, 1]


def test_lookups(spark):
    a, b = (spark.createDataFrame(rows, "ord int, id string, source_ids array<string>") for rows in ([(1, "x", ["k"])], [(2, "k", []), (3, "y", [])]))
    got = select.job_by_any_id(spark.createDataFrame([("k",), ("y",), ("zz",)], "id string"), a, b)
    assert {(r["id"], r["frame"], r["ord"]) for r in got.collect()} == {("k", 0, 1), ("y", 1, 3)}
    runs = spark.createDataFrame([("s", "a", True), ("s", "b", False)], "source_id string, query_label string, ok boolean")
    assert select.collection_stats(runs).first().asDict() == {"source_id": "s", "requested": 2, "successful": 1, "failures": 1}
    assert registry.registry(spark).where("format = 'xml'").count() == 1


def test_details(spark):
    roles = spark.createDataFrame([(1, 0, "병동"), (1, 1, "외래")], "k int, role_no int, department string")
    docs = spark.createDataFrame([(1, 0, "병동 직무기술서"), (1, 1, "병동·외래 공통"), (1, 2, "기타")], "k int, doc_no int, header string")
    assert {r["doc_no"]: r["role_no"] for r in sections.role_document_assign(roles, docs, key="k").collect()} == {0: 0, 1: None, 2: None}
    r = spark.range(1).select(sections.experience_display(F.lit("경력 3년"), F.lit("icu")), sections.rich_text_lines(F.lit('{"type":"doc","content":[{"type":"paragraph","content":[{"type":"text","text":"가"},{"type":"text","text":"나"}]},{"type":"orderedList","content":[{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"one"}]}]},{"type":"listItem","content":[{"type":"paragraph","content":[{"type":"text","text":"two"}]}]}]}]}'))).first()
    assert r[0]["label"] == "경력 · icu" and r[1] == "가나\n1. one\n2. two"
    n = spark.createDataFrame([(1, "공고\n1. 모집분야\n간호사 3명\n2. 응시자격\n면허\n접수기간\n2026. 8. 1. 18:00까지")], "k int, text string")
    f = sections.official_notice_fields(n, key="k").first()
    assert f["roles"] == "간호사 3명" and f["qualifications"] == "면허" and f["headcount"] == 3 and f["deadline_line"].endswith("까지")
    cells = spark.createDataFrame([(1, 0, 0, 0, "부서"), (1, 0, 0, 1, "조건"), (1, 0, 1, 0, "병동"), (1, 0, 1, 1, "3교대인 경우 수당")], "k int, table_no int, row_no int, col_no int, text string")
    t = sections.recruitment_roles(cells, key="k", labels={"부서": "department", "조건": "conditions"}).first()
    assert t["department"] == "병동" and t["conditions"] is None and t["notes"] == "3교대인 경우 수당"
    d = sections.finalize_detail(spark.createDataFrame([(1, "-", "공고", "t"), (2, "간호", None, "t")], "k int, duties string, description string, title string"), ["duties"]).orderBy("k").collect()
    assert [x["verified"] for x in d] == [False, True] and d[0]["duties"] is None


def test_null_keys_share_a_window(spark):
    from postloom.operators import userstate

    for kind in ("long", "string"):
        df = spark.createDataFrame([(None, i) for i in range(6)], f"k {kind}, s long").withColumn("at", F.timestamp_seconds("s"))
        out = userstate.sliding_admission(df, key="k", at="at", limit=2, seconds=60, tie="s")
        assert [r["admitted"] for r in out.orderBy("s").collect()] == [True, True, False, False, False, False]
        assert out.schema["k"].dataType == df.schema["k"].dataType


def test_all_references_are_decoded(spark):
    from postloom.sources import extract

    df = spark.createDataFrame([("<p>&copy; 2020 &middot; caf&eacute; &#8217;x&#x41;&nbsp;y</p>",), (None,)], "h string")
    got = [r["t"] for r in df.select(extract.html_to_text(F.col("h")).alias("t")).collect()]
    assert got == ["© 2020 · café ’xA y", None]


def test_safety_certificates_alone_bar_a_nurse(spark):
    from postloom.operators import classify

    row = [("보건관리자 모집", "산업안전기사 필수"), ("간호사 모집", "간호사 면허 소지자")]
    df = spark.createDataFrame(row, "title string, qualifications string")
    out = classify.application_tier(classify.with_facets(df), today=F.lit("2026-07-11").cast("date")).collect()
    by_title = {r["title"]: r for r in out}
    assert "간호사 면허만으로 지원 불가" in by_title["보건관리자 모집"]["tier_cautions"]
    assert "간호사 면허만으로 지원 불가" not in by_title["간호사 모집"]["tier_cautions"]


def test_generic_role_gives_way_to_a_specific_one(spark):
    from postloom.operators import match

    df = spark.createDataFrame([("산업간호사 찾아줘",), ("간호사 찾아줘",), ("임상 간호사나 보건관리 직무",)], "text string")
    assert [r["role_tags"] for r in match.extract_intent(df).collect()] == [["occupational-nurse"], ["clinical-nurse"], ["health-manager", "clinical-nurse"]]


def test_lookup_of_keys_that_begin_alike(spark):
    """Every company has the rating that a comparison of all pairs finds; repeated, empty and null keys included."""
    rng = random.Random(4)
    name = lambda: "su" + "".join(rng.choice("ab") for _ in range(rng.randint(0, 9)))
    companies = [(i, name()) for i in range(150)] + [(150, ""), (151, None), (152, "a"), (153, "su" * 40)]
    ratings = [(i, name()) for i in range(40)] + [(40, "ab"), (41, ""), (42, None), (43, "su" * 39)]
    want = {}
    for i, c in companies:
        if not c:
            continue
        same = [r for r, k in ratings if k == c]
        if same:
            want[i] = (min(same), "ok")
            continue
        near = [(-min(len(k), len(c)) / max(len(k), len(c)), r) for r, k in ratings if k and (k in c or c in k)]
        near = [(q, r) for q, r in near if -q >= 0.5]
        if near:
            want[i] = (min(near)[1], "candidate")
    found = reputation.company_lookup(spark.createDataFrame(companies, "company_id int, key string"), spark.createDataFrame(ratings, "rating_id int, key string")).collect()
    assert len(found) == len(want) and {r["company_id"]: (r["rating_id"], r["status"]) for r in found} == want
    assert {s for _, s in want.values()} == {"ok", "candidate"}


def test_turns_of_one_crowded_host(spark):
    rng = random.Random(6)
    rows = [(i, rng.randint(0, 1), rng.choice(["h", "h", "h", "a", "b", None]), rng.choice([None, 1, 2, 3])) for i in range(120)]
    got = {r["ord"]: r["slot"] for r in select.fair_interleave(spark.createDataFrame(rows, "ord int, g int, host string, score int"), "g", "host", "score").collect()}
    best = lambda r: (-(r[3] or 0), r[0])
    want = {}
    for g, (first, each) in enumerate(((0, 2), (2, 1))):
        hosts = {}
        for r in sorted((r for r in rows if r[1] == g), key=best):
            hosts.setdefault(r[2], []).append(r)
        turns = sorted((turn, best(own[0]), r[0]) for own in hosts.values() for turn, r in enumerate(own))
        for n, (_, _, o) in enumerate(turns):
            want[o] = n // each * 3 + first + n % each
    assert got == want


def test_requests(spark):
    rows = [(0, "{}", "[]", "new", None, [" b", "a", "a"], 0), (1, "[]", None, "all", None, None, 500), (2, None, "{", "all", None, None, -3), (3, None, None, "some", None, None, None), (4, None, None, "all", "yesterday", None, 1), (5, None, None, "all", "2026-07-11", ["x" * 513], 1), (6, None, None, "all", "2026-07-11", [None], 1), (7, '{"a": "' + "x" * 24_000 + '"}', None, None, None, ["constructor"], 1)]
    df = spark.createDataFrame(rows, "k int, filters string, ids string, mode string, since string, seen array<string>, limit int")
    got = {r["k"]: r for r in select.validate_requests(df).collect()}
    assert [got[k]["problem"] for k in range(8)] == [None, "filters", "ids", "mode", "since", "seen", "seen", "filters"]
    assert [got[k]["limit"] for k in range(4)] == [24, 100, 1, 24] and got[0]["seen"] == ["a", "b"]
    assert select.validate_requests(df.where("k = 0"), strict=True).first()["problem"] is None
    with pytest.raises(Exception, match="wrong request: mode"):
        select.validate_requests(df.where("k = 3"), strict=True).collect()


def test_batches_are_dealt_into_parts_of_bounded_size(spark):
    from postloom.operators import incremental
    from postloom.storage import spread

    df = spark.range(40).select((F.col("id") % 10).alias("batch_id"), F.col("id").alias("page_no"))
    assert spread(df, "batch_id", rows=40, at_once=2).rdd.getNumPartitions() == 20
    assert spread(df, "batch_id", rows=40).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 2, 5), (3, 1, 0), (3, 2, 5)], "batch_id int, page_no int, n_rows int")
    whole, rest = incremental.require_complete_batch(rows, rows)  # without n_pages
    assert {r["batch_id"] for r in whole.collect()} == {1} and {r["batch_id"] for r in rest.collect()} == {2, 3}


def test_trust_of_postings_deals_a_large_source_over_parts(spark):
    from postloom.operators import trust

    status = spark.createDataFrame([(1, "fresh", False, False, False, None), (2, "fallback", True, True, True, None)], "source_id int, freshness string, is_fallback boolean, stale boolean, from_cache boolean, last_success_at timestamp")
    links = spark.createDataFrame([(i, 1) for i in range(64)] + [(0, 2), (0, 2), (64, None), (65, 9)], "entity int, source_entry_id int")
    out = trust.posting_trust(links, status)
    got = {r["entity"]: r["trust_state"] for r in out.collect()}
    assert got == {i: "fresh" for i in range(1, 64)} | {0: "mixed", 64: "unknown", 65: "unknown"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and plan.count("RepartitionByExpression") == 2
