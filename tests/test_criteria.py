from postloom.operators import criteria as m, match


def row(df):
    return df.first().asDict()


def test_profiles_become_criteria_and_back(spark):
    schema = "query_id int, role_tags array<string>, region_codes array<string>, employment_types array<string>, experience_levels array<string>, salary_minimum int, preferred_keywords array<string>, excluded_keywords array<string>, work_patterns array<string>, excluded_work_patterns array<string>, required_weekday_daytime boolean"
    p = spark.createDataFrame([(1, ["health_manager", " ", "health_manager"], ["서울"], ["regular"], ["신입·무관"], 3000, ["검진"], ["야간", "3교대 제외", "요양", None], ["2교대 제외", "상근·주간"], ["당직·온콜"], None), (2, None, None, None, None, -5, None, ["NIGHT shift"], None, None, False)], schema)
    c = {r["query_id"]: r.asDict() for r in m.profile_to_criteria(p).collect()}
    assert c[1]["role_tags"] == ["health-manager"] and c[1]["employment_types"] == ["정규직"] and c[1]["qualifications"] == ["간호사 면허"] and c[1]["salary_minimum"] == 3000
    assert c[1]["excluded_patterns"] == ["당직·온콜", "2교대", "야간", "3교대"] and c[1]["excluded_keywords"] == ["요양"] and c[1]["weekday_daytime"]
    assert c[2]["excluded_patterns"] == ["야간"] and c[2]["excluded_keywords"] == [] and c[2]["salary_minimum"] is None and not c[2]["weekday_daytime"]
    back = {r["query_id"]: r.asDict() for r in m.criteria_to_profile(m.profile_to_criteria(p)).collect()}
    assert back[1]["work_patterns"] == ["상근·주간"] and back[2]["work_patterns"] == [] and back[1]["region_codes"] == ["서울"]
    again = m.profile_to_criteria(m.criteria_to_profile(m.profile_to_criteria(p)))
    drop = lambda d: {k: v for k, v in d.items() if k not in ("salary_minimum", "query")}  # noqa: E731  a profile has no pay of criteria
    assert {r["query_id"]: drop(r.asDict()) for r in again.collect()} == {k: drop(v) for k, v in c.items()}


def test_intents_over_current_criteria(spark):
    q = spark.createDataFrame([(1, "서울 보건관리자, 야간 없는 주간 근무, 신입"), (2, "추천")], "query_id int, text string")
    i = match.extract_intent(q)
    now = spark.createDataFrame([(1, ["clinical-nurse"], ["부산"], ["요양"], ["당직·온콜"], False), (9, [], [], [], [], True)], "query_id int, role_tags array<string>, regions array<string>, excluded_keywords array<string>, excluded_patterns array<string>, weekday_daytime boolean")
    got = {r["query_id"]: r.asDict() for r in m.intent_to_criteria(i, now).collect()}
    assert set(got) == {1, 2} and got[1]["regions"] == ["서울"] and got[1]["role_tags"] == ["health-manager"] and got[1]["experience_levels"] == ["신입·무관"]
    assert got[1]["weekday_daytime"] and got[1]["excluded_patterns"][:2] == ["당직·온콜", "야간"] and "요양" in got[1]["excluded_keywords"] and "3교대" in got[1]["excluded_patterns"]
    assert got[2]["regions"] == [] and got[2]["weekday_daytime"] and got[2]["qualifications"] == ["간호사 면허"]
    assert row(m.intent_to_criteria(i.where("query_id = 1")))["excluded_patterns"][0] == "야간"


def test_criteria_as_filters(spark):
    c = spark.createDataFrame([(1, ["서울"], ["regular"], [], True, " 간호 "), (2, ["서울", "부산"], [], ["경력"], False, None)], "query_id int, regions array<string>, employment_types array<string>, experience_levels array<string>, weekday_daytime boolean, query string")
    got = {r["query_id"]: tuple(r)[1:] for r in m.criteria_to_filters(c).collect()}
    assert got == {1: ("간호", "서울", "정규직", "전체", "주중·주간 확인"), 2: ("", "전체", "전체", "경력", "전체")}
