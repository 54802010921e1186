from postloom.operators import recommend as m

POST = "ord int, search_text string, role_tags array<string>, region string, employment string, experience string, work_pattern string, needs_review boolean"
PROFILE = "q_role_tags array<string>, q_regions array<string>, q_employment_types array<string>, q_experience_levels array<string>, q_keywords array<string>, q_work_patterns array<string>, q_excluded_keywords array<string>"


def explain(spark, post, profile):
    df = spark.createDataFrame([post], POST).join(spark.createDataFrame([profile], PROFILE))
    r = m.explained(df).first()
    return r["level"], r["reasons"], r["missing"], r["excluded"], r["cautions"]


def test_reasons(spark):
    ward = (0, "병동 간호사 모집 검진 우대 3교대 없음", ["clinical-nurse"], "서울 강남구", "정규직", "신입", None, False)
    asks = (["clinical-nurse"], ["서울"], ["정규직"], ["신입·무관"], ["검진", "없는 말"], ["3교대 제외", "상근·주간"], ["요양"])
    assert explain(spark, ward, asks) == ("strong", ["3교대 제외", "임상 간호사", "서울", "정규직"], [], [], ["근무형태 확인 필요", "제외 조건 여부 확인 필요"])
    shifts = (1, "병동 간호사 3교대", ["clinical-nurse"], "부산", "계약직", "경력", "3교대", False)
    assert explain(spark, shifts, asks) == ("review", ["임상 간호사"], ["지역", "고용형태"], ["3교대"], ["지역 조건과 다름", "고용형태 조건과 다름", "제외 조건 여부 확인 필요"])
    office = (2, "보건관리자 간호사 면허 주간 상근", ["health-manager"], "서울", "정규직", "경력", "상근·주간", False)
    assert explain(spark, office, (["clinical-nurse"], [], [], [], [], [], ["야간", "면허"])) == ("review", ["야간 제외"], ["역할"], ["면허"], ["선택한 임상 역할과 다름"])
    assert explain(spark, office, (["health-manager"], None, None, None, None, ["상근·주간"], None)) == ("strong", ["보건관리자", "상근·주간"], [], [], [])
    assert explain(spark, office, (["health-manager"], None, None, None, None, None, None))[0] == "partial"
    blank = (3, None, None, None, None, None, None, None)
    assert explain(spark, blank, (None, None, None, None, None, ["야간전담"], None)) == ("review", [], [], [], ["근무형태 확인 필요"])
