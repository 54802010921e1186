import random
import re

from pyspark.sql import functions as F

from postloom.operators import experience as m


def slow(text, terms, career, gap):
    """Domains of each clause by one pattern for both orders."""
    out = []
    for clause in filter(None, (re.sub(r"\s+", " ", c).strip() for c in re.split(r"\n+|[.!?。；;]", text or ""))):
        near = lambda p: re.search(rf"(?:{p}.{{0,{gap}}}{career}|{career}.{{0,{gap}}}{p})", clause, re.I)  # noqa: B023, E731
        out.append({d for d, p in terms.items() if near(p)})
    return out


def test_evidence_equals_patterns(spark):
    rng = random.Random(14)
    words = ["임상", "병동 간호", "보건관리자", "산업 간호", "경력", "경력직", "경험", "간호사", "면허", "우대", "채용 공고", "가나다라마바사", ".", "\n", "·"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 25)))) for i in range(300)]
    df = spark.createDataFrame(docs, "id int, description string")
    got = {}
    for r in m.domain_evidence(df, key="id", fields=["description"], general=None).collect():
        got.setdefault(r["id"], {}).setdefault(r["pos"], set()).add(r["domain"])
    want = {i: {p: d for p, d in enumerate(slow(t, m.TERMS, m.CAREER, m.GAP)) if d} for i, t in docs}
    assert got == {i: w for i, w in want.items() if w} and len(got) > 80


def test_domains(spark):
    rows = [
        (0, "병동 간호사", "임상 간호 경력 2년 이상", None), (1, "보건관리자 경력직", None, None), (2, "간호사", "임상 경력 1년, 보건관리자 경력 3년 우대", None), (3, "간호사", "간호사 면허 · 경력 2년", None),
        (4, "간호사", "간호사 관련 업무 경력자", "보건관리 경험 우대"), (5, "임상 경력", "간호사 경력 2년", None), (6, None, None, None), (7, "x", "임상 " + "가" * 19 + " 경력", None), (8, "x", "가" * 200 + " 경력 임상 " + "나" * 200, None),
    ]
    df = spark.createDataFrame(rows, "id int, title string, qualifications string, duties string")
    got = {r["id"]: r for r in m.experience_domain(df, key="id").collect()}
    assert [got[i]["domain"] for i in range(9)] == ["clinical", "health-manager", "unspecified", "unspecified", "health-manager", "nursing-general", "unspecified", "unspecified", "clinical"]
    assert got[1]["strength"] == "title-context" and got[0]["field"] == "qualifications" and got[2]["excerpt"] is None
    assert got[4]["field"] == "duties" and "경력 임상" in got[8]["excerpt"] and len(got[8]["excerpt"]) <= 142 and got[8]["excerpt"].startswith("…")
    assert m.experience_domain(df.limit(0), key="id").count() == 0
