import datetime as dt

from pyspark.sql import functions as F

from postloom.functions import dates, rules, text, urls


def one(spark, *columns, **values):
    df = spark.createDataFrame([tuple(values.values()) or (1,)], list(values) or ["x"])
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def test_clean_and_unknown(spark):
    r = one(spark, text.clean_text(F.col("a")), text.meaningful(F.col("b")), text.compact_key(F.col("c")), a="　㈜ 한빛　메디컬 １２​", b="원문 확인", c="ICU-간호사 (3명)")
    assert r[0] == "(주) 한빛 메디컬 12" and r[1] is None and r[2] == "icu간호사3명"


def test_company_keys(spark):
    r = one(spark, text.company_key(F.col("a")), text.company_key(F.col("b")), text.company_compact_key(F.col("c")), a="태광후지킨(주)", b="주식회사 태광후지킨", c="한빛 메디컬")
    assert r[0] == r[1] == "태광후지킨" and r[2] == "한빛메디컬"
    r = one(spark, text.company_key(F.col("a")), text.company_key(F.col("b")), a="한빛 서울", b="서울 한빛")
    assert r[0] == r[1]


def test_title_keys(spark):
    a, b = "태광후지킨 (tk-fujikin) 안전환경팀 보건관리자(간호사) 채용", "태광후지킨 (tk-fujikin) 안전환경팀 보건관리자(간호사) 채..."
    r = one(spark, text.title_key(F.col("a"), F.lit("태광후지킨(주)")), text.title_key(F.col("b"), F.lit("태광후지킨(주)")), a=a, b=b)
    assert r[0] == r[1] == "tkfujikin안전환경팀보건관리자간호사"
    assert one(spark, text.title_key(F.col("a"), F.lit("")), a="새로운글 [서울성모]가정전문간호사(가정간호팀/계약직) 공개채용")[0] == one(spark, text.title_key(F.col("a"), F.lit("")), a="[서울성모] 가정전문간호사(가정간호팀/계약직) 공개채용")[0]
    r = one(spark, text.dedupe_key(F.lit(""), F.col("a"), F.lit("s"), F.lit("7")), text.dedupe_keys(F.lit("한빛 메디컬"), F.col("a")), a=a)
    assert r[0] == "source:s:7" and len(r[1]) == 2


def test_deadlines(spark):
    rows = [
        ("D-3", "2026-07-11 14:59:00", "2026-07-14", "fixed"), ("오늘 마감", "2026-07-11 15:01:00", "2026-07-12", "fixed"), ("01/02", "2026-12-31 00:00:00", "2027-01-02", "fixed"),
        ("12/31", "2027-01-02 00:00:00", "2026-12-31", "fixed"), ("26/08/31", "2026-07-11 00:00:00", "2026-08-31", "fixed"), ("상시채용", "2026-07-11 00:00:00", None, "always"), ("2026-02-30", "2026-01-01 00:00:00", None, "unknown"), ("채용 시 마감", "2026-01-01 00:00:00", None, "until-filled"), (None, "2026-01-01 00:00:00", None, "unknown"),
    ]
    df = spark.createDataFrame(rows, "raw string, at string, want string, kind string").withColumn("at", F.to_timestamp("at"))
    for r in df.select("*", dates.parse_deadline(F.col("raw"), F.col("at")).alias("p")).collect():
        assert (r["p"]["date"] and r["p"]["date"].isoformat(), r["p"]["kind"]) == (r["want"], r["kind"]), r["raw"]


def test_published(spark):
    rows = [("어제 등록", "2026-07-11 00:00:00", "2026-07-10", "relative"), ("12/31", "2026-01-03 00:00:00", "2025-12-31", "explicit"), ("3일 전", "2026-07-11 00:00:00", "2026-07-08", "relative"), ("2시간 전", "2026-07-11 16:00:00", "2026-07-12", "relative"), ("2026-07-11T20:00:00Z", "2026-07-13 00:00:00", "2026-07-12", "explicit"), ("", "2026-07-11 00:00:00", None, "unknown")]
    df = spark.createDataFrame(rows, "raw string, at string, want string, kind string").withColumn("at", F.to_timestamp("at"))
    for r in df.select("*", dates.parse_published(F.col("raw"), F.col("at")).alias("p")).collect():
        assert (r["p"]["date"] and r["p"]["date"].isoformat(), r["p"]["kind"]) == (r["want"], r["kind"]), r["raw"]


def test_states_and_slots(spark):
    day = lambda s: F.lit(s).cast("date")
    got = [one(spark, dates.deadline_state(day(d), F.lit(k), day("2026-07-11")))[0] for d, k in (("2026-07-10", "fixed"), ("2026-07-11", "fixed"), ("2026-07-14", "fixed"), ("2026-07-15", "fixed"), (None, "always"), (None, "unknown"))]
    assert [g["status"] for g in got] == ["expired", "today", "closing-soon", "upcoming", "open", "unknown"]
    r = one(spark, dates.next_run(F.lit("2026-07-11 03:00:01").cast("timestamp")), dates.next_run(F.lit("2026-07-11 09:00:00").cast("timestamp")))
    assert r[0] == dt.datetime(2026, 7, 11, 9) and r[1] == dt.datetime(2026, 7, 12, 0)
    r = one(spark, dates.strict_iso(F.lit("2026-02-30")), dates.strict_iso(F.lit("yesterday")), dates.strict_iso(F.lit("2026-02-03T10:00:00+09:00")), dates.days_until(F.lit("D-5"), F.lit(None).cast("timestamp"), F.lit(None).cast("timestamp")))
    assert r[0] is None and r[1] is None and r[2] == dt.datetime(2026, 2, 3, 1) and r[3] == 5


def test_small_facts(spark):
    r = one(spark, text.employment_type(F.lit("정규직 또는 계약직")), text.employment_type(F.lit("비정규직")), text.employment_type(F.lit("비정규직"), strict_regular=True), text.experience_level(F.lit("신입·경력")), text.region_code(F.lit("경기 성남")), text.years_required(F.lit("3년 이상 또는 5년, 1995년")))
    assert r[0] == "정규직·계약직" and r[1] == "정규직" and r[2] == "비정규직" and r[3] == "경력무관" and r[4] == "41" and r[5] == 5
    r = one(spark, text.salary_range(F.lit("연봉 3,600만원 ~ 4,200만원")), text.annual_salary(F.lit("월급 300만원")), text.bounded(F.lit("4.7"), 0, 5), text.bounded(F.lit("7"), 0, 5), text.first_of(F.lit(" "), F.lit("b")))
    assert r[0]["minimum"] == 36_000_000 and r[0]["maximum"] == 42_000_000 and r[0]["unit"] == "year" and r[1] == 36_000_000 and r[2] == 4.7 and r[3] is None and r[4] == "b"
    r = one(spark, text.first_evidence([("a", F.lit("nothing")), ("b", F.lit("x " * 100 + "needle" + " y" * 100))], "needle"), text.employment_display(F.lit("정규직"), F.lit("정규직(수습 3개월)"), F.lit("-")))
    assert r[0]["field"] == "b" and "needle" in r[0]["excerpt"] and len(r[0]["excerpt"]) <= 142 and r[1] == "정규직(수습 3개월)"


def test_urls(spark):
    r = one(spark, urls.canonical_url(F.lit("HTTPS://Ex.com/a?b=2&a=1&utm=x#f"), drop=["utm"]), urls.canonical_url(F.lit("no url")), urls.url_allowed(F.lit("https://ex.com/v/1"), ["ex.com"], path="^/v/"), urls.url_allowed(F.lit("https://u@ex.com/v/1"), ["ex.com"]), urls.url_allowed(F.lit("https://ex.com:8080/v/1"), ["ex.com"]))
    assert r[0] == "https://ex.com/a?a=1&b=2" and r[1] is None and r[2] is True and r[3] is False and r[4] is False


def test_rules_and_dialect(spark):
    table = [rules.Rule(rules.js(r"\bicu\b"), "icu", 5, "ward"), rules.Rule("night", "night", -3, "nights", unless="no night"), rules.Rule("x", "x", 1, field="other")]
    df = spark.createDataFrame([("ICU간호사 night", "x"), ("no night shift", None), ("circus", "y")], "text string, other string")
    got = rules.apply_rules(rules.apply_rules(df, table, {"text": "text", "other": "other"}), table, {"text": "text", "other": "other"}, mode="sum", into="score").collect()
    assert [r["label"] for r in got] == [["icu", "night", "x"], [], []] and [r["score"] for r in got] == [3, 0, 0] and got[0]["score_reasons"] == ["ward", "nights"]
    assert one(spark, F.lit("a　b").rlike(rules.js(r"a\sb$")), F.lit("x").rlike(rules.js(r"[\s,]")))[:] == (True, False)


def test_alternatives_that_need_hangul():
    from postloom.functions.rules import without_hangul

    assert without_hangul(r"중환자실|\bicu\b") == r"\bicu\b"
    assert without_hangul("병동|입원간호") is None
    assert without_hangul(r"(?:3\s*교대|삼교대)(?:\s*근무)?|on[ -]?call") == "on[ -]?call"
    for kept in ("가?b", "(?:가|b)c", "[가b]c", "(?!가)b", "(?:가){0,2}b", "(?:가)?b", r"\(a|b(?:가|)"):
        assert without_hangul(kept) == kept  # such texts need no Hangul


def test_found_is_what_the_whole_pattern_holds(spark):
    from postloom.functions.rules import found, js
    from postloom.operators import classify as c

    texts = ["ICU nurse, day shift", "er or (or) crc-2", "3교대 없음 night x", "주말 off 22:00~06:00", "lg 전자 clinical  research", "", "über qi day only", "병동 n-keep d/e/n", "picu_ a e r", "병원 pm"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    patterns = [*c.WORDS.values(), *c.NEGATED.values(), *c.SHIFTS.values(), *[p for p, *_ in (*c.DEPARTMENTS, *c.FACILITIES, *c.DAY_JOBS, *c.CAREER)], c._NURSE, c._MAJOR, c._PUBLIC, c._HEALTH]
    out = df.select(*[F.struct(found(F.col("t"), p).alias("a"), F.col("t").rlike(js(p)).alias("b"), found(F.lower("t"), p, lowered=True).alias("c")) for p in patterns]).collect()
    assert all(x["a"] == x["b"] == x["c"] for r in out for x in r)
    edges = ["er", "a er,", "xer", "er_", "or", "(or)", "xor", "or/", "orb", "a\nor"]
    rows = spark.createDataFrame([(t,) for t in edges], "t string").select("t", found(F.col("t"), r"\ber\b").alias("er"), found(F.col("t"), c.DEPARTMENTS[2][0]).alias("or")).collect()
    assert {r["t"] for r in rows if r["er"]} == {"er", "a er,"} and {r["t"] for r in rows if r["or"]} == {"or", "(or)", "or/", "a\nor"}
