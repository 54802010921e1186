import json
import random

from pyspark.sql import functions as F

from postloom.operators import resolve
from postloom.operators.components import connected_components



def NOW():  # noqa: N802
    return F.lit("2026-07-11 00:00:00").cast("timestamp")

#: Four listings of two jobs: a title that a board cut off, a legal form, a board's prefix, a missing deadline.
ROWS = [
    {"id": "p-77", "source": "사람인", "company": "(주)해오름정밀", "title": "해오름정밀 군산공장 보건관리자 신규 모집(간호사 면허)", "region": "전북", "deadline": "~08/31(월)", "category": "health", "url": "https://one.example/77"},
    {"id": "q-5", "source": "고용24", "company": "해오름정밀", "title": "해오름정밀 군산공장 보건관리자 신규 모집(간호사 ...", "region": "전북", "deadline": "26/08", "category": "health", "url": "https://two.example/5"},
    {"id": "r-12", "source": "널스잡", "company": "의료법인 은하재단 푸른강병원", "title": "[푸른강] 투석실 간호사(주간 외래) 충원 공고", "region": "대전", "deadline": "~07/16", "category": "clinical", "url": "https://three.example/12"},
    {"id": "s-3", "source": "병원잡", "company": "의료법인 은하재단 푸른강병원", "title": "새로운글 [푸른강]투석실 간호사(주간 외래) 충원 공고", "region": "대전", "deadline": "원문 확인", "category": "clinical", "url": "https://four.example/3"},
]


def frame(spark, rows):
    return spark.read.json(spark.sparkContext.parallelize([json.dumps(r | {"ord": i}, ensure_ascii=False) for i, r in enumerate(rows)]))


def entities(spark, rows, compose=True):
    return resolve.resolve_entities(resolve.normalize_postings(frame(spark, rows), now=NOW(), compose=compose), now=NOW()).orderBy("entity").collect()


def test_four_listings_are_two_jobs(spark):
    got = entities(spark, ROWS)
    assert [(r["entity"], r["duplicate_count"], r["source_count"]) for r in got] == [(0, 1, 2), (2, 1, 2)]
    assert got[0]["deadline_at"].isoformat() == "2026-08-31" and got[1]["deadline_at"].isoformat() == "2026-07-16"
    assert "보건관리자" in got[0]["role_tags"] and not got[0]["needs_review"]


def test_stay_apart(spark):
    base = {"company": "한빛병원", "title": "병동 간호사 모집", "region": "서울", "deadline": "2026-08-01"}
    rows = [base | {"id": "1", "source": "a"}, base | {"id": "2", "source": "a"}, base | {"id": "3", "source": "b", "region": "부산"}, base | {"id": "4", "source": "c", "deadline": "2026-09-01"}]
    assert len(entities(spark, rows)) == 4
    rows.append(base | {"id": "5", "source": "d"})  # fits 1 and 2, which so become one
    assert sorted(r["duplicate_count"] for r in entities(spark, rows)) == [0, 0, 2]


def test_same_id_same_source_and_url(spark):
    rows = [{"id": "1", "source": "a", "title": "x", "company": "p"}, {"id": "1", "source": "a", "title": "quite another", "company": "q"}, {"id": "9", "source": "b", "title": "third", "company": "r", "url": "https://u/1"}, {"id": "8", "source": "c", "title": "fourth", "company": "s", "url": "https://u/1"}, {"id": None, "source": "c", "title": "no id"}, {"id": "7", "source": "c", "title": " "}]
    assert sorted(r["duplicate_count"] for r in entities(spark, rows)) == [1, 1]


def test_order_does_not_matter(spark):
    rng = random.Random(2)
    rows = [{"id": str(i), "source": rng.choice("abc"), "company": f"c{rng.randint(0, 6)}", "title": f"t{rng.randint(0, 2)}", "region": rng.choice(["서울", "부산", ""]), "deadline": rng.choice(["2026-08-01", "2026-08-05", "2026-08-20", ""])} for i in range(80)]
    norm = resolve.normalize_postings(frame(spark, rows), now=NOW(), compose=False)

    def plain():
        got = [r.asDict() for r in norm.collect()]
        up = {r["ord"]: r["ord"] for r in got}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a in got:
            for b in got:
                if a["ord"] < b["ord"]:
                    if a["source"] == b["source"]:
                        ok = a["id"] == b["id"]
                    elif a["region_code"] and b["region_code"] and a["region_code"] != b["region_code"]:
                        ok = False
                    elif a["deadline_at"] and b["deadline_at"] and abs((a["deadline_at"] - b["deadline_at"]).days) > 7:
                        ok = False
                    else:
                        ok = bool(set(a["dedupe_keys"]) & set(b["dedupe_keys"]))
                    if ok:
                        x, y = sorted((root(a["ord"]), root(b["ord"])))
                        up[y] = x
        return {r["ord"]: root(r["ord"]) for r in got}

    comps = {r["id"]: r["component"] for r in connected_components(resolve.link_postings(norm)).collect()}
    assert {o: comps.get(o, o) for o in plain()} == plain()
    mixed = norm.orderBy(F.rand(1))
    assert {tuple(r) for r in connected_components(resolve.link_postings(mixed)).collect()} == {tuple(r) for r in connected_components(resolve.link_postings(norm)).collect()}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 7), (300, 300), (None, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(pairs, "l long, r long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[150] == got[200] == 100 and got[300] == 300
    assert connected_components(spark.createDataFrame([], "l long, r long")).count() == 0


def test_components_of_long_chains(spark):
    rng = random.Random(5)
    names = rng.sample(range(1000, 2000), 200)
    chains = [(i, i + 1) for i in range(249)] + [(a, b) for a, b in zip(names, names[1:], strict=False)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(chains, "l long, r long")).collect()}
    assert got == {i: 0 for i in range(250)} | {i: min(names) for i in names}
    words = [(f"w{i:03}", f"w{i + 1:03}") for i in range(99)]
    assert {tuple(r) for r in connected_components(spark.createDataFrame(words, "l string, r string")).collect()} == {(f"w{i:03}", "w000") for i in range(100)}


def test_links(spark):
    norm = resolve.normalize_postings(frame(spark, ROWS), now=NOW())
    links = resolve.entity_links(norm, connected_components(resolve.link_postings(norm)))
    assert {(r["entity"], r["source"]) for r in links.collect()} == {(0, "사람인"), (0, "고용24"), (2, "널스잡"), (2, "병원잡")}


def test_titles_of_one_company(spark):
    """Containment under one company, missing regions, deadlines and entries, ids of several entries: equal to all pairs."""
    rng = random.Random(11)
    words = ["산업보건", "보건관리자", "간호사모집", "수도권근무", "주간상근", "신규", "정규직우대"]
    full = ["".join(rng.choices(words, k=7)) for _ in range(4)]
    rows = []
    for i in range(160):
        title = rng.choice(full)[rng.randint(0, 9) : rng.randint(16, 40)]
        rows.append({"ord": i, "source_entry_id": rng.choice([None, None, "e1", "e2"]), "source": rng.choice(["사람인", "잡코리아", "x", "y"]), "id": str(rng.randint(0, 120)), "region_code": rng.choice(["11", "26", None]), "deadline_at": rng.choice([None, "2026-08-01", "2026-08-08", "2026-08-09", "2026-09-20"]), "url": "", "dedupe_key": f"k{rng.randint(0, 200)}", "dedupe_keys": [], "company_key": rng.choice(["a", "a", "b", ""]), "title_key": title})
    schema = "ord int, source_entry_id string, source string, id string, region_code string, deadline_at string, url string, dedupe_key string, dedupe_keys array<string>, company_key string, title_key string"
    norm = spark.createDataFrame(rows, schema).withColumn("deadline_at", F.to_date("deadline_at"))
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def day(r):
        return int(r["deadline_at"][5:7]) * 31 + int(r["deadline_at"][8:]) if r["deadline_at"] else None

    met = 0
    for a in rows:
        for b in rows[: a["ord"]]:
            both = a["source_entry_id"] and b["source_entry_id"]
            same = a["source_entry_id"] == b["source_entry_id"] if both else a["source"] == b["source"]
            if same:
                ok = a["id"] == b["id"]
            else:
                near = day(a) is None or day(b) is None or abs(day(a) - day(b)) <= 7
                s, t = sorted((a["title_key"], b["title_key"]), key=len)
                held = len(s) >= 10 and len(s) >= 0.6 * len(t) and s in t and a["company_key"] == b["company_key"] != "" and {a["source"], b["source"]} <= set(resolve.GENERAL_SOURCES)
                ok = (not a["region_code"] or not b["region_code"] or a["region_code"] == b["region_code"]) and near and (a["dedupe_key"] == b["dedupe_key"] or held)
                met += ok and held
            if ok:
                x, y = sorted((root(a["ord"]), root(b["ord"])))
                up[y] = x
    comps = {r["id"]: r["component"] for r in connected_components(resolve.link_postings(norm)).collect()}
    assert met > 20
    assert {i: comps.get(i, i) for i in range(len(rows))} == {i: root(i) for i in range(len(rows))}


def test_asked_fields_store_no_more_than_links_and_counts_read(spark, monkeypatch):
    made = {}
    stored = resolve.stored
    monkeypatch.setattr(resolve, "stored", lambda df, label: made.setdefault(label, stored(df, label)))
    norm = resolve.normalize_postings(frame(spark, ROWS), now=NOW(), compose=False)
    fields = list(resolve.COUNTED)
    some = resolve.resolve_entities(norm, now=NOW(), fields=fields)
    assert set(made["resolve-norm"].columns) == set(resolve.LINKING)
    assert made["resolve-keys"].groupBy("family", "key").count().where("count = 1").count() == 0  # rows alone under a key link nothing
    made.clear()
    whole = resolve.resolve_entities(norm, now=NOW())
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*fields).collect()))
    made.clear()
    assert resolve.resolve_entities(norm, now=NOW(), fields=["entity", "title"]).columns == ["entity", "title"]
    assert set(made["resolve-norm"].columns) == set(norm.columns)


def test_plain_dates_and_titles_read_as_by_the_other_notations(spark):
    from postloom.functions import dates, text

    df = spark.createDataFrame([("1996-06-20", "1996. 6. 20"), ("1996-02-30", "1996. 2. 30"), ("1896-02-03", "1896. 2. 3"), ("1996-06-20\n", "1996. 6. 20")], "a string, b string")
    for read in (dates.parse_deadline, dates.parse_published):
        for r in df.select(read(F.col("a"), NOW()).alias("x"), read(F.col("b"), NOW()).alias("y")).collect():
            assert r["x"] == r["y"]
    t = spark.createDataFrame([("Nurse (주) 모집공고 채용", "a"), ("ICU-Nurse 24", "nurse"), ("nurse", "Nurse")], "t string, c string")
    assert [r[0] for r in t.select(text.title_key(F.col("t"), F.col("c"))).collect()] == ["nurse", "icu24", "nurse"]
