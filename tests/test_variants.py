import json
import random
import re

from pyspark.sql import functions as F

from postloom.sources import variants as m


def render(x):
    if not isinstance(x, dict):
        return ""
    kids = x["content"] if isinstance(x.get("content"), list) else []
    kind, each = x.get("type"), [render(k) for k in kids]
    if kind == "text":
        return str(x.get("text") or "")
    if kind == "hardBreak":
        return "\n"
    if kind == "bulletList":
        return "\n".join(f"• {t.strip()}" for t in each if t.strip())
    if kind == "orderedList":
        return "\n".join(f"{n}. {t.strip()}" for n, t in enumerate(each, 1) if t.strip())
    return {"doc": "\n\n", "listItem": "\n"}.get(kind, "").join(t for t in each if t or kind not in ("doc", "listItem"))


def plain(x):
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[ \t]+\n", "\n", render(x))).strip()[:20_000]


def tree(rng, depth):
    if depth == 0 or rng.random() < 0.2:
        return rng.choice([{"type": "text", "text": rng.choice(["가 나", "word ", "", "x\n\n\ny"])}, {"type": "hardBreak"}, {"type": "text"}, {}])
    return {"type": rng.choice(["doc", "bulletList", "orderedList", "listItem", "paragraph", "heading"]), "content": [tree(rng, depth - 1) for _ in range(rng.randrange(0, 4))]}


def test_rich_text_equals_a_walk(spark):
    rng = random.Random(17)
    trees = [tree(rng, 5) for _ in range(60)]
    deep = {"type": "text", "text": "deep"}
    for _ in range(14):
        deep = {"type": "paragraph", "content": [deep]}
    trees.append(deep)
    df = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)] + [(900, None), (901, "{broken")], "k int, body string")
    got = {r["k"]: r["text"] for r in m.rich_texts(df.select("k", F.try_parse_json("body").alias("node")), key="k").collect()}
    assert got == {i: plain(t) for i, t in enumerate(trees)} and "deep" in got[60] and len(set(got.values())) > 12


def test_detail_json_becomes_a_posting(spark):
    item = {"data": {"title": "간호사", "company": {"name": "한빛"}, "employeeTypes": ["정규직", "계약직"], "regions": [], "status": "ACTIVE", "endDate": "2026-07-14", "summary": {"type": "doc", "content": [{"type": "paragraph", "content": [{"type": "text", "text": "첫 줄"}]}]}}}
    closed = {"data": {"title": "x", "status": "CLOSED"}}
    df = spark.createDataFrame([(1, json.dumps(item)), (2, json.dumps(closed)), (3, "<html>"), (4, None)], "k int, body string")
    got = {r["k"]: r for r in m.posting_of_detail(df, m.ZIGHANG, key="k").collect()}
    assert (got[1]["title"], got[1]["company"], got[1]["employment"], got[1]["region"], got[1]["description"], got[1]["closed"]) == ("간호사", "한빛", "정규직 · 계약직", None, "첫 줄", False)
    assert got[2]["closed"] and got[2]["description"] is None and not got[3]["is_json"] and got[4]["title"] is None
    k = spark.createDataFrame([(1, json.dumps({"title": "t", "jobDescription": "<p>d</p>", "careerType": "NEW_CAREER"}))], "k int, body string")
    assert m.posting_of_detail(k, m.KUMC, key="k").select("experience", "description").first() == ("신입·경력", "<p>d</p>")


def test_first_posting_of_a_graph(spark):
    graph = {"@graph": [{"@type": "Organization", "x": {"@type": "JobPosting", "title": "inner"}}, {"@type": ["Thing", "JobPosting"], "title": "outer"}]}
    df = spark.createDataFrame([(1, json.dumps(graph)), (2, json.dumps([{"a": 1}, {"@type": "JobPosting", "title": "second"}])), (3, "{}")], "k int, body string")
    got = {r["k"]: r["t"] for r in m.first_of_type(df.select("k", F.try_parse_json("body").alias("node")), "JobPosting", key="k").select("k", F.try_variant_get("node", "$.title", "string").alias("t")).collect()}
    assert got == {1: "inner", 2: "second"}


def test_levels_of_trees_are_not_broadcast(spark, monkeypatch):
    plans, real = [], m.stored
    monkeypatch.setattr(m, "stored", lambda df, label: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, label))[1])
    doc = '{"type":"doc","content":[{"type":"listItem","content":[{"type":"text","text":"a"}]}]}'
    roots = spark.createDataFrame([(1, doc)], "k int, j string").select("k", F.try_parse_json("j").alias("node"))
    assert [r["text"] for r in m.rich_texts(roots, key="k").collect()] == ["a"]
    assert not any("Broadcast" in p for p in plans) and any("SortMergeJoin" in p for p in plans)


def test_long_text_is_whole(spark):
    lines = [f"줄 {i} " + "x" * 300 for i in range(200)]
    doc = {"type": "doc", "content": [{"type": "bulletList", "content": [{"type": "listItem", "content": [{"type": "text", "text": x}]} for x in lines]}]}
    roots = spark.createDataFrame([(1, json.dumps(doc))], "k int, j string").select("k", F.try_parse_json("j").alias("node"))
    assert m.rich_texts(roots, key="k").first()["text"] == "\n".join(f"• {x}" for x in lines)
