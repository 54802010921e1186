import random

from pyspark.sql import functions as F

from postloom.operators import trigrams as m


def test_index_finds_what_a_scan_finds(spark):
    rng = random.Random(15)
    letters = "abAB é가나 "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab")]
    df = spark.createDataFrame(texts, "ord int, search_text string")
    asked = [(k, "".join(rng.choice(letters) for _ in range(n))) for k, n in enumerate([0, 1, 1, 2, 2, 3, 3, 4, 4, 5, 6, 7, 8] * 2)] + [(90, None), (91, "zzzz"), (92, "z"), (93, texts[7][1]), (94, " ab  "), (95, "abab")]
    got = {tuple(r) for r in m.find_texts(df, m.gram_index(df), spark.createDataFrame(asked, "query_id int, words string")).collect()}
    want = {(k, i) for k, w in asked if w is not None for i, t in texts if w.strip().lower() in (t or "").lower()}
    assert got == want and len(want) > 300
    index, counts = m.gram_index(df)
    assert counts.agg(F.sum("rows")).first()[0] == index.count()


def test_only_rows_of_asked_pieces_are_touched(spark):
    df = spark.range(3000).select(F.col("id").alias("ord"), F.concat(F.lit("posting number "), F.lpad(F.col("id").cast("string"), 6, "0")).alias("search_text"))
    index = m.gram_index(df)
    plan = index[0].where("gram = '777'")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(gram), EqualTo(gram,777)]" in plan
    found = m.find_texts(df, index, spark.createDataFrame([(1, "Number 002777")], "query_id int, words string"))
    assert [r["ord"] for r in found.collect()] == [2777]
    touched = index[0].where(F.col("gram").isin("277", "777", "027")).count()
    assert touched < 400 < index[0].count() / 100
