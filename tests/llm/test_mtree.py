import numpy as np
from pyspark.sql import functions as F

from postloom.llm import mtree as m


def test_equals_brute_force_with_ties_and_copies(spark):
    rng = np.random.default_rng(0)
    v = rng.integers(-3, 4, size=(900, 6)).astype(float) / 256
    v[:250] = v[0]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(5000, None), (5050, [float("nan")] * 6), (5100, [None] * 6), (5150, [float("inf")] * 6), (None, [0.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(2), "tree": F.lit(3), "score": F.lit(4)})
    got = m.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5, tree_size=120, root_block=3).toPandas()
    scores = np.floor(v * 256).astype(int) @ np.floor(v * 256).astype(int).T
    assert sorted(got.query_id.unique()) == list(range(0, 900, 50))
    for q, g in got.groupby("query_id"):
        want = sorted([(-scores[q, j], j) for j in range(900) if j != q])[:5]
        assert [(-s, i) for s, i in zip(g.sort_values("rank").score, g.sort_values("rank").vec_id, strict=True)] == want


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (50, [1.0]), (3, [])], "vec_id long, embedding array<float>")
    got = m.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == [(0, 1, 50, 65536), (0, 2, 3, 0), (50, 1, 0, 65536), (50, 2, 3, 0)]
    assert m.top_k(df.limit(0), queries=F.lit(True)).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(1)
    v = rng.integers(-9, 10, size=(1500, 5)).astype(float)
    most = (v**2).sum(axis=1).max()
    pages = m.build_pages(v, np.sqrt(most - (v**2).sum(axis=1)))
    assert sum(len(p["rows"]) for p in pages if p["leaf"]) == 1500 and max(len(p["rows"]) for p in pages) <= m.PAGE
    q = rng.integers(-9, 10, 5).astype(float)
    got = m.search_pages(pages, v, float(most), [[i] for i in range(1500)], q, 6, None)
    assert got == sorted([(int(v[i] @ q), i) for i in range(1500)], key=lambda x: (-x[0], x[1]))[:6]


def test_scores_are_exact_for_large_components(spark):
    rng = np.random.default_rng(3)
    for size in (1e4, 1e6, 1e12):
        v = rng.normal(size=(120, 8)) * size
        df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(500, [1e300] * 8)], "vec_id long, embedding array<double>")
        got = m.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5, tree_size=40).collect()
        whole = {i: [int(np.floor(x * 256)) for x in row] for i, row in enumerate(v)} | {500: [2**63 - 1] * 8}
        clip = lambda s: max(-(2**63), min(2**63 - 1, s))
        for q in (0, 50, 100, 500):
            want = sorted([(-clip(sum(a * b for a, b in zip(whole[q], whole[j], strict=True))), j) for j in whole if j != q])[:5]
            assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want, (size, q)


def test_repeated_ids_leave_room_for_others(spark):
    rows = [(0, [1.0, 1.0])] * 9 + [(50, [1.0, 0.5])] * 3 + [(i, [0.1 * i, 0.2]) for i in range(1, 9)] + [(7, [5.0, 5.0])] * 8
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = m.top_k(df, queries=F.col("vec_id") % 50 == 0, k=5, tree_size=4).distinct().collect()
    for q in (0, 50):
        own = next(v for i, v in rows if i == q)
        score = lambda v, own=own: sum(int(np.floor(256 * a)) * int(np.floor(256 * b)) for a, b in zip(own, v, strict=True))
        want = sorted([(-score(v), i) for i, v in rows if i != q])[:5]
        assert [(-r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == want
