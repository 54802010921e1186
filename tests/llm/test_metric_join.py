import random
import time
from fractions import Fraction

import numpy as np

from postloom import storage
from postloom.llm import jaccard, metric_join as m


def jac(x, y):
    return Fraction(len(x & y), len(x | y)) if x or y else Fraction(1)


def comps(ids, links):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {i: root(i) for i in ids}


def plain(rows, k=4, least=Fraction(85, 100)):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        grams = {b" ".join(w[j : j + k]) for j in range(len(w) - k + 1)} or ({b" ".join(w)} if w else set())
        sets[i] = grams
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and jac(sets[a], sets[b]) >= least]
    return {i: (len(s), comps(sets, links)[i]) for i, s in sets.items()}


def corpus(rng, n):
    stock = ["  ".join(f"s{k}w{j}" for j in range(12)) for k in range(8)]
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(4)]
    out = []
    for _ in range(n):
        w = rng.choice([*base, base[0], base[0]]).split()
        for _ in range(rng.randrange(0, 6)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(1000)}"
        out.append(rng.choice([" ".join(w), " ".join(w), " ".join(rng.sample(stock, 3)), "A b", "", " ".join(rng.sample(stock, 2)) + " End"]))
    return out


def test_components_equal_brute_force(spark):
    rng = random.Random(8)
    rows = [(i, t) for i, t in enumerate([*corpus(rng, 220), None, "ONE two three four", "one two three four", "one two three"])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    assert len({c for _, c in want.values()}) < len(rows) - 60
    got = {r["id"]: (r["n_shingles"], r["component_id"]) for r in m.jaccard_components(df).collect()}
    assert got == want
    two = df.withColumnRenamed("doc_id", "id")
    links = jaccard.similar_pairs(two, 4, Fraction(85, 100), bucket=4, limit=8, empty_alike=False).collect()
    assert comps(want, map(tuple, links)) == {i: c for i, (_, c) in want.items()}


def test_voronoi_regions_keep_near_pairs_together(spark):
    rng = random.Random(9)
    centers = [frozenset(rng.sample(range(5000), 40)) for _ in range(6)]
    sets = [frozenset(rng.choice(centers) ^ set(rng.sample(range(5000), rng.randrange(0, 8)))) for _ in range(150)]
    members = spark.createDataFrame([(1, i, i) for i in range(len(sets))], "region long, id long, color long")
    own = spark.createDataFrame([(i, bytearray(np.array(sorted(s), np.int64).tobytes())) for i, s in enumerate(sets)], "id long, own binary")
    got = m.voronoi_regions(members, own, 0.15, pivots=6, limit=30).collect()
    held = {}
    for r in got:
        held.setdefault(r["region"], set()).add(r["id"])
    near = [(a, b) for a in range(150) for b in range(a) if 1 - jac(sets[a], sets[b]) <= Fraction(15, 100)]
    assert near and all(any(a in h and b in h for h in held.values()) for a, b in near)
    assert max(map(len, held.values())) < 100 and len(held) > 1


def test_stock_sentences_without_near_pairs_do_not_clump(spark):
    rng = random.Random(10)
    stock = [" ".join(f"s{k}w{j}" for j in range(10)) for k in range(80)]
    rows = [(i, " ".join([*rng.sample(stock, 2), *(f"d{i}w{j}" for j in range(3))])) for i in range(8000)]
    df = spark.createDataFrame(rows, "id long, text string")
    jaccard.similar_pairs(df.limit(50), 5, Fraction(4, 5)).count()
    began = time.time()
    links = {tuple(sorted(r)) for r in jaccard.similar_pairs(df, 5, Fraction(4, 5)).collect()}
    assert time.time() - began < 90  # 20 s on a free machine
    sets = {i: {tuple(w[j : j + 5]) for j in range(len(w) - 4)} for i, t in rows for w in [t.split()]}
    assert all(jac(sets[a], sets[b]) >= Fraction(4, 5) for a, b in links)
    assert len(links) < 100


def test_shingles_of_a_twentieth_of_the_texts_crowd_no_region(spark, monkeypatch):
    tables, real = {}, jaccard.stored
    monkeypatch.setattr(jaccard, "stored", lambda df, label: tables.setdefault(label, real(df, label)))
    monkeypatch.setattr(jaccard, "_SAMPLE", 20)  # as 20,000 are to two million texts
    stock = [" ".join(f"s{k}w{j}" for j in range(12)) for k in range(20)]
    rows = [(i, " ".join([stock[i % 20], *(f"d{i // 2 if i < 40 else i}w{j}" for j in range(100))])) for i in range(2000)]
    rows = [(i, t.replace("s1w", "s0w") if i < 40 else t) for i, t in rows]
    df = spark.createDataFrame(rows, "id long, text string")
    links = {tuple(sorted(r)) for r in jaccard.similar_pairs(df, 4, Fraction(85, 100)).collect()}
    sets = {i: {tuple(w[j : j + 4]) for j in range(len(w) - 3)} for i, t in rows[:40] for w in [t.split()]}
    assert links == {(a, b) for a in sets for b in sets if a < b and jac(sets[a], sets[b]) >= Fraction(85, 100)} != set()
    assert tables["jaccard-crowd"].isEmpty()


def test_bitmap_loses_no_row(spark):
    rows = spark.range(20_000).selectExpr("id", "cast(id % 7 as string) AS text")
    marks = spark.range(0, 20_000, 9).selectExpr("id", "cast(id % 7 as string) AS text")
    for cols in (("id",), ("id", "text")):
        kept = {r["id"] for r in jaccard._perhaps(rows, marks, *cols).collect()}
        assert set(range(0, 20_000, 9)) <= kept and len(kept) < 2_300
    assert jaccard._perhaps(rows, marks.limit(0), "id").isEmpty()


def test_tables_on_the_way_go(spark):
    first = len(storage._MADE)
    assert m.jaccard_components(spark.createDataFrame([(1, "a b c d e"), (2, "a b c d e"), (3, "f")], "doc_id long, text string")).count() == 3
    left = {path.rsplit("/", 1)[1].rsplit("-", 1)[0] for path in storage._MADE[first:]}
    assert "jaccard-rows" in left and not left & {"jaccard-shared", "jaccard-pairs", "jaccard-sets", "jaccard-bits"}


def test_odd_rows(odd_docs, no_docs):
    rows = m.jaccard_components(odd_docs).collect()
    assert len(rows) == 8 and {r["component_id"] for r in rows if r["id"] in (1, 5)} == {1}
    assert all((r["n_shingles"], r["component_id"]) == (0, r["id"]) for r in rows if r["id"] in (2, 3, 6))
    assert {r["n_shingles"] for r in rows if r["id"] == 4} == {1}
    assert m.jaccard_components(no_docs).count() == 0
