import random
import tracemalloc

import numpy as np

from postloom.llm import decontaminate as m


def plain_tiles(a, b, k):
    """Longest free common run first, by trying every pair of places."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not ua[i + n] and not ub[j + n]:
                    n += 1
                best = max(best, (n, -i, -j))
        if best[0] < k:
            return out
        n, i, j = best[0], -best[1], -best[2]
        ua[i : i + n] = ub[j : j + n] = [True] * n
        out.append(n)


def test_tiles_equal_plain_ones():
    rng = random.Random(4)
    for _ in range(60):
        item = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 25))]
        doc = [rng.choice("abcdefghxyz") for _ in range(30)] + item[5:] + ["x"] + item[:5] + [rng.choice("abxy") for _ in range(10)]
        got = list(m.BenchmarkIndex([(1, " ".join(item))], 3).matches(" ".join(doc)))
        want = plain_tiles(doc, item, 3)
        assert sorted(n for n, _, _ in got[0][3]) == sorted(want) if want else not got


def test_repetitive_pairs_get_the_same_tiles():
    rng = random.Random(6)
    for _ in range(80):
        alphabet = rng.choice(["a", "ab", "abcd"])
        doc = np.array([ord(rng.choice(alphabet)) for _ in range(rng.randint(3, 60))], np.uint64)
        item = np.array([ord(rng.choice(alphabet)) for _ in range(rng.randint(3, 30))], np.uint64)
        got = m.tile_repetitive(doc, item, 3)
        assert sorted(n for n, _, _ in got) == sorted(plain_tiles(doc.tolist(), item.tolist(), 3))
        assert all((doc[i : i + n] == item[j : j + n]).all() for n, i, j in got)


def test_a_page_of_one_word_takes_little_memory():
    index = m.BenchmarkIndex([(1, "spam " * 2000), (2, "spam egg " * 300)], 5)
    tracemalloc.start()
    found = {o: matched for o, _, matched, _ in index.matches("spam " * 50_000)}
    assert found == {1: 2000} and tracemalloc.get_traced_memory()[1] < 60e6
    tracemalloc.stop()


def test_short_items_are_found_whole(spark):
    bench = spark.createDataFrame([(1, "quick brown fox"), (2, "zebra"), (3, "")], "item_id long, text string")
    df = spark.createDataFrame([(1, "a Quick, brown fox ran"), (2, "brown quick fox"), (3, "the zebra"), (4, "quick brown")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in m.contaminated_pairs(df, bench).collect()) == [(1, 1), (3, 2)]
    assert sorted(r["doc_id"] for r in m.decontaminate(df, bench, block_chars=5).collect()) == [2, 4]


def test_reordered_and_clean(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi omicron pi rho sigma tau phi"
    w = item.split()
    docs = [(1, f"start {item.upper()}! end"), (2, " ".join(["x", *w[10:], "mid", *w[:10]])), (3, "alpha beta gamma delta epsilon but nothing else here"), (4, None), (5, ""), (6, "clean " * 5000), (1, item)]
    bench = spark.createDataFrame([(7, item), (8, "too short"), (9, None), (None, item), (10, "some other words that no document has at all")], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS item_id", "2 AS matched")
    for block in (4_000_000, 10):
        rows = m.contaminated_pairs(df, bench, block_chars=block).collect()
        assert sorted((r["doc_id"], r["item_id"], r["tiles"]) for r in rows) == [(1, 7, 1), (1, 7, 1), (2, 7, 2)]
    left = m.decontaminate(df, bench)
    assert left.columns == df.columns and sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5, 6]
    assert m.decontaminate(df, bench.limit(0)).count() == 7 and m.contaminated_pairs(df.limit(0), bench).count() == 0


def test_window_hashes():
    ids = np.arange(1, 9, dtype=np.uint64)
    assert len(np.unique(m._window_hashes(ids, 3))) == 6
