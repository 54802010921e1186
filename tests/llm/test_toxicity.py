import re
import zlib
from collections import Counter

import numpy as np
import xxhash
from pyspark.sql import functions as F

from postloom.llm import toxicity as m


def test_block_max_search_is_brute_force():
    rng = np.random.default_rng(5)

    def some():
        t = np.sort(rng.choice(12, rng.integers(1, 5), replace=False))
        w = rng.random(len(t)) + 0.1
        return t, w / np.sqrt(w @ w)

    vectors = [some() for _ in range(1700)]
    vectors[5:60] = [vectors[4]] * 55
    index = m.ExampleIndex(vectors, np.zeros(1700), 12)
    for _ in range(60):
        q = dict(zip(*some(), strict=True))
        scores = [(round(sum(q.get(t, 0) * float(np.float32(w)) for t, w in zip(*v, strict=True)), 6), e) for e, v in enumerate(vectors)]
        want = sorted([x for x in scores if x[0] > 0], key=lambda x: (-x[0], x[1]))[:15]
        got, cosines = index.search(np.array(list(q)), np.array(list(q.values())), 15)
        assert got.tolist() == [e for _, e in want] and np.allclose(cosines, [c for c, _ in want])


def test_score_is_the_vote_of_a_brute_force_search(spark):
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    rows = [(i, " ".join(rng.choice(words, 12)) + (" scoundrelly knave" if i % 3 == 0 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(200)], "doc_id long, toxic int")
    model = m.fit(docs, labels, k=7)

    def bag(text):
        n = Counter(re.findall(r"[a-z]+", text))
        for w, c in list(n.items()):
            for k in (6,):
                if len(w) > k:
                    n[w[:k] + "+"] += c
        return n

    bags = [bag(t) for _, t in rows]
    learnt = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 != 2]
    gram = lambda i: min(xxhash.xxh64_intdigest(" ".join(g)) for g in zip(*(rows[i][1].split()[k:] for k in range(3)), strict=False))
    differ = list({(gram(i), i % 3 == 0): i for i in learnt[::-1]}.values())
    n1 = sum(i % 3 == 0 for i in differ)
    weight = {}
    for w in set().union(*[bags[i] for i in learnt]):
        table = Counter((w in bags[i], i % 3 == 0) for i in differ)
        told = whole = 0.0
        for (has, bad), c in table.items():
            rest = sum(v for (h, _), v in table.items() if h == has) * sum(v for (_, y), v in table.items() if y == bad) / len(differ)
            told += c * np.log(c / rest)
        for c in (n1, len(differ) - n1):
            whole -= c * np.log(c / len(differ))
        weight[w] = np.log(201 / (1 + sum(w in b for b in bags))) * (told / whole + 1e-4)
    vector = lambda b: {w: (1 + np.log(c)) * weight[w] for w, c in b.items() if w in weight}
    unit = lambda v: {w: x / sum(y * y for y in v.values()) ** 0.5 for w, x in v.items()}
    examples = {i: unit(vector(bags[i])) for i in learnt}
    for i in [0, 1, 2, 6, 7, *range(100, 120)]:
        q = unit(vector(bags[i]))
        near = sorted(((sum(q.get(w, 0) * x for w, x in v.items()), e) for e, v in examples.items()), reverse=True)[:7]
        votes = [(c**4, e % 3 == 0) for c, e in near]
        want = (sum(c for c, bad in votes if bad) + 0.05 * model.base) / (sum(c for c, _ in votes) + 0.05)
        score, found, cosines = model.score(rows[i][1])
        assert np.allclose(cosines, [c for c, _ in near], atol=1e-5)
        assert np.isclose(model.vote(found, cosines), want, atol=1e-4) and np.isclose(score, model.calibrated(want), atol=1e-2)


def test_one_example_for_each_id_and_evidence_for_each_known_word(spark):
    docs = spark.createDataFrame([(1, "idle words here"), (1, "idle words there"), (3, "a rude fool spoke")] * 300 + [(4, "one spoke")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (3, 1), (3, 1), (4, 0)], "doc_id long, toxic int")
    model = m.fit(docs, labels, max_examples=3)
    assert 1 < len(model.ids) <= 3 and len(set(model.ids.tolist())) == len(model.ids)
    scored = docs.select(m.toxicity(docs, m.fit(docs, labels)).alias("t")).where(F.size("t.evidence") == 0)
    assert scored.count() == 0


def test_calibration_rises():
    x, y = m._steps(np.array([0.1, 0.2, 0.2, 0.3, 0.9]), np.array([0.0, 1, 0, 0, 1]))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= 0).all()


def test_learns_and_holds_out(spark):
    rng = np.random.default_rng(2)
    words = [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(20) for j in range(20)]
    rows, labels = [], []
    for i in range(1200):
        text = list(rng.choice(words, 40))
        bad = i % 5 == 0
        if bad:
            text[int(rng.integers(0, 40))] = "scoundrel" if i % 2 else "knave"
        rows.append((i, " ".join(text)))
        labels.append((i, int(bad)))
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = m.score_documents(docs, lab).toPandas().set_index("doc_id")
    assert 0.15 < out.held_out.mean() < 0.35
    truth = np.array([y for _, y in labels])
    assert (out.loc[range(1200)].predicted.to_numpy() == truth).mean() > 0.98
    assert out.score.between(0, 1).all()
    hidden = lab.where(m.held_out())
    blind = m.fit(docs, hidden)
    assert not len(blind.terms)


def test_odd_rows(odd_docs, no_docs, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (4, None)], "doc_id long, toxic int")
    out = m.score_documents(odd_docs, labels)
    assert out.count() == 9 and out.where("score IS NULL").count() == 0
    assert m.drop_toxic(odd_docs, labels).columns == odd_docs.columns
    assert m.score_documents(no_docs, labels).count() == 0
    assert m.score_documents(odd_docs, labels.limit(0)).count() == 9
