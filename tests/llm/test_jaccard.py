import random
from fractions import Fraction

import corpus_pipeline
from postloom.llm import jaccard as m


def grams(text):
    words = text.lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or {" ".join(words)} - {""}


def least_ids(texts):
    sets, up = [grams(t) for t in texts], list(range(len(texts)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i for i in range(len(texts)) if root(i) == i}


def texts():
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(3000)}"
    out = ["", "one", "One", "two words", " \n"]
    for n in (20, 30, 60, 100, 200):
        for _ in range(6):
            first = [word() for _ in range(n)]
            for edits in (0, 0, 1, 2, 3, 5):
                copy = list(first)
                for at in rng.sample(range(n), min(edits, n)):
                    copy[at] = word()
                out.append(" ".join(copy))
    many = [word() for _ in range(120)]
    for _ in range(60):  # a crowded group
        copy = list(many)
        for at in rng.sample(range(120), 3):
            copy[at] = word()
        out.append(" ".join(copy))
    line = "a line that stands in very many of the texts here"
    out += [f"{line} {' '.join(word() for _ in range(rng.randrange(1, 12)))}" for _ in range(60)]
    rng.shuffle(out)
    return out


def test_stage_drops_what_brute_force_finds(spark):
    all_texts = texts()
    docs = spark.createDataFrame(list(enumerate(all_texts)), "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert kept == sorted(least_ids(all_texts))
    links = m.similar_pairs(docs.withColumnRenamed("doc_id", "id"), 5, Fraction(4, 5), bucket=8, limit=16)
    gone = {r["id"] for r in m.connected_components(links).where("id <> component").collect()}
    assert sorted(set(range(len(all_texts))) - gone) == kept


def test_odd_rows(odd_docs, no_docs):
    kept = m.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 8]
    assert m.drop_near_duplicates(no_docs).count() == 0
