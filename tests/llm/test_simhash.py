import random
import re

import numpy as np
import xxhash

from postloom.llm import simhash as m


def slow(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_the_plain_one():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 50):
        text = " ".join(rng.choice(["The", "été", "x y", "ÀB", "dog"]) for _ in range(n)) + "\x0b"
        assert m.simhash(text, 3) == slow(text, 3)
    assert m.simhash(None, 3) == 0 == m.simhash(" \n", 3)


def test_components_equal_brute_force_with_crowded_segments(spark):
    rng = np.random.default_rng(3)
    half = int(rng.integers(0, 1 << 31)) << 32
    fps = [half | int(x) for x in rng.integers(0, 1 << 32, 150)]  # one key of many fingerprints
    for f in list(fps[:40]):
        fps.append(f ^ (1 << int(rng.integers(0, 63))) ^ (1 << int(rng.integers(0, 63))))
    fps += [int(x) for x in rng.integers(0, 1 << 63, 60)]
    fps = sorted({f & ((1 << 63) - 1) for f in fps})
    df = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, id long")
    got = {tuple(r) for r in m.near_pairs(df, 3, bucket=16, block=32).collect()}
    true = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}

    def comps(pairs):
        up = list(range(len(fps)))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in sorted(pairs):
            a, b = sorted((root(a), root(b)))
            up[b] = a
        return [root(i) for i in range(len(fps))]

    assert comps(got) == comps(true) and true


def test_odd_rows(odd_docs, no_docs):
    rows = m.simhash_components(odd_docs).collect()
    assert len(rows) == 8 and {r["component_id"] for r in rows if r["id"] in (1, 5)} == {1}
    assert {r["fingerprint"] for r in rows if r["id"] in (2, 3, 6)} == {"0" * 16} and {r["component_id"] for r in rows if r["id"] in (2, 3, 6)} == {2}
    kept = m.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 2, 4, 8]
    assert m.simhash_components(no_docs).count() == 0 == m.drop_near_duplicates(no_docs).count()
