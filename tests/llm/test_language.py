import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np

from postloom.llm import language as m


def test_predicts_held_out_rows(spark):
    words = {"xx": ["kala", "meri", "talo", "puu", "vesi"], "yy": ["wasser", "haus", "baum", "fisch", "meer"]}
    rows = [(i, " ".join(words[k][(i * j) % 5] for j in range(1, 12)), k) for i in range(200) for k in words]
    rows = [(n, t, k) for n, (_, t, k) in enumerate(rows)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r["doc_id"]: r for r in m.predict_languages(df).collect()}
    assert all(out[n]["lang_pred"] == k and 0 <= out[n]["score"] <= 1 for n, _, k in rows) and any(r["held_out"] for r in out.values())
    model = m.fit(df)
    assert model.predict("kalassa talossa")[0] == "xx" and model.predict("hausbaum")[0] == "yy"
    assert model.predict("123 !")[0] == "und" == model.predict(None)[0]
    assert model.predict("a" * 300)[0] in ("xx", "yy")


def brute_force(rows, text):
    """Log likelihoods by plain dictionaries of strings; rows: (text, lang) that are learnt from."""
    words, grams = defaultdict(Counter), defaultdict(Counter)
    for t, lang in rows:
        for w in m.words_of(t):
            words[lang][w] += 1
            for n in (5, 4, 3, 2, 1):
                grams[lang].update(m.grams_of(w, n))
    langs = sorted(words)

    def logs(counts):
        every = set().union(*counts.values())
        total = {k: sum(counts[k].values()) + 0.5 * len(every) for k in langs}
        return {x: np.array([math.log((counts[k][x] + 0.5) / total[k]) for k in langs]) for x in every}

    of_word, of_gram = logs(words), logs(grams)
    out = np.zeros(len(langs))
    for w in m.words_of(text):
        if w in of_word:
            out += of_word[w]
            continue
        for step, n in enumerate((5, 4, 3, 2, 1)):
            known = [of_gram[g] for g in m.grams_of(w, n) if g in of_gram]
            if known:
                out += np.mean(known, axis=0) * 0.5**step
                break
    return out


def test_scores_are_those_of_brute_force(spark):
    rng = random.Random(4)
    word = lambda lang: "".join(rng.choice("aeiou" if lang == "xx" else "abcde") + rng.choice("klmn") for _ in range(rng.randrange(1, 5)))
    rows = [(i, " ".join(word(k) for _ in range(12)), k) for i in range(60) for k in ("xx", "yy", "zz")]
    rows = [(n, t, k) for n, (_, t, k) in enumerate(rows)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    learnt = [(t, k) for n, t, k in rows if zlib.crc32(str(n).encode()) % 4 != 2]
    for text in ("akela imoni", "kalassa aka aka", "q", "a" * 300, " ".join(word("xx") for _ in range(50)), "ßß aka"):
        assert np.allclose(model.totals(text), brute_force(learnt, text), atol=1e-3), text


def test_many_languages_cost_a_row_for_each_string(spark):
    rows = [(i, f"word{chr(97 + i % 26)}{chr(97 + i // 26)} common", f"l{i:03d}") for i in range(300)]
    model = m.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert len(model.langs) > 200 and len(model.words.gains) <= 2 * len(model.langs)


def test_odd_rows(odd_docs, no_docs):
    out = m.predict_languages(odd_docs).collect()
    assert len(out) == 9 and {r["lang_pred"] for r in out if r["doc_id"] in (2, 3, 6)} == {"und"}
    assert m.predict_languages(no_docs).count() == 0
