"""Language identification: known words first, shorter and shorter character n-grams for others."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored, text_batches

_WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the n-grams, in the order in which they are asked.
_ORDERS = (5, 4, 3, 2, 1)
#: N-gram numbers that a worker remembers for words outside the model; it starts anew beyond.
_KEPT = 2_000_000


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


def grams_of(word: str, n: int) -> list[str]:
    """Its n-grams with a mark at both ends."""
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


def _hashes(strings: Iterable[str], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, map(str.encode, strings)), np.uint64, n).view(np.int64)


def training_rows(id_col: str) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 != 2, F.lit(True))


@dataclass
class Frequencies:
    """Log frequencies by language of strings known by their 64-bit hash: what a language adds to its floor, where it has the string."""

    keys: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    gains: np.ndarray
    floor: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, langs: np.ndarray, counts: np.ndarray, n_langs: int) -> Frequencies:
        """From a row for each string and language that has it; every count has one half added, absent ones too."""
        order = np.lexsort((langs, keys))
        keys, langs, counts = keys[order], langs[order], counts[order]
        first = np.flatnonzero(np.r_[True, np.diff(keys) != 0]) if len(keys) else np.empty(0, np.int64)
        total = np.bincount(langs, counts, n_langs) + 0.5 * len(first)
        floor = np.log(0.5 / np.maximum(total, 0.5))
        gains = np.log(counts + 0.5) - np.log(0.5)
        return Frequencies(keys[first], np.r_[first, len(keys)], langs.astype(np.int32), gains.astype(np.float32), floor)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each string, -1 where it isn't known."""
        if not len(self.keys):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, at, -1)

    def total(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The sum by language of the strings' log frequencies times their weights."""
        size = self.starts[at + 1] - self.starts[at]
        ends = np.cumsum(size)
        rows = np.repeat(self.starts[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.langs[rows], self.gains[rows] * np.repeat(weights, size), len(self.floor)) + weights.sum() * self.floor


@dataclass
class LanguageModel:
    """Frequencies of words and n-grams; bounded by the texts it was fitted with, a row for each string and language that has it."""

    langs: list[str]
    words: Frequencies
    grams: Frequencies
    known: dict[str, tuple[int, np.ndarray]] = field(default_factory=dict)
    size: int = 0

    def backoff(self, word: str) -> tuple[int, np.ndarray]:
        """The step at which n-grams of the word are known, longest first, and their numbers."""
        if word not in self.known:
            found = (len(_ORDERS), np.empty(0, np.int64))
            for step, n in enumerate(_ORDERS):
                grams = grams_of(word, n)
                at = self.grams.find(_hashes(grams, len(grams)))
                if len(at := at[at >= 0]):
                    found = (step, at)
                    break
            if self.size > _KEPT:
                self.known.clear()
                self.size = 0
            self.known[word] = found
            self.size += len(found[1]) + len(word) + 10
        return self.known[word]

    def totals(self, text: str) -> np.ndarray:
        """Log likelihood by language: words by their frequency; of others the mean of their n-grams, halved for each shorter length."""
        counts = Counter(words_of(text))
        at = self.words.find(_hashes(counts, len(counts)))
        n = np.fromiter(counts.values(), float, len(counts))
        total = self.words.total(at[at >= 0], n[at >= 0])
        places, weights = [], []
        for word, known, times in zip(counts, (at >= 0).tolist(), n.tolist(), strict=True):
            if not known:
                step, grams = self.backoff(word)
                places.append(grams)
                weights.append(np.full(len(grams), times * 0.5**step / max(1, len(grams))))
        if places:
            total += self.grams.total(np.concatenate(places), np.concatenate(weights))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not _WORD.search(text or ""):
            return "und", 0.0
        total = self.totals(text or "")
        p = np.exp(total - total.max())
        best = int(p.argmax())
        return self.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 1000) -> LanguageModel:
    """Fit on about per_language texts of each language, those whose hash of the id is below its share.

    Only text and language of rows that aren't held out are read; rows with a null language or text teach nothing.
    All words of these texts and all n-grams of the words are in the model; each language's frequencies are
    smoothed by one half count. A language weighs what its words weigh, whatever its share of the documents. The
    driver gets a row for each string and language that has it, so the bound is per_language texts a language.
    """
    text_batches(docs.sparkSession)
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & training_rows(id_col))
    rows = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.col(id_col).alias("id"))
    sizes = stored(rows.groupBy("lang").count(), "language-sizes")
    if sizes.count() <= 10_000:
        sizes = F.broadcast(sizes)  # else the join deals the texts by language
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / F.lit(1_000_000.0)
    sample = rows.join(sizes, "lang").where(draw * F.col("count") < per_language).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in batches:
            for lang, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(t.as_py()))
        for lang, words in seen.items():
            grams: Counter = Counter()
            for w, n in words.items():
                for k in _ORDERS:
                    for g in grams_of(w, k):
                        grams[g] += n
            for kind, found in (("w", words), ("g", grams)):
                keys, counts = _hashes(found, len(found)), np.fromiter(found.values(), np.int64, len(found))
                for i in range(0, len(keys), 50_000):
                    m = len(keys[i : i + 50_000])
                    cols = [pa.array([lang] * m), pa.array([kind] * m), pa.array(keys[i : i + 50_000]), pa.array(counts[i : i + 50_000])]
                    yield pa.RecordBatch.from_arrays(cols, ["lang", "kind", "key", "n"])

    counted = sample.mapInArrow(count, "lang string, kind string, key long, n long")
    counted = stored(counted.groupBy("lang", "kind", "key").agg(F.sum("n").alias("n")), "language-counts")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    turn = {lang: i for i, lang in enumerate(langs)}

    def frequencies(kind: str) -> Frequencies:
        keys, names, counts = [], [], []
        for b in counted.where(F.col("kind") == kind).select("key", "lang", "n").toArrow().to_batches():
            own = b["lang"].dictionary_encode()
            number = np.array([turn[x] for x in own.dictionary.to_pylist()] or [0], np.int64)
            keys.append(b["key"].to_numpy())
            names.append(number[own.indices.to_numpy()])
            counts.append(b["n"].to_numpy())
        join = lambda x: np.concatenate([np.empty(0, np.int64), *x])
        return Frequencies.of(join(keys), join(names), join(counts), len(langs))

    return LanguageModel(langs, frequencies("w"), frequencies("g"))


_OUT = pa.struct([("lang", pa.string()), ("score", pa.float64())])


def language(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> Column:
    """A column for docs: (lang, score) of every whole text, scored where it stands.

    lang is a learnt language, ``und`` if the text is null, empty or has no letter (score 0); of equal scores the
    first language by name. score is the share of the best language if all were as likely beforehand.
    """
    text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        m = sent.value
        return pa.array([dict(zip(("lang", "score"), m.predict(t.as_py()), strict=True)) for t in texts], _OUT)

    return predict(F.col(text_col))


def predict_languages(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs, with a model fitted on docs; a null id is not held out."""
    model = fit(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, **how)
    out = docs.select(F.col(id_col).alias("doc_id"), (~training_rows(id_col)).alias("held_out"), language(docs, model, text_col).alias("p"))
    return out.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), "p.score")
