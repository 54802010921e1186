"""Toxicity from the nearest labelled examples by exact TF-IDF cosine."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored, text_batches

#: Words are runs of letters, in lower case.
_WORD = re.compile(r"[^\W\d_]+")
#: Examples of a block.
_BLOCK = 512
#: Terms of more than this part of the examples are kept as rows; changes the work only.
_OFTEN = 8
#: Lengths of the stems that stand beside words as terms.
_STEMS = (6,)


def term_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(term, count) of a text: words and stems (``stem+``: longer words that start so) by their 64-bit hash, in rising order."""
    n: Counter = Counter(_WORD.findall((text or "").lower()))
    for w, m in list(n.items()):
        for k in _STEMS:
            if len(w) > k:
                n[w[:k] + "+"] += m
    keys = map(str.encode, n, repeat("utf-8"), repeat("surrogatepass"))
    terms = np.fromiter(map(xxhash.xxh64_intdigest, keys), np.uint64, len(n)).view(np.int64)
    order = np.argsort(terms)
    return terms[order], np.fromiter(n.values(), np.float64, len(n))[order]


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from: the CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class ExampleIndex:
    """Inverted lists over unit vectors, cut into blocks of example numbers; of each list and block the largest weight is kept.

    The lists lie one after the other in flat arrays: ``cuts[t, b]`` is where the part of term t in block b starts. Terms
    of more than an eighth of the examples have a row with a weight for each example in ``rows`` instead.
    """

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, n_terms: int):
        self.labels, self.n = np.asarray(labels, float), len(vectors)
        self.n_blocks = -(-self.n // _BLOCK)
        term = np.concatenate([np.empty(0, np.int32), *[t.astype(np.int32) for t, _ in vectors]])
        weight = np.concatenate([np.empty(0, np.float32), *[w.astype(np.float32) for _, w in vectors]])
        example = np.repeat(np.arange(self.n, dtype=np.int32), [len(t) for t, _ in vectors])
        self.most = np.zeros((n_terms, self.n_blocks), np.float32)
        np.maximum.at(self.most.reshape(-1), term.astype(np.int64) * self.n_blocks + example // _BLOCK, weight)
        often = np.flatnonzero(np.bincount(term, minlength=n_terms) > self.n / _OFTEN)
        self.row = np.full(n_terms, -1, np.int32)
        self.row[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.n), np.float32)
        dense = self.row[term] >= 0
        self.rows[self.row[term[dense]], example[dense]] = weight[dense]
        term, weight, example = term[~dense], weight[~dense], example[~dense]
        order = np.argsort(term, kind="stable")  # the examples of a term stay in order
        self.weight, self.example = weight[order], example[order]
        part = term[order].astype(np.int64) * self.n_blocks + self.example // _BLOCK
        ends = np.cumsum(np.bincount(part, minlength=n_terms * self.n_blocks))
        self.cuts = np.r_[0, ends].astype(np.int32 if len(part) < 1 << 31 else np.int64)

    def frequent(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What the terms kept as rows add to the cosine of each query and example; one product for all queries."""
        q = np.zeros((len(vectors), len(self.rows)), np.float32)
        for i, (terms, weights) in enumerate(vectors):
            row = self.row[terms]
            q[i, row[row >= 0]] = weights[row >= 0]
        return q @ self.rows

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1, base: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(example, cosine) of the k examples of largest positive cosine with a unit query, in millionths, ties to the smaller number.

        A block's bound is the sum of its lists' largest weights times the query's. Blocks are scored whole, from the
        largest bound down, until a bound is below the k-th cosine found; those left can't hold a nearer one. base is the
        query's row of :meth:`frequent`, if the caller has it.
        """
        best, cosines = np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[terms]
        line = np.argsort(-bound, kind="stable")
        line = line[bound[line] > 0]
        row = self.row[terms]
        if base is None:
            base = weights[row >= 0] @ self.rows[row[row >= 0]]
        terms, weights = terms[row < 0], weights[row < 0]
        at, step = 0, 1
        while at < len(line) and not (len(best) == k and bound[line[at]] < cosines[-1] - 2e-6):
            now = np.sort(line[at : at + step])
            place = terms[:, None] * self.n_blocks + now
            start = self.cuts[place].ravel()
            size = self.cuts[place + 1].ravel() - start
            post = _spread(start, size)
            q = np.repeat(np.repeat(weights, place.shape[1]), size)
            scores = np.bincount(self.example[post], q * self.weight[post], self.n).astype(float)
            for b in now.tolist():
                scores[b * _BLOCK : (b + 1) * _BLOCK] += base[b * _BLOCK : (b + 1) * _BLOCK]
            if skip >= 0:
                scores[skip] = 0
            near = np.flatnonzero(scores > (cosines[-1] - 2e-6 if len(best) == k else 1e-9))
            best, cosines = np.concatenate([best, near]), np.concatenate([cosines, scores[near].round(6)])
            top = np.lexsort((best, -cosines))[:k]
            best, cosines = best[top], cosines[top]
            at, step = at + step, 2 * step
        return best, cosines


@dataclass
class ToxicityModel:
    """What scoring needs; its size is bounded by the words of the examples that it was fitted with."""

    terms: np.ndarray
    weights: np.ndarray
    base: float
    k: int
    power: float
    prior: float
    index: ExampleIndex = field(default_factory=lambda: ExampleIndex([], np.empty(0), 0))
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    steps: tuple[np.ndarray, np.ndarray] = (np.empty(0), np.empty(0))
    sent: Broadcast | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"sent": None}

    def broadcast(self, spark: SparkSession) -> Broadcast:
        """Sent once; without what :attr:`steps` gets later."""
        if self.sent is None:
            self.sent = spark.sparkContext.broadcast(self)
        return self.sent

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Known terms of a text and their weights, to length 1."""
        terms, counts = term_counts(text)
        if not len(self.terms) or not len(terms):
            return np.empty(0, np.int64), np.empty(0)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        known = self.terms[at] == terms
        return self.weighted(at[known], counts[known])

    def weighted(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(1 + ln tf) times the term's weight, to length 1."""
        w = (1 + np.log(counts)) * self.weights[terms]
        norm = np.sqrt(w @ w)
        return (terms, w / norm) if norm > 0 else (terms[:0], w[:0])

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        """Share of the nearest examples' labels, weighted by a power of the cosine; the base rate votes too."""
        w = cosines**self.power
        return float((w @ self.index.labels[near] + self.prior * self.base) / (w.sum() + self.prior))

    def calibrated(self, vote: float) -> float:
        x, y = self.steps
        return float(0.99 * np.interp(vote, x, y) + 0.01 * vote) if len(x) else vote

    def scores(self, texts: Iterable[str | None]) -> Iterator[tuple[float, np.ndarray, np.ndarray]]:
        """(score, nearest examples, their cosines) of each text, 64 at a time."""
        line = iter(texts)
        while now := [self.vector(t) for t in islice(line, 64)]:
            for (terms, weights), base in zip(now, self.index.frequent(now) if self.index.n else repeat(None), strict=False):
                near, cosines = self.index.search(terms, weights, self.k, base=base) if self.index.n else (np.empty(0, int), np.empty(0))
                yield (self.calibrated(self.vote(near, cosines)) if len(near) else self.base), near, cosines

    def score(self, text: str | None) -> tuple[float, np.ndarray, np.ndarray]:
        return next(self.scores([text]))


def _steps(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression of the labels on the votes by pooling adjacent violators."""
    pools: list[list[float]] = []
    for i in np.lexsort((labels, votes)).tolist():
        pools.append([votes[i], labels[i], 1.0])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            v, y, n = pools.pop()
            m = pools[-1]
            pools[-1] = [(m[0] * m[2] + v * n) / (m[2] + n) if m[0] != v else v, m[1] + y, m[2] + n]
    # a pool of few examples doesn't reach 0 or 1
    return np.array([p[0] for p in pools]), np.array([(p[1] + 0.5 * (p[1] > 0)) / (p[2] + 1) for p in pools])


def relevance(toxic: np.ndarray, others: np.ndarray, n_toxic: int, n_others: int) -> np.ndarray:
    """How much a term's presence tells of the label, 0 to 1: their mutual information in parts of the label's entropy.

    A factor of the weights, so that words of a subject don't outweigh those that examples of a label share. No term is left out:
    the least is 0.0001.
    """
    n = n_toxic + n_others
    part = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-300) / np.maximum(e, 1e-300)), 0.0)
    has, lacks = toxic + others, np.maximum(n - toxic - others, 1e-300)
    told = part(toxic, has * n_toxic / n) + part(others, has * n_others / n)
    told += part(n_toxic - toxic, lacks * n_toxic / n) + part(n_others - others, lacks * n_others / n)
    whole = -(n_toxic * np.log(n_toxic / n) + n_others * np.log(n_others / n))
    return np.maximum(told, 0) / whole + 1e-4


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    max_examples: int = 2500,
    k: int = 15,
    power: float = 4.0,
    prior: float = 0.05,
) -> ToxicityModel:
    """Fit on at most max_examples labelled rows that aren't held out, those of smallest hash of the id.

    Every term of the examples is in the model (see :func:`term_counts`). Its weight is its inverse document
    frequency over all rows of docs times its :func:`relevance`, which is counted over examples that differ: of
    those with one smallest shingle hash, as near copies have, one counts. Votes are calibrated on the
    examples, each left out of its own search. Rows with a null id, label or text, and labels other than 0 and 1,
    teach nothing; an id has the larger of its labels and the first of its texts. What reaches the driver and the
    workers is bounded by max_examples and the words of these examples.
    """
    spark = docs.sparkSession
    text_batches(spark)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(label_col).cast("int").alias("y"))
    two = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = stored(known.orderBy(F.xxhash64("id"), "id").limit(max_examples), "toxicity-sample")
    texts = two.where(F.col("text").isNotNull()).join(F.broadcast(sample), "id")
    texts = texts.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kin, terms, counts = [], [], []
            for t in b["text"]:
                words = [w.encode("utf-8", "surrogatepass") for w in _WORD.findall(t.as_py().lower())]
                grams = map(b" ".join, zip(words, words[1:], words[2:], strict=False)) if len(words) > 2 else [b" ".join(words)]
                kin.append(min(map(xxhash.xxh64_intdigest, grams)) >> 1)
                found, n = term_counts(t.as_py())
                terms.append(found.tobytes())
                counts.append(n.astype(np.float32).tobytes())
            cols = [b["id"], b["y"], pa.array(kin, pa.int64()), pa.array(terms, pa.binary()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", "kin", "terms", "counts"])

    ex = stored(texts.mapInArrow(prepare, "id long, y int, kin long, terms binary, counts binary"), "toxicity-examples")
    found = sorted(ex.collect(), key=lambda r: r["id"])
    y = np.array([r["y"] for r in found], float)
    base = float((y.sum() + 0.5) / (len(y) + 10))
    model = ToxicityModel(np.empty(0, np.int64), np.empty(0), base, k, power, prior)
    if not 0 < y.sum() < len(y):
        return model
    vectors = [(np.frombuffer(r["terms"], np.int64), np.frombuffer(r["counts"], np.float32)) for r in found]
    terms = np.unique(np.concatenate([t for t, _ in vectors]))
    seen, n, has = set(), [0, 0], np.zeros((2, len(terms)))
    for r, (t, _) in zip(found, vectors, strict=True):
        if (r["kin"], r["y"]) not in seen:
            seen.add((r["kin"], r["y"]))
            n[r["y"]] += 1
            has[r["y"], np.searchsorted(terms, t)] += 1
    n_docs, df = _document_frequencies(two.select("text"), terms)
    model.terms = terms
    model.weights = np.log((1 + n_docs) / (1 + df)) * relevance(has[1], has[0], n[1], n[0])
    vectors = [model.weighted(np.searchsorted(terms, t), c) for t, c in vectors]
    heaviest = [int(t[w.argmax()]) if len(t) else -1 for t, w in vectors]
    order = np.lexsort((np.arange(len(y)), heaviest, y))  # like examples share blocks
    model.index = ExampleIndex([vectors[i] for i in order], y[order], len(terms))
    model.ids = np.array([found[i]["id"] for i in order])
    del found, vectors
    sent = model.broadcast(spark)

    def left_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        places = {int(i): at for at, i in enumerate(m.ids)}
        for b in batches:
            votes = []
            for i, t, c in zip(b["id"].to_pylist(), b["terms"].to_pylist(), b["counts"].to_pylist(), strict=True):
                own = m.weighted(np.searchsorted(m.terms, np.frombuffer(t, np.int64)), np.frombuffer(c, np.float32))
                votes.append(m.vote(*m.index.search(*own, m.k, skip=places[i])))
            yield pa.RecordBatch.from_arrays([pa.array(votes, pa.float64()), b["y"]], ["vote", "y"])

    votes = ex.repartition(32, "id").mapInArrow(left_out, "vote double, y int").collect()
    model.steps = _steps(np.array([r["vote"] for r in votes]), np.array([r["y"] for r in votes], float))
    return model


def _document_frequencies(texts: DataFrame, terms: np.ndarray) -> tuple[int, np.ndarray]:
    """The number of all texts, and of those that hold each term; null texts hold none."""
    sent = texts.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        n, rows = np.zeros(len(known), np.int64), 0
        for b in batches:
            for t in b.column(0):
                own = term_counts(t.as_py())[0]
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                n[at[known[at] == own]] += 1
                rows += 1
        at = np.flatnonzero(n)
        for i in range(0, len(at), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[i : i + 50_000]), pa.array(n[at[i : i + 50_000]])], ["t", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([-1]), pa.array([rows])], ["t", "n"])

    sums = texts.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n"))
    df, rows = np.zeros(len(terms)), 0
    for b in sums.toArrow().to_batches():
        t, n = b["t"].to_numpy(), b["n"].to_numpy()
        df[t[t >= 0]] = n[t >= 0]
        rows += int(n[t < 0].sum())
    sent.unpersist()
    return rows, df


_OUT = pa.struct([("score", pa.float64()), ("evidence", pa.list_(pa.struct([("id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())])))])
_OUT_SQL = "struct<score:double,evidence:array<struct<id:bigint,cosine:double,toxic:int>>>"


def toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", *, shown: int = 5) -> Column:
    """A column for docs: score (0 to 1) and evidence, the up to ``shown`` nearest examples with cosine and label.

    Every whole text is scored where it stands, nothing is shuffled. Texts without a term of the model, null and
    empty ones among them, get the base rate and no evidence.
    """
    text_batches(docs.sparkSession)
    sent, steps = model.broadcast(docs.sparkSession), model.steps

    @F.arrow_udf(_OUT_SQL)
    def score(texts: pa.Array) -> pa.Array:
        m, rows = sent.value, []
        m.steps = steps
        for s, near, cosines in m.scores(t.as_py() for t in texts):
            shown_now = zip(near[:shown].tolist(), cosines[:shown].tolist(), strict=True)
            rows.append({"score": s, "evidence": [{"id": int(m.ids[e]), "cosine": c, "toxic": int(m.index.labels[e])} for e, c in shown_now]})
        return pa.array(rows, _OUT)

    return score(F.col(text_col))


def score_documents(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) for every row of docs, with a model fitted on docs and labels."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    scored = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), toxicity(docs, model, text_col).alias("t"))
    return scored.select("doc_id", "held_out", "t.score", (F.col("t.score") >= threshold).cast("int").alias("predicted"), "t.evidence")


def drop_toxic(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3, **how
) -> DataFrame:
    """docs without the rows that score at or above the threshold; their columns stay."""
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **how)
    return docs.where(toxicity(docs, model, text_col)["score"] < threshold)
