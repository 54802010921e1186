"""Token counts of whole texts, with whole-token words counted from a table."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import text_batches

#: Words beside the vocabulary that a worker remembers.
_KEPT = 500_000
_SPACE = "▁"


def whole_tokens(path: str) -> frozenset[str]:
    """The words of the vocabulary that the model encodes as one token when a space (or the start) stands before them.

    Merges never cross a space, so such a word is one token in every text; each vocabulary string is put to the
    proof by encoding it alone.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    words = [p[1:] for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i)) and (p := model.id_to_piece(i))[:1] == _SPACE and p[1:]]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1), strict=True) if len(ids) == 1)


class PieceCounter:
    """Counts as sentencepiece gives them for a BPE model.

    The table of :func:`whole_tokens` answers for most words. Others are merged by the library once and remembered
    (500,000 at most). Cutting texts at single spaces is sound as no piece holds a space after another character;
    line feeds are cut out too if no piece holds one (they are then bytes on their own). A text with runs of
    spaces, a space at an end or a literal U+2581 is encoded by the library whole, as are all texts of a model
    that breaks these rules or normalises them.
    """

    def __init__(self, path: str, whole: frozenset[str]):
        import sentencepiece

        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_byte(i) or m.is_unknown(i))]
        inner = any(_SPACE in p.lstrip(_SPACE) or (p[:2] == 2 * _SPACE and p.strip(_SPACE)) for p in pieces)
        self.by_word = not inner and m.encode("  a", out_type=str)[0] == 2 * _SPACE and m.encode("a", out_type=str)[0] == f"{_SPACE}a"
        self.by_line = not any("\n" in p for p in pieces) and len(m.encode("\n")) == 2
        self.known = dict.fromkeys(whole, 1)
        self.line_start: dict[str, int] = {"": 0}

    def _count(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)] if texts else []

    def counts(self, texts: list[str]) -> list[int]:
        out = [0] * len(texts)
        whole: list[int] = []
        cut: list[tuple[int, int, list[str], list[str]]] = []
        for i, t in enumerate(texts):
            if not t:
                continue
            if not self.by_word or "  " in t or t[0] == " " or t[-1] == " " or _SPACE in t:
                whole.append(i)
                continue
            words, starts, lines = [], [], 0
            if self.by_line and "\n" in t:
                first, *rest = t.split("\n")
                lines = len(rest)
                words = first.split(" ")
                for line in rest:
                    start, *more = line.split(" ")
                    starts.append(start)
                    words += more
            else:
                words = t.split(" ")
            cut.append((i, lines, words, starts))
        known, line_start = self.known, self.line_start
        new = list({w for _, _, words, _ in cut for w in words if w not in known})
        #: a space alone (before a line feed, or where a text starts with one) is one token
        fresh = {w: n if w else 1 for w, n in zip(new, self._count(new), strict=True)}
        new = list({w for _, _, _, starts in cut for w in starts if w not in line_start})
        fresh_starts = {w: n - 2 for w, n in zip(new, self._count(["\n" + w for w in new]), strict=True)}
        if len(known) < _KEPT:
            known |= fresh
        if len(line_start) < _KEPT:
            line_start |= fresh_starts
        for i, lines, words, starts in cut:
            out[i] = lines + sum([known[w] if w in known else fresh[w] for w in words]) + sum([line_start[w] if w in line_start else fresh_starts[w] for w in starts])
        for i, n in zip(whole, self._count([texts[i] for i in whole]), strict=True):
            out[i] = n
        return out


@functools.cache
def _counter(path: str, whole: frozenset[str]) -> PieceCounter:
    return PieceCounter(path, whole)


def token_counts(docs: DataFrame, tokenizer: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", batch: int = 512) -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit) of every whole text for the sentencepiece BPE model at tokenizer.

    No begin, end or other special token is added and special strings in texts are ordinary text. Null texts count
    as empty: no bytes, no tokens. Each row of docs gives one, repeated and null ids too; other columns are
    not read. The table of whole-token words is made once here and sent with the tasks: it is at most as large
    as the vocabulary.
    """
    text_batches(docs.sparkSession)
    whole = docs.sparkSession.sparkContext.broadcast(whole_tokens(tokenizer))
    two = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                n = _counter(tokenizer, whole.value).counts(part.column(1).to_pylist())
                sizes = pc.cast(pc.binary_length(part.column(1)), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    out = T.StructType([two.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return two.mapInArrow(run, out).withColumn("over_limit", F.col("n_tokens") > limit)
