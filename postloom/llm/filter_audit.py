"""What each of several filters removes in every order, with duplicates found by radix tries over whole texts."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ranks import ordered_parts, prefix_sums
from ..storage import stored, text_batches

#: Characters of the first prefixes, and how many times longer each next level is.
_FIRST, _TIMES = 8, 8
#: Characters of texts that a task holds before it passes on what its trie has, and the most that a range of prefixes should have.
_HELD, _RANGE = 32_000_000, 128_000_000

_UPPER = bytes(range(65, 91))
_SIGNS = b"#$%&*|"

#: A check says whether a text fails: of (text, its UTF-8 bytes, its words).
Check = Callable[[str, bytes, list[bytes]], bool]


def few_words(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(words) < 50


def repetitive(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * len(set(words)) < 65 * len(words)


def shouting(text: str, raw: bytes, words: list[bytes]) -> bool:
    return 100 * (len(raw) - len(raw.translate(None, _UPPER))) > 5 * len(text)


def odd_signs(text: str, raw: bytes, words: list[bytes]) -> bool:
    return len(raw.translate(None, _SIGNS)) < len(raw)


#: The letters of the checks of a text; the letter after the last is that of the duplicates.
CHECKS: tuple[Check, ...] = (few_words, repetitive, shouting, odd_signs)


class Node:
    """An edge label, the children by first character, and what is kept for the text that ends here."""

    __slots__ = ("label", "kids", "least", "rows", "mask")

    def __init__(self, label: str) -> None:
        self.label, self.kids, self.rows = label, {}, None


class RadixTrie:
    """A compressed trie over whole texts; each terminal keeps the rows of its smallest id."""

    def __init__(self) -> None:
        self.root, self.chars = Node(""), 0

    def find(self, text: str) -> Node:
        """The node where text ends, made and split off where there is none yet."""
        node, at, end = self.root, 0, len(text)
        while at < end:
            child = node.kids.get(text[at])
            if child is None:
                child = node.kids[text[at]] = Node(text[at:])
                self.chars += end - at
                return child
            label = child.label
            if not text.startswith(label, at):
                same = shared(label, text, at)
                upper = node.kids[text[at]] = Node(label[:same])
                upper.kids[label[same]] = child
                child.label, child = label[same:], upper
            at += len(child.label)
            node = child
        return node

    def add(self, text: str, id_: int, part: str, n: int, mask: int) -> list[tuple[int, str, int, int]]:
        """Keep the row, or the rows of a smaller id; (id, part, n, mask) of those that lose against it."""
        node = self.find(text)
        if node.rows is None:
            node.least, node.rows, node.mask = id_, {part: n}, mask
        elif id_ == node.least:
            node.rows[part] = node.rows.get(part, 0) + n
        elif id_ > node.least:
            return [(id_, part, n, mask)]
        else:
            lost = [(node.least, p, m, mask) for p, m in node.rows.items()]
            node.least, node.rows = id_, {part: n}
            return lost
        return []

    def terminals(self) -> Iterator[tuple[str, Node]]:
        stack = [("", self.root)]
        while stack:
            above, node = stack.pop()
            text = above + node.label
            if node.rows is not None:
                yield text, node
            stack.extend((text, child) for child in node.kids.values())


def shared(label: str, text: str, at: int) -> int:
    """Characters that label and text from at have in common, by halving."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if text.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


def prefix_ranges(texts: DataFrame, step: int) -> tuple[list[np.ndarray], list[str]]:
    """Hashes of the crowded prefixes of each level, and the prefixes at which ranges begin; texts: (text), no null.

    A text's prefix is its first 8 characters, 64 where those have more than step bytes of texts, 512 where these
    do, and so on, or the whole text. Prefixes in order make ranges of about step bytes. All texts are counted;
    what comes to the driver is a hash for each crowded prefix of a level and a prefix for each range: one for
    each step bytes of texts at most.
    """
    crowded: list[np.ndarray] = []
    leaves, here, size = [], texts, _FIRST
    while True:
        prefix = F.substring("text", 1, size)
        groups = here.groupBy(prefix.alias("prefix"), (F.char_length("text") > size).alias("longer")).agg(F.sum(F.octet_length("text").cast("long")).alias("bytes"))
        groups = stored(groups, "audit-prefixes")
        heavy = F.col("longer") & (F.col("bytes") > step)
        leaves.append(groups.where(~heavy).select("prefix", "bytes"))
        hashes = groups.where(heavy).select(F.xxhash64("prefix").alias("h"))
        crowded.append(np.sort(np.array([r["h"] for r in hashes.collect()], np.int64)))
        if not len(crowded[-1]):
            break
        here = here.where(F.char_length("text") > size).join(F.broadcast(hashes), F.xxhash64(prefix) == F.col("h"), "left_semi")
        size *= _TIMES
    every = leaves[0]
    for more in leaves[1:]:
        every = every.unionByName(more)
    order = [F.col("prefix")]
    summed = prefix_sums(ordered_parts(every.groupBy("prefix").agg(F.sum("bytes").alias("bytes")), order, "audit-order"), F.col("bytes"), order, "before")
    block = F.floor(F.col("before") / step)
    starts = summed.groupBy(block.alias("block")).agg(F.min("prefix").alias("start"))
    return crowded, sorted(r["start"] for r in starts.collect())[1:]


def _place(text: str, crowded: list[np.ndarray], starts: list[str]) -> int:
    """The range of a text: equal texts have one."""
    size = _FIRST
    for hashes in crowded:
        prefix = text[:size]
        if len(text) <= size or not len(hashes):
            break
        h = np.int64(np.uint64(xxhash.xxh64_intdigest(prefix.encode("utf-8", "surrogatepass"), 42)))
        at = int(np.searchsorted(hashes, h))
        if at == len(hashes) or hashes[at] != h:
            break
        size *= _TIMES
    return bisect_right(starts, prefix)


def failure_masks(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", checks: Sequence[Check] = CHECKS) -> DataFrame:
    """(id, part, mask, n): documents, and rows alike counted together, with a bit for each check failed and one for duplicates.

    Null texts and parts are empty. The last bit: a row of a smaller id has the same text. Each task puts the texts
    it reads into tries and passes on the smallest id of each text alone, so a text with any number of copies
    travels once for each 32,000,000 characters read; then each range of prefixes goes through tries of its own,
    one at a time. Rows without an id are no document's duplicate and make none.
    """
    spark = docs.sparkSession
    text_batches(spark)
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    step = max(1 << 20, min(_RANGE, total // (2 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    crowded, starts = prefix_ranges(rows.select("text"), step)
    ranges = spark.sparkContext.broadcast((crowded, starts))
    twice = 1 << len(checks)
    fields = [T.StructField("id", kind), T.StructField("part", T.StringType()), T.StructField("mask", T.IntegerType()), T.StructField("n", T.LongType())]
    names = [f.name for f in fields]
    travel = [*fields, T.StructField("range", T.IntegerType()), T.StructField("text", T.StringType())]

    def table(out: list[tuple], schema: list[T.StructField]) -> pa.RecordBatch:
        from pyspark.sql.pandas.types import to_arrow_type

        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], to_arrow_type(f.dataType)) for k, f in enumerate(schema)], [f.name for f in schema])

    def spread(id_: object) -> int:
        return hash(id_) % (len(ranges.value[1]) + 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie()

        def passed_on() -> Iterator[pa.RecordBatch]:
            out = []
            for text, node in trie.terminals():
                at = _place(text, *ranges.value)
                out.extend((node.least, p, node.mask, n, at, text) for p, n in node.rows.items())
                if len(out) >= 500:
                    yield table(out, travel)
                    out = []
            yield table(out, travel)

        for b in batches:
            out = []
            for id_, part, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                words = raw.split()
                mask = sum(1 << k for k, fails in enumerate(checks) if fails(text, raw, words))
                if id_ is None:
                    out.append((None, part, mask, 1, 0, None))
                else:
                    out.extend((i, p, m | twice, n, spread(i), None) for i, p, n, m in trie.add(text, id_, part, 1, mask))
            yield table(out, travel)
            if trie.chars > _HELD:
                yield from passed_on()
                trie = RadixTrie()
        yield from passed_on()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, now = RadixTrie(), None

        def settled() -> list[tuple]:
            return [(node.least, p, node.mask, n) for _, node in trie.terminals() for p, n in node.rows.items()]

        for b in batches:
            out = []
            for id_, part, mask, n, at, text in zip(*(b.column(k).to_pylist() for k in range(6)), strict=True):
                if at != now:
                    out.extend(settled())
                    trie, now = RadixTrie(), at
                if text is None:
                    out.append((id_, part, mask, n))
                else:
                    out.extend((i, p, m | twice, c) for i, p, c, m in trie.add(text, id_, part, n, mask))
            yield table(out, fields)
        yield table(settled(), fields)

    dealt = rows.mapInArrow(first, T.StructType(travel)).repartition("range").sortWithinPartitions("range")
    return dealt.mapInArrow(second, T.StructType(fields)).select(*names)


def filter_interactions(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", checks: Sequence[Check] = CHECKS) -> DataFrame:
    """One row for each part, order of the filters and step: what the step's filter removes there, and what that costs.

    kept, removed, redundant, unique_fails, good_lost (quality 1), toxic_lost (toxic 1) and shapley count documents of the part.
    Filters are lettered from A, the duplicates last. Several labels of a document: any that says so counts.
    After one pass a part is the number of documents, good and toxic ones that no filter of a set fails, for each
    set of filters; every figure is a difference of these. Empty tables give no rows.
    """
    masks = failure_masks(docs, id_col=id_col, text_col=text_col, part_col=part_col, checks=checks)
    yes = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    known = labels.groupBy(F.col(id_col).alias("id")).agg(yes("quality"), yes("toxic"))
    marked = masks.join(known, "id", "left")
    counts = stored(marked.groupBy("part", "mask", "quality", "toxic").agg(F.sum("n").alias("n")), "audit-counts")
    k = len(checks) + 1
    sets = range(1 << k)
    clean = lambda s, also=F.lit(True): F.coalesce(F.sum(F.when((F.col("mask").bitwiseAND(F.lit(s)) == 0) & also, F.col("n"))), F.lit(0)).cast("long")  # noqa: E731, B008
    sums = {"f": F.lit(True), "g": F.coalesce("quality", F.lit(False)), "t": F.coalesce("toxic", F.lit(False))}
    per = counts.groupBy("part").agg(*[F.array(*[clean(s, also) for s in sets]).alias(name) for name, also in sums.items()])
    letters = [chr(65 + i) for i in range(k)]
    of = lambda name, at: F.col(name)[at]

    def shapley(i: int) -> Column:
        return sum((F.lit(factorial(c := s.bit_count()) * factorial(k - 1 - c)) * (of("f", s) - of("f", s | 1 << i)) for s in sets if not s >> i & 1), F.lit(0).cast("long"))

    per = per.withColumn("worth", F.array(*[shapley(i) for i in range(k)]))
    orders = F.array(*[F.lit("".join(p)) for p in permutations(letters)])
    rows = per.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(k))))
    letter = F.ascii(F.substring("filter_order", F.col("step"), F.lit(1))) - 65
    bit = lambda at: F.call_function("shiftleft", F.lit(1), F.ascii(F.substring("filter_order", at, 1)) - 65)
    before = sum((F.when(F.col("step") > at, bit(at)).otherwise(0) for at in range(1, k)), F.lit(0))
    rows = rows.withColumn("at", letter).withColumn("own", F.call_function("shiftleft", F.lit(1), F.col("at"))).withColumn("before", before)
    after, others = F.col("before") + F.col("own"), F.lit((1 << k) - 1) - F.col("own")
    lost = lambda name: of(name, F.col("before")) - of(name, after)
    return rows.select(
        "part", "filter_order", "step", of("f", after).alias("kept"), lost("f").alias("removed"), (of("f", 0) - of("f", F.col("own")) - lost("f")).alias("redundant"),
        (of("f", others) - of("f", (1 << k) - 1)).alias("unique_fails"), lost("g").alias("good_lost"), lost("t").alias("toxic_lost"), F.col("worth")[F.col("at")].alias("shapley"),
    )


ORACLE = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), judged AS (
  SELECT doc_id, part,
         (len(words) < 50)::INT + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
         + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
         + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)::INT AS mask
  FROM texts
), marked AS (
  SELECT j.part, j.mask, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, count(*) AS n
  FROM judged j LEFT JOIN (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id) l ON l.doc_id = j.doc_id
  GROUP BY ALL
), letters AS (SELECT chr((65 + i)::INT) AS c, (1 << i) AS bit FROM range(5) r(i)
), orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE b.c <> a.c AND c.c NOT IN (a.c, b.c) AND d.c NOT IN (a.c, b.c, c.c) AND e.c NOT IN (a.c, b.c, c.c, d.c)
), steps AS (
  SELECT filter_order, step::INT AS step, bits[step] AS own, coalesce(list_sum(bits[1:step - 1]), 0)::BIGINT AS before FROM orders, range(1, 6) r(step)
), rows AS (
  SELECT part, filter_order, step, own,
         coalesce(sum(n) FILTER (mask & (before + own) = 0), 0)::BIGINT AS kept,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (mask & before <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant,
         coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND good), 0)::BIGINT AS good_lost,
         coalesce(sum(n) FILTER (mask & before = 0 AND mask & own <> 0 AND toxic), 0)::BIGINT AS toxic_lost
  FROM marked, steps GROUP BY part, filter_order, step, own, before
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM rows
"""
