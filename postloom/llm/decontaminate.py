"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ordered_parts, prefix_sums
from ..storage import stored, text_batches

#: A token: a run of letters and digits, in lower case.
_TOKEN = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Matching windows of a text and an item that are listed; pairs with more go by :func:`tile_repetitive`, with the same tiles.
_MANY = 100_000


def tokens(text: str) -> list[str]:
    return _TOKEN.findall(text.lower())


def _window_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin hash modulo 2**64 of each k ids in a row."""
    out = np.zeros(len(ids) - k + 1, np.uint64)
    for j in range(k):
        out = out * _BASE + ids[j : j + len(out)]
    return out


def tile(doc: np.ndarray, item: np.ndarray, at_doc: np.ndarray, at_item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """Tiles (length, doc position, item position), longest first, no token of either side twice, none below k.

    at_doc and at_item are the starts of all matching k-token windows. Windows that follow one another on a diagonal
    join to a maximal match; the longest free match is marked, and what a mark leaves of others goes back in line.
    """
    order = np.lexsort((at_doc, at_doc - at_item))
    d, i = at_doc[order], at_item[order]
    cut = np.flatnonzero((np.diff(d - i) != 0) | (np.diff(d) != 1)) + 1
    line = [(-(len(run) + k - 1), int(run[0]), int(i[s])) for s, run in zip([0, *cut.tolist()], np.split(d, cut), strict=True) if len(run)]
    heapq.heapify(line)
    used_doc, used_item = np.zeros(len(doc), bool), np.zeros(len(item), bool)
    out = []
    while line:
        n, a, b = heapq.heappop(line)
        n = -n
        taken = used_doc[a : a + n] | used_item[b : b + n]
        if not taken.any():
            used_doc[a : a + n] = used_item[b : b + n] = True
            out.append((n, a, b))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True])).astype(np.int8)))
        for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if e - s >= k:
                heapq.heappush(line, (-(e - s), a + s, b + s))
    return out


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of each range, one range after the other."""
    ends = np.cumsum(size)
    return np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)


class _Windows:
    """Running hashes of any window length over ids: sums of ids times powers of the base's inverse, shifted to a common place."""

    def __init__(self, ids: np.ndarray, longest: int):
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            down = np.cumprod(np.r_[np.uint64(1), np.full(len(ids), inverse, np.uint64)], dtype=np.uint64)
            self.up = np.cumprod(np.r_[np.uint64(1), np.full(len(ids) + longest, _BASE, np.uint64)], dtype=np.uint64)
            self.sums = np.r_[np.uint64(0), np.cumsum(_mixed(ids) * down[:-1], dtype=np.uint64)]

    def of(self, starts: np.ndarray, length: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (self.sums[starts + length] - self.sums[starts]) * self.up[starts]


def _mixed(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = ids.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


def tile_repetitive(doc: np.ndarray, item: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """The tiles of :func:`tile` in memory that grows with the texts only, for pairs with very many matching windows.

    The length of the longest free common run is found by halving, as whatever has a run of a length has the shorter ones.
    """
    used_doc, used_item, out = np.zeros(len(doc), bool), np.zeros(len(item), bool), []
    in_doc, in_item = _Windows(doc, len(item)), _Windows(item, len(item))

    def free(used: np.ndarray, n: int) -> np.ndarray:
        total = np.r_[0, np.cumsum(used)]
        return np.flatnonzero(total[n:] == total[:-n]) if n <= len(used) else np.empty(0, np.int64)

    def first(n: int) -> tuple[int, int] | None:
        """The first places of a free common run of n tokens, by doc, then by item."""
        a, b = free(used_doc, n), free(used_item, n)
        if not len(a) or not len(b):
            return None
        known, at = np.unique(in_item.of(b, n), return_index=True)
        hashes = in_doc.of(a, n)
        place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        for x in np.flatnonzero(known[place] == hashes):  # the first but for colliding hashes
            i, j = int(a[x]), int(b[at[place[x]]])
            if (doc[i : i + n] == item[j : j + n]).all():
                return i, j
        return None

    most = min(len(doc), len(item))
    while True:
        low, high, best = k - 1, most, None
        while low < high:
            n = (low + high + 1) // 2
            if found := first(n):
                low, best = n, found
            else:
                high = n - 1
        if best is None:
            return out
        n, (i, j) = low, best
        used_doc[i : i + n] = used_item[j : j + n] = True
        out.append((n, i, j))
        most = n


class _Table:
    """All windows of k tokens of some items, by their hash."""

    def __init__(self, items: list[tuple[int, np.ndarray]], k: int):
        self.k = k
        hashes = [_window_hashes(ids, k) for _, ids in items]
        n = [len(h) for h in hashes]
        found = np.concatenate([*hashes, np.empty(0, np.uint64)])
        order = np.argsort(found, kind="stable")
        self.hashes = found[order]
        self.starts = np.concatenate([*map(np.arange, n), np.empty(0, np.int64)])[order]
        self.owners = np.repeat([o for o, _ in items], n)[order].astype(np.int64)


class BenchmarkIndex:
    """Token windows of a bounded block of benchmark items; those of items shorter than k tokens are whole items."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.words, self.items = k, {}, []
        by_length: dict[int, list[tuple[int, np.ndarray]]] = {}
        for n, (item_id, text) in enumerate(items):
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in tokens(text)], np.uint64)
            self.items.append((item_id, ids))
            if len(ids):
                by_length.setdefault(min(k, len(ids)), []).append((n, ids))
        self.tables = [_Table(own, length) for length, own in sorted(by_length.items(), reverse=True)]

    def matches(self, text: str | None) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        """(item id, tokens of the item, tokens in tiles, tiles) for each item that shares a window with the text."""
        found = tokens(text or "") if self.tables else []
        ids = np.fromiter(map(self.words.get, found, repeat(0)), np.uint64, len(found))
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        for table in self.tables:
            k = table.k
            at = np.flatnonzero(known[k:] - known[:-k] == k) if len(ids) >= k else ()
            if len(at):
                yield from self._matches(table, ids, at)

    def _matches(self, table: _Table, ids: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, int, list[tuple[int, int, int]]]]:
        k = table.k
        mine, of, times = np.unique(_window_hashes(ids, k)[at], return_inverse=True, return_counts=True)
        lo = np.searchsorted(table.hashes, mine, "left")
        n = np.searchsorted(table.hashes, mine, "right") - lo
        rows = _spread(lo, n)  # no entry of the table twice
        if not len(rows):
            return
        window = np.repeat(np.arange(len(mine)), n)
        by_owner = np.argsort(table.owners[rows], kind="stable")
        rows, window = rows[by_owner], window[by_owner]
        cuts = np.flatnonzero(np.diff(table.owners[rows])) + 1
        line, starts = np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(times)])
        for r, w in zip(np.split(rows, cuts), np.split(window, cuts), strict=True):
            item_id, item = self.items[table.owners[r[0]]]
            if times[w].sum() > _MANY:
                tiles = tile_repetitive(ids, item, k)
            else:
                d, i = at[line[_spread(starts[w], times[w])]], np.repeat(table.starts[r], times[w])
                same = np.all([ids[d + j] == item[i + j] for j in range(k)], axis=0)  # hashes may collide
                tiles = tile(ids, item, d[same], i[same], k) if same.any() else []
            if tiles:
                yield item_id, len(item), sum(t[0] for t in tiles), tiles


_FOUND = pa.list_(pa.struct([("item_id", pa.int64()), ("item_tokens", pa.int64()), ("matched", pa.int64()), ("tiles", pa.int64()), ("longest", pa.int64())]))
_FOUND_SQL = "array<struct<item_id:bigint,item_tokens:bigint,matched:bigint,tiles:bigint,longest:bigint>>"


def benchmark_blocks(benchmark: DataFrame, *, id_col: str = "item_id", text_col: str = "text", block_chars: int = 4_000_000) -> Iterator[list[tuple[int, str]]]:
    """The benchmark in blocks of about block_chars characters (a longer item is a block of its own), one at a time."""
    items = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("item_id"), F.col("text")]
    sized = prefix_sums(ordered_parts(items, order, "bench-order"), F.length("text"), order, "before").withColumn("block", F.floor(F.col("before") / block_chars)).drop("part", "before")
    for row in sized.select("block").distinct().orderBy("block").toLocalIterator():
        yield [(r["item_id"], r["text"]) for r in sized.where(F.col("block") == row["block"]).orderBy("item_id", "text").collect()]


def _finder(index, coverage: float):
    @F.arrow_udf(_FOUND_SQL)
    def find(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts:
            got = [(o, n, m, len(ts), max(x[0] for x in ts)) for o, n, m, ts in index.value.matches(t.as_py()) if m >= coverage * n]
            rows.append([dict(zip(("item_id", "item_tokens", "matched", "tiles", "longest"), x, strict=True)) for x in got])
        return pa.array(rows, _FOUND)

    return find


def contaminated_pairs(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.5,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """(doc_id, item_id, item_tokens, matched, coverage, tiles, longest) for each document and benchmark item found in it.

    An item is found if tiles of at least min_match tokens cover the share ``coverage`` of its tokens, in whatever order
    they come; an item of fewer tokens if it stands there as a whole. Texts stay where they are: nothing is
    shuffled. The benchmark goes out in blocks of bounded size; the hits of each are written before the
    next one goes out, so a worker holds one block at a time. Null and empty texts hold nothing; items
    without id, text or token can't be found; repeated items and rows are found each. An empty table gives no rows.
    """
    text_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    blocks = _sent_blocks(docs, benchmark, item_col, item_text_col, min_match, block_chars)
    out = None
    for index, last in blocks:
        own = two.select("doc_id", F.explode(_finder(index, coverage)(F.col("text"))).alias("f"))
        if not last:
            own = stored(own, "bench-hits")
            index.unpersist()
        out = own if out is None else out.unionByName(own)
    if out is None:
        out = two.limit(0).select("doc_id", F.explode(F.array().cast(_FOUND_SQL)).alias("f"))
    share = (F.col("f.matched") / F.col("f.item_tokens")).alias("coverage")
    return out.select("doc_id", "f.item_id", "f.item_tokens", "f.matched", share, "f.tiles", "f.longest")


def _sent_blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str, min_match: int, block_chars: int):
    """(broadcast index, whether it is the last) for each block, one at a time."""
    line = benchmark_blocks(benchmark, id_col=item_col, text_col=item_text_col, block_chars=block_chars)
    now = next(line, None)
    while now is not None:
        then = next(line, None)
        yield docs.sparkSession.sparkContext.broadcast(BenchmarkIndex(now, min_match)), then is None
        now = then


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    min_match: int = 5,
    coverage: float = 0.5,
    block_chars: int = 4_000_000,
) -> DataFrame:
    """docs without the rows in which an item is found (see :func:`contaminated_pairs`); all columns stay as they are.

    With more than one block, the rows that a block leaves are written before the next one goes out.
    """
    text_batches(docs.sparkSession)
    for index, last in _sent_blocks(docs, benchmark, item_col, item_text_col, min_match, block_chars):
        docs = docs.where(F.size(_finder(index, coverage)(F.col(text_col))) == 0)
        if not last:
            docs = stored(docs, "bench-left")
            index.unpersist()
    return docs
