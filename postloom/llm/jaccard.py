"""Near duplicates by the exact Jaccard similarity of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import stored, text_batches
from . import metric_join

#: Texts that are looked at for common shingles at least, one of how many in large tables, and how many shingles are put last. They change the work only, not the result.
_SAMPLE, _SHARE, _COMMON = 20_000, 16, 1 << 21


def shingles(text: str | None, size: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; words as in ``simhash``, fewer words than a shingle are one, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    grams = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)) if len(words) >= size else [b" ".join(words)] * bool(words)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64).view(np.int64))


def _upper(keys: np.ndarray) -> np.ndarray:
    """The upper halves of 64-bit hashes, in the same order."""
    return (keys >> 32).astype(np.int32)


def _common(docs: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of more than one sampled text by the upper half of their hashes, ascending, and how many of these texts hold each.

    The sample grows with the table, so a shingle that would crowd a region shows up at any size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_upper(np.concatenate([shingles(t.as_py(), size) for t in b.column(0)] or [np.empty(0, np.int64)])))], ["key"])

    total = docs.count()
    part = docs.sample(min(1.0, max(_SAMPLE, total // _SHARE) / max(1, total)), 1).select("text")
    top = part.mapInArrow(run, "key int").groupBy("key").count().where("count > 1").orderBy(F.desc("count"), "key").limit(_COMMON).toArrow()
    keys, often = top["key"].to_numpy(), top["count"].to_numpy()
    by_key = np.argsort(keys)
    return keys[by_key], np.minimum(often[by_key], 65_535).astype(np.uint16)


def parity(own: np.ndarray, bits: int) -> np.ndarray:
    """A bit for each class of shingles modulo bits (a power of two, 64 or more): whether the set has an odd number of it.

    Two sets differ in at least as many shingles as their parities do in bits.
    """
    odd = np.bincount((own & (bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8))


def parity_bits(n: int) -> int:
    return 1 << max(6, (max(1, n) - 1).bit_length())


def can_be_similar(x: bytes, y: bytes, n: int, m: int, least: Fraction) -> bool:
    """False only where the parities prove that the similarity is below ``least``: a larger parity is folded to the smaller."""
    a, b = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
    if len(a) > len(b):
        a = np.bitwise_xor.reduce(a.reshape(-1, len(b)))
    elif len(b) > len(a):
        b = np.bitwise_xor.reduce(b.reshape(-1, len(a)))
    differ = int(np.bitwise_count(a ^ b).sum())
    return differ * (least.denominator + least.numerator) <= (n + m) * (least.denominator - least.numerator)


def signatures(docs: DataFrame, size: int, least: Fraction) -> DataFrame:
    """(id, set, n, parity, prefix), stored, for docs (id, text): a name of the set of shingles, its size, its parity, its first shingles in the common order.

    Two sets of similarity ``least`` or more share a shingle of their prefixes, whatever the order.
    """
    text_batches(docs.sparkSession)
    keys, often = _common(docs, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, sizes, odds, prefixes = [], [], [], []
            for t in b.column(1):
                own = shingles(t.as_py(), size)
                names.append(xxhash.xxh128_digest(own.tobytes()))
                sizes.append(n := len(own))
                odds.append(parity(own, parity_bits(n)).tobytes())
                rank = np.zeros(n, np.uint16)
                if len(keys):
                    at = np.searchsorted(keys, half := _upper(own))
                    at[at == len(keys)] = 0
                    rank[hit] = often[at[hit := keys[at] == half]]
                shared = -(-least.numerator * n // least.denominator)
                prefixes.append(own[np.argsort(rank, kind="stable")[: n - shared + 1 if n else 0]])
            ends = np.concatenate([[0], np.cumsum([len(p) for p in prefixes])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*prefixes, np.empty(0, np.int64)])))
            cols = [b.column(0), pa.array(names, pa.binary()), pa.array(sizes, pa.int32()), pa.array(odds, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(cols, ["id", "set", "n", "parity", "prefix"])

    fields = [T.StructField("id", docs.schema["id"].dataType), T.StructField("set", T.BinaryType()), T.StructField("n", T.IntegerType())]
    fields += [T.StructField("parity", T.BinaryType()), T.StructField("prefix", T.ArrayType(T.LongType()))]
    return stored(docs.mapInArrow(run, T.StructType(fields)), "jaccard-rows")


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """(id, own) with each set of shingles of an id once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingles(t.as_py(), size).tobytes() for t in b.column(1)], pa.binary())], ["id", "own"])

    return docs.mapInArrow(run, T.StructType([T.StructField("id", docs.schema["id"].dataType), T.StructField("own", T.BinaryType())])).distinct()


def _told(rows: DataFrame, marks: DataFrame, *cols: str) -> DataFrame:
    """rows with ``maybe``: false only where no row of marks has the same cols, so that few rows are dealt out in the join that settles it.

    A bitmap of hashed values, 2**26 bits in rows of 2**15, goes out: 8 MB at most. The fuller it is, the less it rules out.
    """
    place = F.pmod(F.xxhash64(*cols), F.lit(1 << 26))
    at = place.bitwiseAND((1 << 15) - 1)
    bits = marks.select(F.shiftright(place, 15).alias("_row"), at.alias("_bit"))
    bits = stored(bits.groupBy("_row").agg(F.bitmap_construct_agg("_bit").alias("_bits")), "jaccard-bits")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    near = rows.join(F.broadcast(bits), F.shiftright(place, 15) == F.col("_row"), "left")
    return near.select(*rows.columns, F.coalesce(hit, F.lit(False)).alias("maybe"))


def _perhaps(rows: DataFrame, marks: DataFrame, *cols: str) -> DataFrame:
    """rows without most of those whose cols no row of marks has."""
    return _told(rows, marks, *cols).where("maybe").drop("maybe")


def similar_pairs(docs: DataFrame, size: int, least: Fraction, *, rows: DataFrame | None = None, empty_alike: bool = True, bucket: int = 64, limit: int = 1024) -> DataFrame:
    """Pairs (l, r) of ids that connect all texts whose shingles have a Jaccard similarity of ``least`` or more; docs: (id, text).

    Equal sets are one vertex; those without shingles only if ``empty_alike``. The first pivots are the sets of one
    shingle: a text of n shingles is at 1 - 1/n from those it holds and at 1 from all others, so it goes to the regions of
    the n - ceil(least * n) + 1 first of its own in one order, rare ones first; two similar texts meet in one. In a region of at most
    ``bucket`` texts the pairs that neither sizes, places nor parities rule out are verified over all shingles. In
    larger ones all are first held against two texts of the region, then :func:`metric_join.region_links` splits what is
    not connected yet by texts as pivots. Nothing is skipped. Whole sets travel only for ids that a pair or crowded region names.
    """
    text_batches(docs.sparkSession)
    num, den = least.numerator, least.denominator
    rows = signatures(docs, size, least) if rows is None else rows
    named = rows if empty_alike else rows.where("n > 0")
    first = named.groupBy("set").agg(F.min("id").alias("l"))
    equal = stored(named.select("set", "id").distinct().join(first, "set").where("id <> l").select("l", F.col("id").alias("r"), "set"), "jaccard-equal")
    # a set is worked on under its first id; ids of several texts may be first for one set and not for another
    copies = equal.select(F.col("r").alias("id"), "set", F.lit(True).alias("copy"))
    told = _told(rows.select("id", "set", "n", "prefix"), copies, "id", "set")
    # no anti join, as it would be pushed below the bitmap and deal out every row
    alone = told.where("maybe").join(copies, ["id", "set"], "left").where("copy is null")
    lone = told.where("not maybe").select("id", "n", "prefix").union(alone.select("id", "n", "prefix"))
    keys = lone.select("id", "n", F.posexplode("prefix").alias("pos", "key"))
    # lower halves, as a prefix prefers hashes that begin alike
    halves = keys.withColumn("half", F.col("key").bitwiseAND(0xFFFFFFFF))
    several = halves.groupBy("half").count().where("count > 1").select("half")
    likely = _perhaps(halves, several, "half").drop("half")
    often = likely.groupBy("key").count().where("count > 1")
    shared = stored(likely.join(often, "key"), "jaccard-shared")
    one = shared.where(F.col("count") <= bucket).drop("count")
    two = one.select("key", *[F.col(c).alias(f"{c}2") for c in ("id", "n", "pos")])
    can = (F.col("n") * den >= F.col("n2") * num) & (F.col("n2") * den >= F.col("n") * num)
    most = F.least(F.col("n") - F.col("pos"), F.col("n2") - F.col("pos2"))
    can &= most * (den + num) >= (F.col("n") + F.col("n2")) * num
    pairs = one.join(two, "key").where((F.col("id") < F.col("id2")) & can).select(F.col("id").alias("l"), F.col("id2").alias("r"))
    crowd = stored(shared.where(F.col("count") > bucket).select(F.col("key").alias("region"), "id").distinct(), "jaccard-crowd")
    hubs = crowd.groupBy("region").agg(F.min("id").alias("h0"), F.min_by("id", F.xxhash64("id")).alias("h1"))
    held = crowd.join(hubs, "region").select("id", F.explode(F.array("h0", "h1")).alias("hub")).where("id <> hub")
    pairs = stored(pairs.union(held.select(F.least("id", "hub"), F.greatest("id", "hub"))).distinct(), "jaccard-near")
    kind = docs.schema["id"].dataType
    link = T.StructType([T.StructField("l", kind), T.StructField("r", kind)])

    def plausible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            four = zip(*(b[c].to_pylist() for c in ("x", "y", "n", "m")), strict=True)
            yield b.select(["l", "r"]).filter(pa.array([can_be_similar(*v, least) for v in four], pa.bool_()))

    odds = _perhaps(rows.select("id", "n", "parity"), pairs.select(F.col("l").alias("id")).union(pairs.select("r")), "id").distinct()
    sized = pairs.join(odds.select(F.col("id").alias("l"), "n", F.col("parity").alias("x")), "l")
    sized = sized.join(odds.select(F.col("id").alias("r"), F.col("n").alias("m"), F.col("parity").alias("y")), "r")
    pairs = stored(sized.select("l", "r", "x", "y", "n", "m").mapInArrow(plausible, link).distinct(), "jaccard-pairs")
    ids = pairs.select(F.col("l").alias("id")).union(pairs.select("r")).union(crowd.select("id")).distinct()
    # inner, as a semi join would be pushed below the bitmap and deal out every text
    sets = stored(_sets(_perhaps(docs.select("id", "text"), ids, "id").join(ids, "id"), size), "jaccard-sets")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            stay = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_py(), np.int64), np.frombuffer(y.as_py(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                stay.append(both * den >= num * (len(x) + len(y) - both))
            yield b.select([0, 1]).filter(pa.array(stay, pa.bool_()))

    checked = pairs.join(sets.select(F.col("id").alias("l"), F.col("own").alias("x")), "l").join(sets.select(F.col("id").alias("r"), F.col("own").alias("y")), "r")
    links = equal.select("l", "r").union(checked.select("l", "r", "x", "y").mapInArrow(verify, link))
    if crowd.isEmpty():
        return links
    links = stored(links, "jaccard-found")
    return links.union(metric_join.region_links(crowd, sets, links, least, limit=limit))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, similarity: float = 0.8, also: DataFrame | None = None) -> DataFrame:
    """The rows of docs whose id is the smallest of its component over links of that similarity or more, one row for each; their columns stay.

    ``also`` are links (l, r) of ids found in another way; components are taken over both. Texts without words are equal. Rows of one id are one document, whatever their texts, and one of them stays.
    Rows with a null id can't be told apart and all stay.
    """
    two = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    links = similar_pairs(two, shingle, Fraction(str(similarity)))
    links = stored(links if also is None else links.unionByName(also), "jaccard-links")
    gone = stored(connected_components(links).where("id <> component").select(F.col("id").alias(id_col)), "jaccard-gone")
    kept = docs.where(F.col(id_col).isNotNull()).join(gone, id_col, "left_anti")
    again = stored(two.join(gone.select(F.col(id_col).alias("id")), "id", "left_anti").groupBy("id").count().where("count > 1").select(F.col("id").alias(id_col)), "jaccard-again")
    if not again.isEmpty():
        kept = kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
