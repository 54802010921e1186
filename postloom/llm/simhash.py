"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import stored, text_batches

SEED = 42
#: Bits of the byte values 0 to 255, lowest first.
_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_LANES = np.arange(8) * 256
_PLACES = np.uint64(1) << np.arange(64, dtype=np.uint64)
_STEP = 1 << 16


def simhash(text: str | None, shingle: int) -> int:
    """64-bit fingerprint of the word shingles of a text: words are runs without ASCII white space, A-Z in lower case.

    Repeated shingles count each time; with fewer words than a shingle the whole sequence is one; without words: 0.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(SEED)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _STEP):
        codes = hashes[at : at + _STEP].view(np.uint8).reshape(-1, 8) + _LANES
        ones += (np.bincount(codes.ravel(), minlength=2048).reshape(8, 256) @ _BITS).ravel()
    return int(_PLACES[2 * ones > n].sum(dtype=np.uint64))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) for each row: fp is the fingerprint as a signed long. Only the two columns are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    text_batches(docs.sparkSession)
    two = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return two.mapInArrow(run, T.StructType([T.StructField("id", two.schema["id"].dataType), T.StructField("fp", T.LongType())]))


def _halves(flip: bool) -> Column:
    """The two 32-bit segments of fp as (segment, key): its value, with flip also each value that has one zero bit set."""
    return F.concat(_half(0, F.shiftrightunsigned("fp", 32), flip), _half(1, F.col("fp").bitwiseAND(0xFFFFFFFF), flip))


def _half(seg: int, value: Column, flip: bool) -> Column:
    keys = F.array(value)
    if flip:
        powers = F.array(*[F.lit(1 << i).cast("long") for i in range(32)])
        keys = F.concat(keys, F.transform(F.filter(powers, lambda p: value.bitwiseAND(p) == 0), lambda p: value.bitwiseOR(p)))
    return F.transform(keys, lambda k: F.struct(F.lit(seg).alias("seg"), k.alias("key")))


def _spanning(left: np.ndarray, right: np.ndarray, left_id: np.ndarray, right_id: np.ndarray, limit: int) -> set[tuple[int, int]]:
    """Pairs that connect whatever fingerprints of the two blocks lie within limit bits, at most one for each fingerprint."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[up]
        return x

    out = set()
    for i, fp in enumerate(left):
        near = right_id[np.bitwise_count(right ^ fp) <= limit]
        for j in np.unique(near).tolist():
            a, b = sorted((root(int(left_id[i])), root(j)))
            if a != b:
                parent[b] = a
                out.add((a, b))
    return out


def near_pairs(fps: DataFrame, max_distance: int = 3, *, bucket: int = 64, block: int = 2048) -> DataFrame:
    """Pairs (l, r) of ids whose fingerprints differ in at most max_distance (0 to 3) bits; fps: distinct (fp, id).

    Of two 32-bit segments of such a pair one differs in a bit at most. So every fingerprint asks a table of
    segments for its own values and for those with one of its zero bits set (the member of the pair that has
    the zero finds the other), and what is fetched is verified over all 64 bits. Where a table key holds more
    than ``bucket`` fingerprints, the askers and holders of that key are dealt into blocks of about ``block`` and
    compared block by block; each block pair then returns a spanning set of its links instead of all of them,
    which leaves the components as they are and the rows in proportion to the blocks. Nothing is skipped.
    """
    if not 0 <= max_distance <= 3:
        raise ValueError("two segments with one flipped bit find at most 3 differing bits")
    table = fps.select(F.explode(_halves(False)).alias("s"), "fp", "id").select("s.seg", "s.key", "fp", "id")
    asked = fps.select(F.explode(_halves(True)).alias("s"), "fp", "id").select("s.seg", "s.key", F.col("fp").alias("p_fp"), F.col("id").alias("p_id"))
    full = stored(table.groupBy("seg", "key").count().where(F.col("count") > bucket), "simhash-full")
    crowded = not full.isEmpty()
    spread = table.join(full, ["seg", "key"], "left_anti") if crowded else table
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("p_fp"))) <= max_distance
    pairs = asked.join(spread, ["seg", "key"]).where(near & (F.col("id") != F.col("p_id"))).select(F.least("id", "p_id").alias("l"), F.greatest("id", "p_id").alias("r"))
    if crowded:
        holders, askers = table.join(full.drop("count"), ["seg", "key"]), asked.join(full.drop("count"), ["seg", "key"])
        many = askers.groupBy("seg", "key").agg(F.count("*").alias("n_ask")).join(full, ["seg", "key"])
        many = many.select("seg", "key", F.ceil(F.col("count") / block).cast("int").alias("n_hold"), F.ceil(F.col("n_ask") / block).cast("int").alias("n_ask"))
        dealt = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        holders = holders.join(many, ["seg", "key"]).select("seg", "key", dealt("fp", "n_hold").alias("h"), every("n_ask").alias("a"), "fp", "id", F.lit(True).alias("holds"))
        askers = askers.join(many, ["seg", "key"]).select("seg", "key", every("n_hold").alias("h"), dealt("p_fp", "n_ask").alias("a"), F.col("p_fp").alias("fp"), F.col("p_id").alias("id"), F.lit(False).alias("holds"))

        def compare(pdf):
            import pandas as pd

            own, other = pdf[pdf.holds], pdf[~pdf.holds]
            found = _spanning(other.fp.to_numpy(), own.fp.to_numpy(), other.id.to_numpy(), own.id.to_numpy(), max_distance)
            return pd.DataFrame(sorted(found), columns=["l", "r"], dtype="int64")

        pairs = pairs.union(holders.union(askers).groupBy("seg", "key", "h", "a").applyInPandas(compare, "l long, r long"))
    return pairs.distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """One row for each row of docs: id, fp (signed long), fingerprint (16 hex digits), component_id.

    component_id is the smallest id reachable over links of at most max_distance bits, the own id included. Null
    and empty texts have fingerprint 0 and link like any other. Equal fingerprints are one vertex, so a large
    group of copies costs one row in the search. Repeated ids stay repeated rows; rows with a null id are left
    out, as no component can name them; an empty table gives no rows. Other columns of docs are not read.
    """
    own = stored(fingerprints(docs.where(F.col(id_col).isNotNull()), id_col, text_col, shingle), "simhash-fps")
    distinct = stored(own.groupBy("fp").agg(F.min("id").alias("id")), "simhash-distinct")
    linked = connected_components(stored(near_pairs(distinct, max_distance), "simhash-pairs"))
    groups = distinct.join(linked, "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return own.join(groups, "fp").select("id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def component_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """Links (l, r) from the smallest id of each component to its other ids."""
    found = simhash_components(docs, id_col, text_col, shingle=shingle, max_distance=max_distance)
    return found.where("id <> component_id").select(F.col("component_id").alias("l"), F.col("id").alias("r"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, max_distance: int = 3) -> DataFrame:
    """The rows of docs whose id is the smallest of its component, one row for each; their columns stay.

    Of repeated rows with one id, one stays. Rows with a null id can't be told apart and all stay.
    """
    found = simhash_components(docs, id_col, text_col, shingle=shingle, max_distance=max_distance)
    stay = stored(found.where("id = component_id").groupBy("id").count(), "simhash-stay")
    kept = docs.join(stay.select(F.col("id").alias(id_col)), id_col, "left_semi")
    again = stay.where("count > 1").select(F.col("id").alias(id_col))
    if not again.isEmpty():
        kept = kept.join(again, id_col, "left_anti").unionByName(kept.join(again, id_col, "left_semi").dropDuplicates([id_col]))
    return kept.unionByName(docs.where(F.col(id_col).isNull()))
