"""Similarity join in the metric space of sets under the Jaccard distance, 1 - |x & y| / |x | y|."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.components import connected_components
from ..storage import stored, stored_alone

#: What rounding may add to a sum of distances; windows are wider by so much.
_EPS = 1e-9


def overlaps(x: np.ndarray, keys: np.ndarray, owners: np.ndarray, n: int) -> np.ndarray:
    """How many elements of x each of n sets has, given as sorted keys and the sets they are of."""
    lo, hi = np.searchsorted(keys, x), np.searchsorted(keys, x, "right")
    spans = hi - lo
    at = np.repeat(lo - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
    return np.bincount(owners[at], minlength=n)


def spanning_links(left: list[np.ndarray], right: list[np.ndarray], groups: tuple[list[int], list[int]], least: Fraction, same: bool) -> list[tuple[int, int]]:
    """Places (i, j) of links between left and right that connect what isn't in one group yet, at most one for each set.

    groups: a number for each set; sets of one number are connected already and aren't compared.
    """
    sizes = np.array([len(x) for x in right])
    keys, owners = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    by_key = np.argsort(keys, kind="stable")
    keys, owners = keys[by_key], owners[by_key]
    up = {g: g for g in (*groups[0], *groups[1])}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    out, num, den = [], least.numerator, least.denominator
    mates = np.array(groups[1])
    for i, own in enumerate(left):
        fits = (sizes * den >= len(own) * num) & (len(own) * den >= sizes * num) & (mates != groups[0][i])
        if not fits.any() or len({root(int(g)) for g in np.unique(mates[fits])} | {root(groups[0][i])}) == 1:
            continue
        common = overlaps(own, keys, owners, len(right))
        near = np.flatnonzero(fits & (common * (den + num) >= num * (len(own) + sizes)))
        for j in near.tolist():
            a, b = root(groups[0][i]), root(groups[1][j])
            if a != b:
                up[b] = a
                out.append((i, j))
    return out


def _distances(asked: DataFrame, sets: DataFrame) -> DataFrame:
    """asked (id, pivot) with their distance d; sets: (id, own) with own the bytes of sorted 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.int64), np.frombuffer(y.as_buffer(), np.int64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                d.append(1 - both / max(1, len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d, pa.float64())], ["id", "pivot", "d"])

    kind = asked.schema["id"].dataType
    both = asked.join(sets.select("id", F.col("own").alias("x")), "id").join(sets.select(F.col("id").alias("pivot"), F.col("own").alias("y")), "pivot")
    schema = T.StructType([T.StructField("id", kind), T.StructField("pivot", kind), T.StructField("d", T.DoubleType())])
    return both.select("id", "pivot", "x", "y").mapInArrow(run, schema)


def voronoi_regions(members: DataFrame, sets: DataFrame, radius: float, *, pivots: int, limit: int) -> DataFrame:
    """members (region, id, color) dealt into smaller regions, so that all within radius of each other still share one.

    A region of over limit members takes some of them as pivots (those of smallest hash, another one each level, so
    that regions of almost the same members take the same ones and their distances are worked out once). Each member
    goes home to its nearest pivot p, and as a guest to each q with d(x, q) <= d(x, p) + 2 * radius that some
    home of q can reach: d(x, q) <= covering radius of q + radius. If x is at home with p and d(x, y) <= radius,
    then d(y, p) <= d(y, q) + 2 * radius for y's own home q, so both meet at p. Regions are split again until
    they are small, have one color only, or lie so that no pivot splits them (all distances alike).
    """
    members = members.withColumn("whole", F.lit(False))
    for level in count():
        sizes = members.where("not whole").groupBy("region").agg(F.count("*").alias("size"), F.min("color").alias("_lo"), F.max("color").alias("_hi"))
        big = stored(sizes.where((F.col("size") > limit) & (F.col("_lo") != F.col("_hi"))).select("region", "size"), "voronoi-big")
        if big.isEmpty():
            return members.drop("whole")
        inside = members.join(big, "region", "left_semi").where("not whole").select("region", "id", "color")
        first = Window.partitionBy("region").orderBy(F.xxhash64(F.lit(level), "id"), "id")
        chosen = inside.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= pivots).select("region", F.col("id").alias("pivot"))
        asked = stored(inside.join(chosen, "region").select("region", "id", "color", "pivot"), "voronoi-asked")
        d = stored(_distances(asked.select("id", "pivot").distinct(), sets), "voronoi-distances")
        near = Window.partitionBy("region", "id")
        at = asked.join(d, ["id", "pivot"]).withColumn("_home", F.min(F.struct("d", "pivot")).over(near))
        at = at.withColumn("home", F.col("_home.pivot") == F.col("pivot"))
        reach = at.where("home").groupBy("region", "pivot").agg(F.max("d").alias("reach"))
        held = at.join(reach, ["region", "pivot"]).where("home or (d <= _home.d + 2 * {r} and d <= reach + {r})".replace("{r}", repr(radius + _EPS)))
        held = stored(held.select("region", "pivot", "id", "color", "home"), "voronoi-held")
        parts = held.groupBy("region", "pivot").agg(F.count("*").alias("n"), F.min("color").alias("_lo"), F.max("color").alias("_hi"))
        work = parts.groupBy("region").agg(F.sum(F.when(F.col("_lo") != F.col("_hi"), F.col("n").cast("double") * F.col("n")).otherwise(0.0)).alias("work"))
        split = big.join(work, "region").where(F.col("work") <= 0.7 * F.col("size") * F.col("size")).select("region")
        stuck = big.join(split, "region", "left_anti").select("region", F.lit(True).alias("stuck"))
        deeper = held.join(split, "region", "left_semi").select(F.xxhash64("region", "pivot").alias("region"), "id", "color", F.lit(False).alias("whole")).distinct()
        rest = members.join(split, "region", "left_anti").join(stuck, "region", "left")
        rest = rest.select("region", "id", "color", (F.col("whole") | F.coalesce("stuck", F.lit(False))).alias("whole"))
        members = stored(rest.unionByName(deeper), "voronoi-members")


def region_links(regions: DataFrame, sets: DataFrame, found: DataFrame, least: Fraction, *, pivots: int = 6, limit: int = 1024) -> DataFrame:
    """Links (l, r) that connect, with those found so far (l, r), whatever is similar inside a region; regions: (region long, id).

    Connected components of what is found are colors; sets of one color need no comparing, and regions of one color
    go. Others are split by pivots, and what remains is compared in blocks of limit members, each block
    returning a spanning set of its links. Nothing is skipped.
    """
    kind = regions.schema["id"].dataType
    colors = connected_components(found).select("id", F.col("component").alias("color"))
    members = regions.join(colors, "id", "left").select("region", "id", F.coalesce("color", "id").alias("color"))
    members = stored(_mixed(members), "metric-members")
    radius = float(1 - least)
    members = _mixed(voronoi_regions(members, sets, radius, pivots=pivots, limit=limit))
    blocks = members.groupBy("region").agg(F.ceil(F.count("*") / limit).cast("int").alias("blocks"))
    dealt = members.join(blocks, "region").join(sets, "id").withColumn("mine", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("region", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b"), "mine", "id", "color", "own")

    def compare(pdf):
        import pandas as pd

        a, b = pdf["a"].iloc[0], pdf["b"].iloc[0]
        left, right = pdf[pdf["mine"] == a], pdf[pdf["mine"] == b]
        if left.empty or right.empty or pdf["color"].nunique() == 1:
            return pd.DataFrame({"l": pdf["id"][:0], "r": pdf["id"][:0]})
        numbers = {c: k for k, c in enumerate(pdf["color"].unique())}
        groups = tuple([numbers[c] for c in side["color"]] for side in (left, right))
        near = spanning_links(*[[np.frombuffer(x, np.int64) for x in side["own"]] for side in (left, right)], groups, least, a == b)
        l, r = left["id"].to_numpy(), right["id"].to_numpy()  # noqa: E741
        return pd.DataFrame({"l": l[[i for i, _ in near]] if near else l[:0], "r": r[[j for _, j in near]] if near else r[:0]})

    return dealt.groupBy("region", "a", "b").applyInPandas(compare, T.StructType([T.StructField("l", kind), T.StructField("r", kind)]))


def _mixed(members: DataFrame) -> DataFrame:
    """members of regions of more than one color."""
    one = members.groupBy("region").agg(F.min("color").alias("_lo"), F.max("color").alias("_hi")).where("_lo <> _hi")
    return members.join(one, "region", "left_semi")


def jaccard_components(docs: DataFrame, *, shingle: int = 4, similarity: str | float = "0.85", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs with an id: id, n_shingles, component_id (the smallest id that links reach, itself included).

    Texts link when their sets of word shingles have a Jaccard similarity of that much or more; A-Z are lower-cased,
    and a text of fewer words is one shingle. Texts without words, null ones too, link with nothing. Rows of
    one id are one document, linked by any of its texts. Rows without an id can't be named and are left out.
    See :func:`jaccard.similar_pairs` for the join.
    """
    from . import jaccard

    least = Fraction(str(similarity))
    two = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = jaccard.signatures(two, shingle, least)
    links, _ = stored_alone(docs.sparkSession, lambda: jaccard.similar_pairs(two, shingle, least, rows=rows, empty_alike=False), "metric-links")
    found = connected_components(links)
    return rows.select("id", F.col("n").cast("long").alias("n_shingles")).join(found, "id", "left").select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
