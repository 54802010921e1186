"""Mixing sources to target weights by systematic sampling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ranks import ordered_parts, prefix_sums
from ..storage import stored

#: A word: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def source_targets(sizes: DataFrame, source_col: str, *, weights: Sequence[int] = (5, 2, 1), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """(source, source_size, target, rank) for each source of sizes (source, size).

    Sources in code point order, null last, take the weights in turn. share times all words is divided by weight;
    no target exceeds cap times its source's words, and what is over goes to the others by weight. That is one
    water level: sources in order of their size by weight fill up until the level that uses up the rest fits.
    Ranks and sums over the sources are taken in ranges, as sources can be as many as web hosts.
    """
    per = sizes.groupBy(F.col(source_col).alias("source")).agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    ranked = prefix_sums(ordered_parts(per, order, "mix-sources"), F.lit(1), order, "rank")
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weighed = ranked.select("source", "source_size", "rank", F.element_at(turn, (F.pmod("rank", F.lit(len(weights))) + 1).cast("int")).alias("weight"))
    fill = [F.col("source_size") / F.col("weight"), F.col("rank")]
    parts = ordered_parts(weighed, fill, "mix-fill")
    full = prefix_sums(parts, F.col("source_size"), fill, "full")
    both = prefix_sums(full, F.col("weight"), fill, "lighter")
    every = parts.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weights"))
    level = (F.col("words") * share - F.col("full") * cap) / (F.col("weights") - F.col("lighter"))
    levels = stored(both.crossJoin(F.broadcast(every)).withColumn("level", level), "mix-levels")
    fits = levels.where(F.col("level") * F.col("weight") <= F.col("source_size") * cap)
    mark = fits.agg(F.min(F.struct(F.col("source_size") / F.col("weight"), "rank", "level"))["level"].alias("mark"))  # one row
    most = F.col("source_size") * F.lit(float(cap))
    target = F.least(most, F.coalesce(F.col("mark") * F.col("weight"), most))
    return levels.crossJoin(F.broadcast(mark)).select(F.col("source").alias(source_col), "source_size", target.alias("target"), "rank")


def _decisions(
    docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[int], share: float, cap: float, seed: str
) -> DataFrame:
    """(id, source, size, hash, source_size, target, copies) for each row of docs."""
    parts = ordered_parts(docs.select(*_marks(id_col, text_col, source_col)), _order(), "mix-order")
    targets = stored(source_targets(parts.select("source", "size"), "source", weights=weights, share=share, cap=cap), "mix-targets")
    ranked = prefix_sums(parts, F.lit(1), _order()[1:], "before", ["source"])
    # joined by range and source: a range is as small as any other, a source may not be
    by_part, t = parts.select("part", "source").distinct().alias("p"), targets.alias("t")
    known = by_part.join(t, F.col("p.source").eqNullSafe(F.col("t.source"))).select(
        F.col("p.part").alias("at_part"), F.col("p.source").alias("at_source"), "source_size", "target"
    )
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("source"), F.lit("")))), 1, 8)
    offset = F.conv(digits, 16, 10).cast("double") / F.lit(4294967296.0)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor((F.col("before") + 1) * rate + offset) - F.floor(F.col("before") * rate + offset)
    joined = ranked.join(known, (F.col("part") == F.col("at_part")) & F.col("source").eqNullSafe(F.col("at_source")))
    return joined.select("id", "source", "size", "hash", "source_size", "target", copies.cast("long").alias("copies"))


def _marks(id_col: str, text_col: str, source_col: str) -> list[Column]:
    size = F.coalesce(F.regexp_count(F.col(f"`{text_col}`"), F.lit(WORD)), F.lit(0)).cast("long")
    text = F.col(f"`{text_col}`")
    return [F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size.alias("size"), F.xxhash64(text).alias("hash")]


def _order() -> list[Column]:
    """By source, then that of the documents within it."""
    return [F.col("source").asc_nulls_last(), F.col("size"), F.col("id"), F.col("hash")]


def mixture_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) for each row of docs; taken is copies times size.

    A document's expected copies are target / source_size of its source. Within a source, documents stand in order
    of size and id; the prefix sums of expected copies get one offset in [0, 1) from the md5 of seed and source,
    and a document is taken once for each integer that its interval holds. The order by size makes every
    stretch of sizes take its part, so the words taken come near the target. Reruns agree. Prefix sums are taken
    in ranges of the order and offset by the totals of the ranges before, so a source with a third of all rows
    is spread over many tasks.

    A null text has size 0, a null source is a source; null ids come first, repeated rows count as documents of
    their own. Sources without words get as many expected copies as target / size can't give: none. Columns other
    than those named are not read. An empty table gives no rows.
    """
    found = _decisions(docs, id_col, text_col, source_col, weights, share, cap, seed)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return found.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "copies", taken)


def mix_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    *,
    weights: Sequence[int] = (5, 2, 1),
    share: float = 1.5,
    cap: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The mixture itself: each row of docs as often as :func:`mixture_copies` says, with the columns of docs, whatever their names.

    The decisions are made on sizes alone and then merged with the rows by id, source and hash of the text, so texts are
    dealt once, by a hash, however long texts of one size stand together. Rows that agree in all three share
    their copies: each takes an even part, the first of them what is over.
    """
    found = _decisions(docs, id_col, text_col, source_col, weights, share, cap, seed)
    found = found.groupBy("id", "source", "hash").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")).where("copies > 0")
    found = stored(found, "mix-decisions")
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_marks(id_col, text_col, source_col)).alias("d")
    f = found.alias("f").hint("merge")
    same = F.col("d.id").eqNullSafe(F.col("f.id")) & F.col("d.source").eqNullSafe(F.col("f.source")) & (F.col("d.hash") == F.col("f.hash"))

    def emitted(df: DataFrame) -> DataFrame:
        return df.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select("row.*")

    one = own.join(f.where("rows = 1"), same).select("row", "copies")
    if found.where("rows > 1").isEmpty():
        return emitted(one)
    key = ["id", "source", "hash"]
    again = own.join(f.where("rows > 1"), same).select("row", *[f"f.{c}" for c in key], "copies", "rows")
    place = [*[F.col(c) for c in key], F.xxhash64(F.to_json("row"))]
    turn = prefix_sums(ordered_parts(again, [*place, F.monotonically_increasing_id()], "mix-again"), F.lit(1), place, "turn", key)
    part = F.floor(F.col("copies") / F.col("rows")) + (F.col("turn") < F.pmod(F.col("copies"), F.col("rows"))).cast("long")
    return emitted(one).unionByName(emitted(turn.select("row", part.alias("copies"))))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM s),
w AS (SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight FROM r),
f AS (SELECT *, sum(source_size) OVER () AS total,
        coalesce(sum(source_size) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(weight) OVER (ORDER BY source_size / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
l AS (SELECT *, (total::DOUBLE * 1.5::DOUBLE - filled::DOUBLE * 2.0::DOUBLE) / rest::DOUBLE AS level FROM f),
m AS (SELECT arg_min(level, (source_size / weight, rank)) AS mark FROM l WHERE level * weight <= source_size * 2.0::DOUBLE),
t AS (SELECT source, source_size, least(source_size * 2.0::DOUBLE, coalesce(mark * weight, source_size * 2.0::DOUBLE)) AS target FROM l, m),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
        row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS before,
        ('0x' || substr(md5('mix|' || coalesce(d.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS off,
        CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((floor((before + 1) * rate + off) - floor(before * rate + off))::BIGINT * size)::BIGINT AS taken FROM p
"""
