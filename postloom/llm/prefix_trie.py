"""The trie of the beginnings that conversations share, and its subtree totals by parallel tree contraction."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ordered_parts
from ..storage import stored

#: Columns that add up to the name of a prefix.
_SUMS = ("s0", "s1", "s2", "s3")


def _terms(depth: Column, digest: Column) -> list[Column]:
    """Four numbers below 2**32 for a turn at a depth.

    Their sums over a prefix, as longs, name it: the turns are told apart by depth, so sums can be taken in any
    order and in parts of a conversation of any length (2**31 turns before a sum overflows).
    """
    two = [F.xxhash64(F.lit(k), depth, digest) for k in (1, 2)]
    return [half for x in two for half in (F.shiftrightunsigned(x, 32), x.bitwiseAND(F.lit(0xFFFFFFFF)))]


def _name(sums: Sequence[Column]) -> Column:
    return F.unhex(F.md5(F.concat_ws("|", *[s.cast("string") for s in sums])))


def _running(parts: DataFrame, key: str, order: Sequence[Column | str], values: dict[str, Column]) -> DataFrame:
    """parts with sums of values up to and with each row of its key, by order.

    A range sums its own rows. Only the first key of a range can have begun in an earlier one, so what is carried
    over is a row for each range (the driver's partition count bounds them, hence the broadcast).
    """
    inside = Window.partitionBy("part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = parts.withColumns({k: F.sum(v).over(inside) for k, v in values.items()})
    ends = parts.groupBy("part").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi"))
    sides = stored(ends, "trie-ends")
    spanning = sides.select(F.col("_lo").alias(key)).intersect(sides.select(F.col("_hi").alias(key)))
    totals = parts.join(F.broadcast(spanning), key, "left_semi").groupBy("part", key).agg(*[F.sum(v).alias(f"_{k}") for k, v in values.items()])
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("part", key, *[F.sum(f"_{k}").over(before).alias(f"_{k}") for k in values])
    out = own.join(F.broadcast(carried), ["part", key], "left")
    return out.withColumns({k: F.col(k) + F.coalesce(F.col(f"_{k}"), F.lit(0)) for k in values}).drop(*[f"_{k}" for k in values])


def rebuilt_turns(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, depth, name, above, chars): every turn of every rebuilt conversation, and depth 0 of each.

    Rebuilt: the first h original turns of conversation c - c % 100 (all if fewer, none if absent), then c's own
    after its first h; h = crc32(decimal c) % 6. name stands for the first depth turns, above for those but one.
    Turns go by turn (null first), then by a digest of role and text, so equal rows stay as turns of their own.
    Rows without a conversation id belong to none and are left out.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit("|"), role, text), 256))
    slim = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.substring(digest, 1, 16).alias("digest"), F.length(text).cast("long").alias("chars")
    )
    parts = ordered_parts(slim, [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()], "trie-turns")
    placed = stored(_running(parts, "conv_id", [F.col("turn").asc_nulls_first(), F.col("digest").asc()], {"pos": F.lit(1)}), "trie-placed")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    convs = placed.where("pos = 1").select("conv_id", h.cast("long").alias("h"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base"))
    heads = placed.where("pos <= 5").select(F.col("conv_id").alias("base"), F.col("pos").alias("depth"), "digest", "chars", *[t.alias(s) for s, t in zip(_SUMS, _terms(F.col("pos"), F.col("digest")), strict=True)])
    first = stored(convs.join(heads, "base").where("depth <= h"), "trie-heads")  # at most five rows for each conversation
    up_to = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    head_rows = first.withColumns({f"t{k}": F.col(s) for k, s in enumerate(_SUMS)}).withColumns({s: F.sum(s).over(up_to) for s in _SUMS})
    borrowed = first.groupBy("conv_id").agg(F.max("depth").alias("k"), *[F.sum(s).alias(f"b{j}") for j, s in enumerate(_SUMS)])
    shift = convs.select("conv_id", "h").join(borrowed, "conv_id", "left")
    own = placed.join(shift, "conv_id").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.coalesce("k", F.lit(0)))
    own = own.withColumns({f"t{k}": t for k, t in enumerate(_terms(F.col("depth"), F.col("digest")))})
    kept = stored(own.select("part", "conv_id", "depth", "chars", *[f"t{k}" for k in range(4)], *[F.coalesce(f"b{k}", F.lit(0)).alias(f"b{k}") for k in range(4)]), "trie-own")
    run = _running(kept, "conv_id", ["depth"], {s: F.col(f"t{k}") for k, s in enumerate(_SUMS)})
    run = run.withColumns({s: F.col(s) + F.col(f"b{k}") for k, s in enumerate(_SUMS)})
    fields = ["conv_id", "depth", "chars", *_SUMS, "t0", "t1", "t2", "t3"]
    rows = head_rows.select(fields).unionByName(run.select(fields))
    sums, last = [F.col(s) for s in _SUMS], [F.col(f"t{k}") for k in range(4)]
    below = rows.select("conv_id", "depth", _name(sums).alias("name"), _name([s - t for s, t in zip(sums, last, strict=True)]).alias("above"), "chars")
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), _name([F.lit(0)] * 4).alias("name"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("chars"))
    return below.unionByName(root)


def _lists(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) over ends (name, conv_id): SHA-256 of the decimal ids in ascending order, comma-joined.

    Dealt by ranges of (name, id). A task hashes the names that begin and end in its range; its first and last name,
    which others may share, and names of more than 2**16 ids leave it as pieces of so many. The pieces of a name
    then go through one hash in order: bytes pass one task, as SHA-256 demands, but are never held.
    """

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.binary(), pa.int32(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["name", "part", "seq", "ends_sha256", "piece"])

    def by_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, part, ids, seq, pieces = None, None, [], 0, True
        for b in batches:
            out: list[tuple] = []
            for n, c, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                if n != name:
                    if name is not None:
                        text = ",".join(ids)
                        out.append((name, part, seq, None, text) if pieces else (name, None, None, hashlib.sha256(text.encode()).hexdigest(), None))
                        pieces = False
                    name, ids, seq = n, [], 0
                elif len(ids) == 1 << 16:
                    out.append((name, part, seq, None, ",".join(ids)))
                    ids, seq, pieces = [], seq + 1, True
                ids.append(str(c))
            yield rows_of(out)
        if name is not None:
            yield rows_of([(name, part, seq, None, ",".join(ids))])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, sha = None, None
        for b in batches:
            done = []
            for n, piece in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if n != name:
                    if sha:
                        done.append((name, sha.hexdigest()))
                    name, sha = n, hashlib.sha256(piece.encode())
                else:
                    sha.update(b"," + piece.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.binary()), pa.array([x for _, x in done], pa.string())], ["name", "ends_sha256"])
        if sha:
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.binary()), pa.array([sha.hexdigest()])], ["name", "ends_sha256"])

    dealt = ends.repartitionByRange("name", "conv_id").sortWithinPartitions("name", "conv_id").select("name", "conv_id", F.spark_partition_id().alias("part"))
    found = stored(dealt.mapInArrow(by_range, "name binary, part int, seq long, ends_sha256 string, piece string"), "trie-pieces")
    pieces = found.where("piece is not null").repartition("name").sortWithinPartitions("name", "part", "seq").select("name", "piece")
    return found.where("piece is null").select("name", "ends_sha256").unionByName(pieces.mapInArrow(chain, "name binary, ends_sha256 string"))


def subtree_totals(tree: DataFrame, sums: Sequence[str], *, id_col: str = "name", parent_col: str = "above") -> DataFrame:
    """tree's ids with the totals of sums over each subtree, by rounds of rake and compress; parents are null at roots.

    rake: a vertex without children left has its total; what leaves bring is summed by parent, map-side first.
    compress: a vertex with one child left goes if a coin of its id shows heads and that of the child tails; the
    child takes its parent, with what the gone vertex weighs on the way up. About a quarter or more of each chain
    goes in each round, so rounds grow with the logarithm of the vertices. Then the rounds are undone in reverse:
    a gone vertex's total is its child's plus what stood between. The tables of the rounds shrink in proportion.
    """
    zero = F.lit(0).cast("long")
    kids = tree.where(F.col(parent_col).isNotNull()).groupBy(F.col(parent_col).alias("id")).agg(F.count("*").alias("n"))
    base = tree.select(F.col(id_col).alias("id"), F.col(parent_col).alias("up"), *[F.col(s).cast("long").alias(f"a_{s}") for s in sums], *[zero.alias(f"e_{s}") for s in sums])
    live = stored(base.join(kids, "id", "left").withColumn("n", F.coalesce("n", zero)), "tree-live")
    rounds: list[tuple[DataFrame, DataFrame]] = []
    leaf = F.col("n") == 0
    for k in count():
        if live.isEmpty():
            break
        coin = lambda c, k=k: F.pmod(F.xxhash64(F.lit(k), c), F.lit(2)) == 1
        brought = live.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("id")).agg(
            F.count_if(leaf).alias("gone"),
            F.min(F.when(~leaf, F.col("id"))).alias("child"),
            *[F.coalesce(F.sum(F.when(leaf, F.col(f"a_{s}") + F.col(f"e_{s}"))), zero).alias(f"r_{s}") for s in sums],
            *[F.coalesce(F.sum(F.when(~leaf, F.col(f"e_{s}"))), zero).alias(f"c_{s}") for s in sums],
        )
        raked = live.where(~leaf).join(brought, "id")
        unary = (F.col("n") - F.col("gone") == 1) & F.col("up").isNotNull()
        raked = raked.select(
            "id", "up", (F.col("n") - F.col("gone")).alias("n"), F.when(unary & coin(F.col("id")) & ~coin(F.col("child")), F.col("child")).alias("child"),
            *[(F.col(f"a_{s}") + F.col(f"r_{s}")).alias(f"a_{s}") for s in sums], *[f"e_{s}" for s in sums], *[f"c_{s}" for s in sums],
        )
        rest = stored(raked, "tree-raked")
        rounds.append((live.where(leaf).select("id", *[F.col(f"a_{s}").alias(s) for s in sums]), rest))
        gone = rest.where("child is not null").select(F.col("child").alias("id"), F.col("up").alias("_up"), F.lit(True).alias("_hit"), *[(F.col(f"a_{s}") + F.col(f"e_{s}")).alias(f"_{s}") for s in sums])
        stay = rest.where("child is null").join(gone, "id", "left")
        live = stored(
            stay.select(
                "id", F.when(F.col("_hit"), F.col("_up")).otherwise(F.col("up")).alias("up"), "n", *[f"a_{s}" for s in sums],
                *[(F.col(f"e_{s}") + F.coalesce(f"_{s}", zero)).alias(f"e_{s}") for s in sums],
            ),
            "tree-live",
        )
    totals = None
    for k, (leaves, rest) in reversed(list(enumerate(rounds))):
        if totals is None:
            totals = leaves
            continue
        known = totals.select(F.col("id").alias("at"), *sums)
        own = rest.withColumn("at", F.coalesce("child", "id")).join(known, "at")
        between = [F.when(F.col("child").isNotNull(), F.col(f"a_{s}") + F.col(f"c_{s}")).otherwise(zero) for s in sums]
        totals = leaves.unionByName(own.select("id", *[(F.col(s) + b).alias(s) for s, b in zip(sums, between, strict=True)]))
        if k % 4 == 0:
            totals = stored(totals, "tree-totals")
    if totals is None:
        totals = live.select("id", *[F.col(f"a_{s}").alias(s) for s in sums])
    return totals.withColumnRenamed("id", id_col)


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """One row for each distinct beginning of the rebuilt conversations; see :func:`rebuilt_turns`.

    conv_id (smallest member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves and
    saved_tokens over the subtree, ends_sha256 of the members that end here. Null roles and texts are empty.
    A prefix is known by 128 bits over its turns. A table without conversations has no root and no rows.
    """
    members = stored(rebuilt_turns(turns, **columns), "trie-members")
    per = members.groupBy("name").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("above").alias("above"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"))
    nodes = stored(per, "trie-nodes")
    weighed = nodes.select("name", "above", ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    kids = nodes.where("above is not null").groupBy(F.col("above").alias("name")).agg(F.count("*").alias("n_children"))
    marked = weighed.join(kids, "name", "left").withColumn("n_leaves", F.col("n_children").isNull().cast("long"))
    totals = subtree_totals(marked, ["n_leaves", "saved_tokens"])
    last = members.groupBy("conv_id").agg(F.max_by("name", "depth").alias("name"))
    parents = nodes.select(F.col("name").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(totals, "name").join(kids, "name", "left").join(_lists(last.select("name", "conv_id")), "name", "left").join(parents, "above", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )


ORACLE = """
WITH numbered AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(str_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
             lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, (v & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM numbered)
), rebuilt AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY own, pos) AS depth, role, text
  FROM (SELECT c.conv_id, 0 AS own, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.base AND n.pos <= c.h
        UNION ALL SELECT c.conv_id, 1, n.pos, n.role, n.text FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.pos > c.h)
), keyed AS (
  SELECT conv_id, depth, length(text) AS chars, sha256(string_agg(sha256(role) || sha256(text), '') OVER (PARTITION BY conv_id ORDER BY depth)) AS name
  FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM convs
), nodes AS (
  SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars FROM keyed GROUP BY name, depth
), linked AS (
  SELECT n.*, p.name AS above, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN keyed k ON k.conv_id = n.conv_id AND k.depth = n.depth - 1 LEFT JOIN nodes p ON p.name = k.name AND p.depth = k.depth
), kids AS (SELECT above AS name, count(*) AS n_children FROM linked WHERE above IS NOT NULL GROUP BY 1
), spread AS (
  SELECT k.name, sum((l.n_convs - 1) * l.chars) AS saved_tokens, count(*) FILTER (c.n_children IS NULL) AS n_leaves
  FROM linked l LEFT JOIN kids c USING (name) JOIN keyed k ON k.conv_id = l.conv_id AND k.depth <= l.depth GROUP BY k.name
), ends AS (
  SELECT name, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM (SELECT conv_id, arg_max(name, depth) AS name FROM keyed GROUP BY conv_id) GROUP BY name
)
SELECT l.conv_id, l.depth::BIGINT AS depth, l.parent_conv_id, l.n_convs, coalesce(c.n_children, 0)::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM linked l JOIN spread s USING (name) LEFT JOIN kids c USING (name) LEFT JOIN ends e USING (name)
"""
