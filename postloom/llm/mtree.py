"""Exact top-k by inner product with M-trees."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import ordered_parts, prefix_sums
from ..storage import stored

#: Entries of a page, children of a routing page.
PAGE, FAN = 128, 32


def integer_vectors(df: DataFrame, id_col: str, vec_col: str, asks: Column, scale: float = 256.0) -> DataFrame:
    """(id, v, asks) with v = floor(scale * x) for each component, without null ids and vectors that are null or hold null or non-finite components."""
    x = F.col(vec_col)
    bad = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == F.lit(float("inf")))
    whole = F.col(id_col).isNotNull() & x.isNotNull() & ~F.exists(x, bad)
    return df.where(whole).select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long")).alias("v"), F.coalesce(asks, F.lit(False)).alias("asks"))


def build_pages(vectors: np.ndarray, lift: np.ndarray) -> list[dict]:
    """Pages of an M-tree over distinct objects, page 0 the root.

    Distances are Euclidean over the vectors with ``lift`` as one more component. A routing entry has an object, the radius
    that covers all objects below it, its distance to the object of the page above and a child page; a leaf entry has
    an object and that distance.
    """
    pages: list[dict] = []
    norms = (vectors**2).sum(axis=1) + lift**2

    def far(rows: np.ndarray, to: int) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, norms[rows] + norms[to] - 2 * (vectors[rows] @ vectors[to] + lift[rows] * lift[to])))

    line = [(np.arange(len(vectors)), 0, None)]
    pages.append({})
    while line:
        rows, page, above = line.pop()
        over = np.zeros(len(rows)) if above is None else far(rows, above)
        if len(rows) <= PAGE:
            pages[page] = {"leaf": True, "rows": rows, "over": over}
            continue
        # the children's objects: spread evenly over the order of distance to the first object
        order = rows[np.argsort(far(rows, rows[0]), kind="stable")]
        heads = order[np.linspace(0, len(order) - 1, min(FAN, -(-len(rows) // PAGE) * 2)).astype(int)]
        heads = np.unique(heads)
        near = np.argmin(np.stack([far(rows, h) for h in heads]), axis=0)
        groups = [(h, rows[near == g]) for g, h in enumerate(heads) if (near == g).any()]
        if len(groups) < 2:  # objects that can't be told apart by distance
            groups = [(part[0], part) for part in np.array_split(rows, -(-len(rows) // PAGE))]
        kids, radii = [], []
        for h, group in groups:
            kids.append(len(pages))
            pages.append({})
            radii.append(far(group, h).max())
            line.append((group, kids[-1], h))
        at = np.array([h for h, _ in groups])
        pages[page] = {"leaf": False, "rows": at, "over": np.zeros(len(at)) if above is None else far(at, above), "radius": np.array(radii), "child": np.array(kids)}
    return pages


def exact_products(rows: np.ndarray, query: np.ndarray) -> list[int]:
    """Inner products of integer rows with an integer query, exact whatever their size; what a long can't hold becomes its limit."""
    if not len(rows):
        return []
    most = float(np.abs(query.astype(float)).sum()) * float(np.abs(rows.astype(float)).max())
    if most < 2**53:
        return (rows.astype(float) @ query.astype(float)).astype(np.int64).tolist()
    if most < 2**62:
        return (rows @ query).tolist()
    q = query.tolist()
    return [max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(r, q, strict=True)))) for r in rows.tolist()]


def _best(found: list[tuple[int, int]], k: int, each: int) -> list[tuple[int, int]]:
    """The k (score, id) that come first, at most ``each`` of one id."""
    out, seen = [], {}
    for s, i in sorted(found, key=lambda x: (-x[0], x[1])):
        if seen.get(i, 0) < each:
            seen[i] = seen.get(i, 0) + 1
            out.append((s, i))
            if len(out) == k:
                break
    return out


def search_pages(
    pages: list[dict], vectors: np.ndarray, norms: float, ids: list[list[int]], query: np.ndarray, k: int, worst: int | None, each: int | None = None
) -> list[tuple[int, int]]:
    """The k (score, id) of largest inner product with query, at most ``each`` of one id, ties to the smaller id; those below ``worst`` may be missing.

    vectors and query are integers: bounds are worked out in floating point with some slack, scores exactly.
    norms is the square of all objects' length with their last component.
    Pages wait in order of the least distance that an object below them can have. A routing or leaf entry whose stored distance to
    the object above differs too much from the query's own distance to it can't hold a nearer one and is passed
    over before its distance is worked out.
    """
    whole, query = query, query.astype(float)
    q2 = float(query @ query)
    each = each or k
    top: list[tuple[int, int]] = []
    limit = np.inf if worst is None else _reach(q2, norms, worst)
    slack = 1e-7 * (1 + np.sqrt(q2 + norms))
    wait: list[tuple[float, int, float]] = [(0.0, 0, -1.0)]
    while wait:
        bound, page, above = heapq.heappop(wait)
        if bound > limit + slack:
            break
        p = pages[page]
        rows = p["rows"]
        if above >= 0:
            least = np.abs(above - p["over"]) - (0 if p["leaf"] else p["radius"])
            keep = np.flatnonzero(least <= limit + slack)
            rows = rows[keep]
        else:
            keep = np.arange(len(rows))
        if not len(rows):
            continue
        score = vectors[rows].astype(float) @ query
        dist = np.sqrt(np.maximum(0.0, q2 + norms - 2 * score))
        if p["leaf"]:
            near = np.flatnonzero(dist <= limit + slack)
            if not len(near):
                continue
            products = exact_products(vectors[rows[near]], whole)
            top = _best([*top, *[(s, i) for j, s in zip(near, products, strict=True) for i in ids[rows[j]]]], k, each)
            if len(top) == k:
                limit = min(limit, _reach(q2, norms, top[-1][0]))
        else:
            for j, d in zip(keep.tolist(), dist.tolist(), strict=True):
                low = max(bound, d - p["radius"][j])
                if low <= limit + slack:
                    heapq.heappush(wait, (low, int(p["child"][j]), d))
    return top


def _reach(q2: float, norms: float, score: int) -> float:
    return float(np.sqrt(max(0.0, q2 + norms - 2 * score)))


def _numbered(roots: DataFrame) -> DataFrame:
    order = [F.col("tree")]
    return prefix_sums(ordered_parts(roots, order, "mtree-order"), F.lit(1), order, "n").drop("part")


_PAGE_SQL = "tree long, page int, leaf boolean, rows binary, over binary, radius binary, child binary, vectors binary, ids array<array<long>>, head binary, cover double, n int, dim int"


def _pack(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def top_k(df: DataFrame, *, queries: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, scale: float = 256.0, tree_size: int = 4096, root_block: int = 4096) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` holds of, the k other rows of largest integer inner product.

    Scores are inner products of the vectors floor(scale * x); ties go to the smaller id; fewer rows than k give all. One more
    component, the root of what a vector's square lacks to the largest, makes all vectors as long as each other, so the
    nearest by distance are the largest by inner product, and M-trees apply. Equal vectors are one object with their
    k + 1 smallest ids, up to k rows of each: others can't come into any result, so a large group of copies is one entry.
    A search keeps 2 k rows, at most k of one id, so k are left whichever id asks. Objects are dealt
    to the nearest of some spread objects and, where more than about tree_size gather, by hash; each part becomes one
    tree, whose pages are written. A query first searches the tree with the nearest root, then those whose covering
    radius lets them hold something as near as what it has. Roots go out in blocks of root_block, so the broadcast
    is bounded.

    Rows with a null id, vector or component or a non-finite one take no part; shorter vectors count as filled up with zeros;
    repeated ids are rows of their own and don't find themselves by that id; an empty table gives no rows. Components beyond a long
    count as its limits, and so do scores; up to there they are exact.
    """
    spark = df.sparkSession
    base = stored(integer_vectors(df, id_col, vec_col, queries, scale), "mtree-vectors")
    facts = base.agg(F.max(F.size("v")).alias("dim"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most"), F.count("*").alias("n")).first()
    out = "query_id long, rank int, vec_id long, score long"
    if not facts["n"] or not facts["dim"]:
        return spark.createDataFrame([], out)
    dim, most = int(facts["dim"]), float(facts["most"])
    base = base.select("id", "asks", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v"))
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    held = base.groupBy("v", "id").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("times")).withColumn("r", first).where(F.col("r") <= k + 1)
    objects = held.groupBy("v").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("id", "times"))), lambda x: F.array_repeat(x["id"], x["times"]))).alias("ids"))
    objects = stored(objects, "mtree-objects")
    n = objects.count()
    n_heads = max(1, min(1024, -(-n // tree_size)))
    heads = np.array([r["v"] for r in objects.orderBy(F.xxhash64("v"), "v").limit(n_heads).collect()], float)

    def lifted(v: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, most - (v**2).sum(axis=1)))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up = lifted(heads)
        for b in batches:
            if len(b):
                v = np.array(b.v.tolist(), float)
                # all have the same length once lifted: the nearest is the one of largest product
                yield b.assign(head=(v @ heads.T + np.outer(lifted(v), up)).argmax(axis=1))

    dealt = stored(objects.mapInPandas(nearest, "v array<long>, ids array<long>, head long"), "mtree-dealt")
    parts = dealt.groupBy("head").agg(F.ceil(F.count("*") / tree_size).alias("parts"))
    by_tree = dealt.join(parts, "head").withColumn("tree", F.col("head") * F.lit(1 << 32) + F.pmod(F.xxhash64("v"), F.col("parts"))).select("tree", "v", "ids")

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ids", key=lambda s: s.map(lambda x: x[0]))
        whole = np.array(pdf.v.tolist(), np.int64)
        v = whole.astype(float)
        lift, ids = lifted(v), pdf.ids.tolist()
        pages = build_pages(v, lift)
        head = v.mean(axis=0)
        up = lift.mean()
        cover = float(np.sqrt(((v - head) ** 2).sum(axis=1) + (lift - up) ** 2).max())
        rows = []
        for i, p in enumerate(pages):
            none = np.empty(0)
            rows.append((pdf.tree.iloc[0], i, p["leaf"], _pack(p["rows"].astype("i8")), _pack(p["over"]), _pack(p.get("radius", none)), _pack(p.get("child", none).astype("i8")), _pack(whole[p["rows"]]), [list(ids[j]) for j in p["rows"]] if p["leaf"] else [], _pack(np.append(head, up)), cover, len(v), dim))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in _PAGE_SQL.split(", ")])

    trees = stored(by_tree.groupBy("tree").applyInPandas(build, _PAGE_SQL), "mtree-pages")

    asked = base.where("asks")
    wanted = stored(asked.groupBy("v").agg(F.min("id").alias("q")), "mtree-queries")
    roots = stored(trees.where("page = 0").select("tree", "head", "cover").transform(_numbered).withColumn("block", F.floor(F.col("n") / root_block)), "mtree-roots")
    blocks = [r["block"] for r in roots.select("block").distinct().orderBy("block").collect()]

    def root_block_of(b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows = roots.where(F.col("block") == b).orderBy("tree").collect()
        return np.array([r["tree"] for r in rows]), np.array([np.frombuffer(r["head"]) for r in rows]), np.array([r["cover"] for r in rows])

    def gaps(pdf: pd.DataFrame, head: np.ndarray) -> np.ndarray:
        q = np.array(pdf.v.tolist(), float)
        two = (q**2).sum(axis=1)[:, None] + (head**2).sum(axis=1)[None] - 2 * q @ head[:, :-1].T
        return np.sqrt(np.maximum(0.0, two))

    def reach_of(send, pick: str):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            names, head, cover = send.value
            for b in batches:
                if not len(b):
                    continue
                d = gaps(b, head)
                if pick == "home":
                    best = d.argmin(axis=1)
                    yield pd.DataFrame({"q": b.q, "v": b.v, "tree": names[best], "d": d[np.arange(len(b)), best]})
                    continue
                q2 = (np.array(b.v.tolist(), float) ** 2).sum(axis=1)
                worst = b.worst.to_numpy(float, na_value=np.nan)
                limit = np.where(np.isnan(worst), np.inf, np.sqrt(np.maximum(0.0, q2 + most - 2 * np.nan_to_num(worst))))
                hit = (d - cover <= limit[:, None] + 1e-6 * (1 + np.sqrt(q2 + most))[:, None]) & (names[None] != b.home.to_numpy()[:, None])
                at, to = np.nonzero(hit)
                yield pd.DataFrame({"q": b.q.to_numpy()[at], "v": b.v.to_numpy()[at], "tree": names[to], "worst": b.worst.astype("Int64").to_numpy()[at]})

        return run

    def search(pages: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(pages) or not len(asked):
            return pd.DataFrame({"q": [], "score": [], "id": []}, dtype="int64")
        total = int(pages.n.iloc[0])
        v, ids, whole = np.zeros((total, dim), np.int64), [[]] * total, []
        for p in pages.sort_values("page").itertuples():
            rows = np.frombuffer(p.rows, "i8")
            v[rows] = np.frombuffer(p.vectors, np.int64).reshape(-1, dim)
            if p.leaf:
                for j, own in zip(rows.tolist(), p.ids, strict=True):
                    ids[j] = list(own)
            whole.append({"leaf": p.leaf, "rows": rows, "over": np.frombuffer(p.over), "radius": np.frombuffer(p.radius), "child": np.frombuffer(p.child, "i8")})
        rows = []
        for a in asked.itertuples():
            worst = None if pd.isna(a.worst) else int(a.worst)
            rows += [(a.q, s, i) for s, i in search_pages(whole, v, most, ids, np.array(a.v, np.int64), 2 * k, worst, k)]
        return pd.DataFrame(rows, columns=["q", "score", "id"], dtype="int64")

    def searched(visits: DataFrame) -> DataFrame:
        """Trees and the queries that visit them, both dealt by tree; many queries of one tree are dealt in parts with a copy of it."""
        visits = stored(visits, "mtree-visits")
        many = visits.groupBy("tree").agg(F.ceil(F.count("*") / 2048).cast("int").alias("parts"))
        left = trees.join(many, "tree").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        right = visits.join(many, "tree").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")).cast("int")).select("tree", "part", "q", "v", "worst")
        return stored(left.groupBy("tree", "part").cogroup(right.groupBy("tree", "part")).applyInPandas(search, "q long, score long, id long"), "mtree-found")

    home = None
    for b in blocks:
        send = spark.sparkContext.broadcast(root_block_of(b))
        own = wanted.mapInPandas(reach_of(send, "home"), "q long, v array<long>, tree long, d double")
        home = own if home is None else home.union(own)
    home = stored(home.groupBy("q").agg(F.first("v").alias("v"), F.min_by("tree", F.struct("d", "tree")).alias("home")), "mtree-home")
    near = searched(home.select(F.col("home").alias("tree"), "q", "v", F.lit(None).cast("long").alias("worst")))
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    worst = near.withColumn("r", F.row_number().over(order)).where(F.col("r") == 2 * k).select("q", F.col("score").alias("worst"))
    known = stored(home.join(worst, "q", "left"), "mtree-known")
    more = None
    for b in blocks:
        send = spark.sparkContext.broadcast(root_block_of(b))
        own = known.mapInPandas(reach_of(send, "others"), "q long, v array<long>, tree long, worst long")
        more = own if more is None else more.union(own)
    found = near.union(searched(more.select("tree", "q", "v", "worst")))
    own = F.row_number().over(Window.partitionBy("q", "id").orderBy(F.desc("score")))
    found = found.withColumn("own", own).where(F.col("own") <= k)
    best = found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= 2 * k).select("q", "score", "id")
    every = asked.select(F.col("id").alias("query_id"), "v").join(wanted, "v").select("query_id", "q")
    pairs = every.join(best, "q").where("id <> query_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias("vec_id"), "score").to(spark.createDataFrame([], out).schema)



ORACLE = """
WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM b q JOIN b c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM p QUALIFY rank <= 5
"""
