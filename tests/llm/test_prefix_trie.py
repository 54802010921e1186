import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from postloom.llm import prefix_trie as m


def slow(rows):
    """Plain version over (conv_id, turn, role, text) without ties of turns."""
    own = defaultdict(list)
    for c, t, r, x in sorted((x for x in rows if x[0] is not None), key=lambda x: (x[0], x[1] is not None, x[1] or 0)):
        own[c].append((r or "", x or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
        ends[turns].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], sha))
    return sorted(out, key=lambda x: (x[1], x[0]))


def fast(df):
    got = m.conversation_trie(df).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted(map(tuple, got.collect()), key=lambda x: (x[1], x[0]))


def test_trie_equals_plain_one_with_long_and_odd_conversations(spark):
    rng = random.Random(4)
    rows = [(7, t, "user", f"turn {t % 3}") for t in range(150)]  # a chain that many ranges share
    rows += [(107, t, "user", f"turn {t % 3}") for t in range(140)]
    for c in [*range(200, 260), 5, 300, 301]:
        rows += [(c, t if t else None, rng.choice(["user", None, ""]), rng.choice(["a", "bé", None, ""])) for t in range(rng.randrange(1, 7))]
    rows += [(None, 0, "user", "no conversation"), (-3, 1, "user", "x"), (-100, 1, "user", "y"), (-100, 2, "user", "z")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("part", "name", "n", "pos")})
    want = slow([r if r[0] is None or r[0] >= 0 else r for r in rows if r[0] is None or r[0] >= 0])
    assert fast(df.where("conv_id >= 0 or conv_id is null")) == want
    signed = {r[0] for r in fast(df)}
    assert {-3, -100} & signed  # ids below zero make nodes too
    assert m.conversation_trie(df.limit(0)).count() == 0


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (2, 0, "user", "a")]
    got = fast(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert got == slow([(1, 0, "user", "a"), (1, 1, "user", "a"), (2, 0, "user", "a")])


def test_contraction_of_chains_stars_and_combs(spark):
    edges = [(i, i - 1 if i else None) for i in range(90)] + [(1000 + i, 89 if i % 2 else i) for i in range(80)] + [(5000, None)]
    up, weight = dict(edges), {v: v % 7 + 1 for v, _ in edges}
    total = dict(weight)
    for v in sorted(up, key=lambda v: -sum(1 for _ in iter(lambda s=[v]: s.append(up[s.pop()]) or s[0], None))):
        if up[v] is not None:
            total[up[v]] += total[v]
    df = spark.createDataFrame([(v, p, weight[v]) for v, p in edges], "name long, above long, w long")
    assert {r["name"]: r["w"] for r in m.subtree_totals(df, ["w"]).collect()} == total


def test_lists_of_ends_in_pieces(spark):
    ends = [(b"a", i) for i in range(70_000)] + [(b"b", 5), (b"c", -1), (b"c", 10), (b"c", 9)]
    got = {bytes(r["name"]): r["ends_sha256"] for r in m._lists(spark.createDataFrame(ends, "name binary, conv_id long")).collect()}
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    assert got == {b"a": sha(range(70_000)), b"b": sha([5]), b"c": sha([-1, 9, 10])}
