import datetime as dt
import random

from pyspark.sql import functions as F

from postloom.operators import enrich as m

T0 = dt.datetime(2026, 7, 10)
SCHEMA = "ids array<string>, urls array<string>, checked_at timestamp, verified boolean, experience string, work_hours string, experience_domain string, evidence_field string, evidence string, strength string"
FIELDS = ("experience", "work_hours")


def details(rng, n):
    pick = lambda *v: rng.choice(v)
    return [
        (rng.sample([f"a{k}" for k in range(25)], rng.randrange(0, 3)), [pick(f"https://x/{rng.randrange(30)}", None, " ")], T0 - dt.timedelta(hours=rng.randrange(200)), rng.random() < 0.9, pick("경력 3년", "신입", "원문 확인", None), pick("09:00~18:00", "", None),
         pick("clinical", "health-manager", "nursing-general", "unspecified", "nonsense", None), "title", pick("evidence", "other", "", None), pick("explicit", "title-context", "explicit-detail", None))
        for _ in range(n)
    ]


def test_batches_merge_in_any_order(spark):
    rng = random.Random(13)
    rows = details(rng, 60)
    batch = lambda part: m.details_state(spark.createDataFrame(part, SCHEMA), FIELDS)
    whole = sorted(map(str, m.merge_states(batch(rows)).collect()))
    a, b, c = rows[:20], rows[20:25], rows[25:]
    assert sorted(map(str, m.merge_states(batch(c), m.merge_states(batch(b), batch(a))).collect())) == whole
    assert sorted(map(str, m.merge_states(m.merge_states(batch(a), batch(c)), batch(b), batch(a)).collect())) == whole
    # the plain version: rows that share a name are one, each field by its newest value
    good = [r for r in rows if r[3]]
    names = [{"i" + x for x in r[0]} | {"u" + u.strip() for u in r[1] if u and u.strip()} for r in good]
    good, names = zip(*[(g, n) for g, n in zip(good, names, strict=True) if n], strict=True)
    groups = []
    for g, n in zip(good, names, strict=True):
        near = [x for x in groups if x[0] & n]
        groups = [x for x in groups if not x[0] & n] + [(set.union(n, *[x[0] for x in near]), [g, *[y for x in near for y in x[1]]])]
    got = {r["entry"]: r for r in m.merge_states(batch(rows)).collect()}
    assert set(got) == {min(n) for n, _ in groups}
    for n, members in groups:
        r = got[min(n)]
        assert set(r["names"]) == n
        known = [(g[2], g[4]) for g in members if g[4] and g[4] != "원문 확인"]
        assert (r["f_experience"] and tuple(r["f_experience"])) == (max(known) if known else None)


def test_overlay(spark):
    rows = [
        (["a"], ["https://x/1"], T0, True, "경력 3년", "09:00~18:00", "clinical", "body", "ward", "explicit"),
        (["b"], ["https://x/2"], T0, True, "신입", None, "nursing-general", "body", "nurse", "explicit-detail"),
        (["c"], [], T0 - dt.timedelta(days=8), True, "신입", None, None, None, None, None),
        (["d", "e"], [], T0, True, None, "10:00", "clinical", "t", "x", "explicit"),
        (["e"], [], T0, True, None, None, "health-manager", "t", "y", "explicit"),
        (["f"], ["https://x/9"], T0, False, "신입", None, None, None, None, None),
    ]
    state = m.merge_states(m.details_state(spark.createDataFrame(rows, SCHEMA), FIELDS))
    posts = [
        (0, "a", None, None, None, "원문 확인", None, None, None, "k"),
        (1, "z", ["b"], "https://x/1", None, None, "own hours", "clinical", "title-context", "k"),  # an id goes before an address
        (2, "z2", None, "https://y", ["https://x/1"], "신입", None, "clinical", "title-context", "k"),
        (3, "c", None, None, None, None, None, None, None, "k"),
        (4, "d", None, None, None, None, None, "nursing-general", None, "k"),
        (5, "f", None, "https://x/9", None, None, None, None, None, "k"),
        (6, None, None, None, None, None, None, None, None, "k"),
    ]
    df = spark.createDataFrame(posts, "ord int, id string, source_ids array<string>, url string, alternate_urls array<string>, experience string, work_hours string, experience_domain string, evidence_strength string, profile_key string")
    got = {r["ord"]: r for r in m.enrich(df, state, FIELDS, now=F.lit(T0)).collect()}
    row = lambda k: tuple(got[k][c] for c in ("experience", "work_hours", "experience_domain", "evidence_strength", "profile_key", "enriched"))
    assert row(0) == ("경력 3년", "09:00~18:00", "clinical", "explicit", None, True)
    assert row(1) == ("신입", "own hours", "clinical", "title-context", None, True)
    assert row(2) == ("신입", "09:00~18:00", "clinical", "explicit", None, True)
    assert row(3) == (None, None, None, None, "k", False) == row(5) == row(6)
    assert row(4) == (None, "10:00", "nursing-general", None, None, True)  # clinical and health-manager contradict
    assert max(len([n for n in r["names"] if n[0] == "i"]) for r in m.limited(state).collect()) <= m.IDS_KEPT
    assert m.enrich(df, state.limit(0), FIELDS, now=F.lit(T0)).where("enriched").count() == 0


def test_names_of_one_row_alone_are_no_vertices(spark, monkeypatch):
    seen = []
    real = m.connected_components
    monkeypatch.setattr(m, "connected_components", lambda links: (seen.append(links.count()), real(links))[1])
    rows = [([f"a{i}"], [f"u{i // 3}"], dt.datetime(2026, 1, 1 + i), True, f"v{i}") for i in range(6)]
    d = spark.createDataFrame(rows, "ids array<string>, urls array<string>, checked_at timestamp, verified boolean, experience string").withColumns({c: F.lit(None).cast("string") for c in ("experience_domain", "evidence_field", "evidence", "strength")})
    got = {r["entry"]: (r["names"], r["f_experience"]["v"]) for r in m.merge_states(m.details_state(d, ["experience"])).collect()}
    assert got == {"ia0": (["ia0", "ia1", "ia2", "uu0"], "v2"), "ia3": (["ia3", "ia4", "ia5", "uu1"], "v5")} and seen == [4]
