import random

import pytest
from pyspark.sql import functions as F

from postloom.operators import applications as m
from postloom.operators import userstate

SCHEMA = "user_id string, job_key string, updated_at int, seq int, action string, status string, final_result string, note string, due_at string"


def replay(rows):
    """Sequential version: flags by seq, and what is left of each application."""
    live, flags = {}, {}
    for user, job, at, seq, action, status, result, note, due in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2], r[3])):
        now = live.get((user, job))
        if action == "remove":
            live.pop((user, job), None)
            flags[seq] = (True, None, None)
            continue
        then = {"result": "final"}.get(status, status) if status is not None else now["status"] if now else "interested"
        asked = (now["final_result"] if now else None) if result is None else {"expired": "closed"}.get(result, result) or None
        if then not in m.STATUSES or (asked is not None and asked not in m.RESULTS) or (asked and then != "final"):
            flags[seq] = (False, now and now["status"], now and now["final_result"])
            continue
        new = dict(now or {"created_at": at, "note": None, "due_at": None}, status=then, final_result=asked, updated_at=at)
        for c, v in (("note", note), ("due_at", due)):
            new[c] = new[c] if v is None else v or None
        live[user, job] = new
        flags[seq] = (True, then, asked)
    return flags, live


def log(rng, n, hot):
    pick = lambda *v: rng.choice(v)
    return [
        (pick("u", "v", None), "hot" if rng.random() < hot else pick("j", "k"), rng.randrange(n), i, pick(*[None] * 12, "remove"), pick(None, *m.STATUSES, "final", "result", "nonsense"), pick(None, None, "", *m.RESULTS, "expired", "offer"), pick(None, "", "a", "b"), pick(None, "2026-07-14"))
        for i in range(n)
    ]


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_log_equals_sequential_fold(spark, hot):
    rows = log(random.Random(int(hot * 10)), 500, hot)
    df = spark.createDataFrame(rows, SCHEMA)
    flags, live = replay(rows)
    got = {r["seq"]: (r["accepted"], r["status_after"], r["result_after"]) for r in m.application_log(df).collect()}
    assert got == flags and len({f[0] for f in flags.values()}) == 2
    state = {(r["user_id"], r["job_key"]): r for r in m.application_state(df).collect()}
    assert set(state) == set(live)
    assert all({k: state[at][k] for k in v} == v for at, v in live.items())


def test_result_of_an_earlier_final_status_does_not_return(spark):
    rows = [("u", "j", 1, 1, None, "final", "accepted", None, None), ("u", "j", 2, 2, None, "interview", None, None, None), ("u", "j", 3, 3, None, "interview", "", None, None), ("u", "j", 4, 4, None, "final", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r["accepted"] for r in m.application_log(df).orderBy("seq").collect()] == [True, False, True, True]
    assert m.application_state(df).select("status", "final_result").first() == ("final", None)
    assert m.application_state(df.limit(0)).count() == 0


def test_one_schedule_notification_a_job(spark):
    schema = "id string, type string, user_id string, job_key string, scheduled_at string, title string, created_at string, read_at string"
    old = spark.createDataFrame([("a", "schedule", "u", "j", "14", "first", "01", "02"), ("d", "deadline", "u", "j", "13", "due", "01", None), ("b", "schedule", "u", "k", "14", "other", "01", "03")], schema)
    new = spark.createDataFrame([("c", "schedule", "u", "j", "15", "moved", "05", None), ("b", "schedule", "u", "k", "16", "again", "06", None)], schema)
    got = {r["id"]: r for r in userstate.upsert_notifications(old, new).collect()}
    assert set(got) == {"b", "c", "d"} and got["c"]["read_at"] is None
    assert (got["b"]["title"], got["b"]["created_at"], got["b"]["read_at"]) == ("again", "01", "03")
    back = spark.createDataFrame([("x", "schedule", "u", "j", "17", "back", "07", None), ("c", "schedule", "u", "j", "18", "c again", "08", None)], schema)
    twice = {r["id"]: r for r in userstate.upsert_notifications(userstate.upsert_notifications(old, new).select(*old.columns), back).collect()}
    assert set(twice) == {"b", "c", "d"} and twice["c"]["created_at"] == "08"  # c was replaced by x in between
    counts = userstate.user_counts(old.select("user_id", "job_key"), old.where("id = 'd'").select("user_id", "job_key"), old).first()
    assert (counts["saved"], counts["hidden"], counts["unread"]) == (2, 1, 1)
    assert userstate.unread_count(old).first()["unread"] == 1


def test_next_steps(spark):
    df = spark.createDataFrame([("interview", "2026-07-12", "2026-07-10", None), ("preparing", None, "2026-07-10", None), ("applied", None, None, "2026-07-01"), ("final", None, None, None)], "status string, interview string, due string, applied string")
    day = lambda c: F.to_date(c)
    got = df.select(userstate.next_status(F.col("status")).alias("n"), userstate.application_schedule(day("due"), day("interview"), day("applied"), F.col("status"), F.to_date(F.lit("2026-07-12"))).alias("s")).collect()
    assert [r["n"] for r in got] == ["final", "applied", "interview", None]
    assert [(r["s"]["kind"], r["s"]["timing"]) for r in got] == [("interview", "today"), ("due", "overdue"), ("applied", "overdue"), (None, None)]
