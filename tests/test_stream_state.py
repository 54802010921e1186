import datetime as dt

import pytest
from pyspark.sql import functions as F

from postloom.operators import incremental, userstate
from postloom.streaming import jobs, state

BASE = dt.datetime(2026, 1, 1)
at = lambda s: BASE + dt.timedelta(seconds=s)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def runs(spark, tmp_path):
    """run(make) feeds what has arrived since the last call to make(stream) and gives the rows it puts out; the checkpoint stays."""

    def start(schema, make):
        src, cp = str(tmp_path / "src"), str(tmp_path / "cp")

        def run(rows):
            write(spark, src, rows, schema)
            out = []
            jobs.run_available(make(jobs.read_events(spark, src, schema, files=1)), lambda b, n: out.extend(b.collect()), cp)
            return out

        return run, cp

    return start


def test_admission_equals_batch_over_restarts_and_ends(spark, runs):
    schema = "id int, key string, at timestamp"
    run, cp = runs(schema, lambda s: state.admission_stream(s, key="key", at="at", limit=2, seconds=120, tie="id", late="1 second"))
    rows = [(i, "ab"[i % 2], at(17 * i)) for i in range(40)]
    out = run(rows[:13]) + run(rows[13:20]) + run(rows[20:])  # three starts from one checkpoint
    want = userstate.sliding_admission(spark.createDataFrame(rows, schema), key="key", at="at", limit=2, seconds=120, tie="id")
    assert {r["id"]: r["admitted"] for r in out} == {str(r["id"]): r["admitted"] for r in want.collect()}
    assert state.state_rows(spark, cp, "admitted") >= 2
    run([(100, "c", at(10_000))])
    run([(101, "d", at(20_000))])
    left = spark.read.format("statestore").option("stateVarName", "admitted").load(cp).select("key.key").distinct()
    assert {r[0] for r in left.collect()} <= {"c", "d"} and left.count() >= 1  # a and b went with their timers


def test_viewed_jobs_keep_the_newest(spark, runs):
    schema = "user_id string, job_id string, viewed_at timestamp"
    run, cp = runs(schema, lambda s: state.viewed_stream(s, keep=3))
    rows = [("u", f"j{i % 5}", at(10 * i)) for i in range(12)] + [("v", "x", at(5)), ("v", "x", at(1))]
    out = run(rows[:7]) + run(rows[7:])
    latest = {}
    for r in out:
        latest[r["user"], r["job"]] = max(r["viewed_at"], latest.get((r["user"], r["job"]), r["viewed_at"]))
    want = userstate.mark_viewed(spark.createDataFrame(rows, schema), newest=3)
    held = spark.read.format("statestore").option("stateVarName", "views").load(cp)
    assert held.count() == 4 == want.count()
    assert all(latest[r["user_id"], r["job_id"]] == r["viewed_at"] for r in want.collect())


def test_views_end_after_their_time_to_live(spark, tmp_path):
    schema = "user_id string, job_id string, viewed_at timestamp"
    src, cp, out = str(tmp_path / "src"), str(tmp_path / "cp"), []

    def run(rows):  # in processing time batches without data go on, so a run is stopped when its rows are through
        before = len(out)
        write(spark, src, rows, schema)
        stream = state.viewed_stream(jobs.read_events(spark, src, schema, files=1), days=1e-6)  # 86 ms
        q = stream.writeStream.foreachBatch(lambda b, n: out.extend(b.collect())).option("checkpointLocation", cp).start()
        for _ in range(300):
            if len(out) > before or not q.isActive:
                break
            q.awaitTermination(0.2)
        q.stop()
        return out[before:]

    assert len(run([("u", "a", at(5))])) == 1
    assert len(run([("u", "a", at(4))])) == 1  # the first is forgotten, so an older view is news again


def test_pages_fall_due_by_timer(spark, runs):
    schema = "url_key string, attempted_at timestamp, verified boolean"
    run, _ = runs(schema, lambda s: state.due_stream(s, forget=2))
    hour = 3600
    rows = [("a", at(0), True), ("b", at(0), False), ("c", at(0), True), ("c", at(5.8 * hour), False)]
    out = run(rows) + run([("clock", at(7 * hour), True)]) + run([("clock", at(7.1 * hour), True)])
    got = {}
    for r in sorted(out, key=lambda r: r["due_at"]):
        got.setdefault(r["key"], r["due_at"])  # b falls due again, as nobody fetches it
    assert {k: v for k, v in got.items() if k in "abc"} == {"a": at(6 * hour), "b": at(0.5 * hour), "c": at(6.3 * hour)}
    cache = spark.createDataFrame([("a", at(0), at(0)), ("b", None, at(0)), ("c", at(0), at(5.8 * hour))], "url_key string, checked_at timestamp, attempted_at timestamp")
    posts = spark.createDataFrame([("a",), ("b",), ("c",)], "url_key string")
    for hours in (0.4, 0.6, 5.9, 6.1, 6.2, 6.4):
        now = F.lit(at(hours * hour))
        batch = {r["url_key"] for r in incremental.due_details(posts, cache, now=now).collect()}
        assert batch == {k for k in "abc" if got[k] < at(hours * hour)}
    again = run([("clock", at(20 * hour), True)]) + run([("clock", at(20.1 * hour), True)])
    assert [r["due_at"] for r in again if r["key"] == "a"] == [at(12 * hour)]  # called once more, then forgotten
