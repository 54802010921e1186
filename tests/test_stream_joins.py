import datetime as dt

from pyspark.sql import functions as F

from postloom.operators import feed, select, userstate
from postloom.streaming import joins, jobs

BASE = dt.datetime(2026, 7, 1)
at = lambda h: BASE + dt.timedelta(hours=h)
day = lambda d: dt.date(2026, 7, d)


def write(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_alerts_of_a_replay_equal_the_batch_operator(spark, tmp_path):
    saves, posts, state, cp = (str(tmp_path / n) for n in ("saves", "posts", "state", "cp"))
    s_schema, p_schema = "user_id string, job_key string, saved_at timestamp", "job_key string, deadline_at date, seen_at timestamp"
    write(spark, saves, [("u", "a", at(1)), ("v", "a", at(2)), ("u", "never", at(2))], s_schema)
    write(spark, posts, [("a", day(9), at(0)), ("b", day(8), at(1))], p_schema)

    def run():
        both = joins.saved_deadlines(jobs.read_events(spark, saves, s_schema, files=1), jobs.read_events(spark, posts, p_schema, files=1), wait="48 hours")
        jobs.run_available(both, joins.alert_batches(state), cp)

    run()
    assert feed.read_published(spark, state).count() == 2
    write(spark, saves, [("u", "b", at(3)), ("w", "c", at(4))], s_schema)
    write(spark, posts, [("a", day(11), at(6)), ("c", day(10), at(5))], p_schema)
    run()
    notes = feed.read_published(spark, state)
    assert notes.groupBy("user_id", "job_key").count().where("count > 1").count() == 0  # one schedule notification a job
    saved = spark.read.schema(s_schema).parquet(saves)
    newest = spark.read.schema(p_schema).parquet(posts).groupBy("job_key").agg(F.max_by("deadline_at", "seen_at").alias("deadline_at"))
    for d in (7, 8, 9, 10, 11):
        today = F.lit(day(d))
        want = {tuple(r) for r in userstate.deadline_alerts(saved, newest, today=today).collect()}
        assert {tuple(r) for r in joins.alerts_of(notes, today=today).collect()} == want
        assert want or d not in (8, 10)
    before = feed.last_pointer(spark, state)
    run()
    assert feed.last_pointer(spark, state) == before


def test_saves_that_nothing_matches_come_out_with_nulls(spark, tmp_path):
    saves, posts = str(tmp_path / "saves"), str(tmp_path / "posts")
    s_schema, p_schema = "user_id string, job_key string, saved_at timestamp", "job_key string, deadline_at date, seen_at timestamp"
    out = []

    def run():
        both = joins.saved_deadlines(jobs.read_events(spark, saves, s_schema), jobs.read_events(spark, posts, p_schema), wait="2 hours", late="0 seconds")
        jobs.run_available(both, lambda b, n: out.extend(b.collect()), str(tmp_path / "cp"))

    write(spark, saves, [("u", "lost", at(1)), ("u", "a", at(1))], s_schema)
    write(spark, posts, [("a", day(9), at(2)), ("lost", day(9), at(9))], p_schema)  # the second is too late for the save
    run()
    write(spark, saves, [("clock", "x", at(20))], s_schema)
    write(spark, posts, [("y", day(1), at(20))], p_schema)
    run()
    got = {(r["user_id"], r["job_key"]): r["deadline_at"] for r in out}
    assert got["u", "a"] == day(9) and ("u", "lost") in got and got["u", "lost"] is None


def test_discovery_of_a_replay_equals_the_batch_operator(spark, tmp_path):
    src, out, cp = (str(tmp_path / n) for n in ("src", "out", "cp"))
    schema = "ord int, id string, job_key string, first_seen_at timestamp"
    rows = [(i, f"id{i}", f"k{i % 7}", at(i)) for i in range(20)]
    seen, applied = spark.createDataFrame([("id3",), ("k2",)], "id string"), spark.createDataFrame([("id5",)], "id string")
    each = joins.discovery_batches(out, lambda: seen, lambda: applied, since=F.lit(at(4)))
    for part in (rows[:8], rows[6:15], rows[15:] + rows[14:16]):
        write(spark, src, part, schema)
        jobs.run_available(joins.first_sights(jobs.read_events(spark, src, schema, files=1), late="10 days"), each, cp)
    want, _ = select.discover(spark.createDataFrame(rows, schema), "new", F.lit(at(4)), seen, applied)
    got = spark.read.parquet(out)
    assert sorted(r["ord"] for r in got.collect()) == sorted(r["ord"] for r in want.collect())
