import datetime as dt

from pyspark.sql import functions as F

from postloom.operators import incremental, userstate
from postloom.streaming import jobs

SCHEMA = "id int, key string, at timestamp"


def write(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_state_over_runs(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    at = lambda h: dt.datetime(2026, 1, 1, h)
    fold = jobs.upsert_batches(lambda b, old: incremental.seen_state(b, old, keys=("key",), at="at"), state)
    write(spark, src, [(1, "a", at(3)), (2, "b", at(4))])
    jobs.run_available(jobs.read_events(spark, src, SCHEMA), fold, str(tmp_path / "cp"))
    write(spark, src, [(3, "a", at(1)), (4, "a", at(9))])
    jobs.run_available(jobs.read_events(spark, src, SCHEMA), fold, str(tmp_path / "cp"))
    got = {r["key"]: (r["first_seen_at"].hour, r["last_seen_at"].hour) for r in incremental.read_published(spark, state).collect()}
    assert got == {"a": (1, 9), "b": (4, 4)}


def test_windows(spark, tmp_path):
    src = str(tmp_path / "src")
    base = dt.datetime(2026, 1, 1)
    write(spark, src, [(i, "k", base + dt.timedelta(minutes=20 * i)) for i in range(9)])
    out = []
    jobs.run_available(jobs.windowed_counts(jobs.read_events(spark, src, SCHEMA), at="at", key="key"), lambda b, n: out.extend(b.collect()), str(tmp_path / "a"))
    assert {r["start"].hour: r["n"] for r in out if r["n"] == 3}.keys() <= {0, 1, 2}
    seen = []
    jobs.run_available(jobs.first_views(jobs.read_events(spark, src, SCHEMA), keys=["key"], at="at"), lambda b, n: seen.extend(b.collect()), str(tmp_path / "b"))
    assert len(seen) == 1


def test_admission_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "src")
    base = dt.datetime(2026, 1, 1)
    rows = [(i, "ab"[i % 2], base + dt.timedelta(seconds=17 * i)) for i in range(40)]
    write(spark, src, rows)
    out = []
    stream = jobs.admission_stream(jobs.read_events(spark, src, SCHEMA), key="key", at="at", limit=2, seconds=120, tie="id")
    jobs.run_available(stream, lambda b, n: out.extend(b.collect()), str(tmp_path / "cp"))
    want = userstate.sliding_admission(spark.createDataFrame(rows, SCHEMA), key="key", at="at", limit=2, seconds=120, tie="id")
    assert {r["id"]: r["admitted"] for r in out} == {str(r["id"]): r["admitted"] for r in want.select(F.col("id"), "admitted").collect()}
