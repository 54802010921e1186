import datetime as dt

from pyspark.sql import functions as F

from postloom.operators import rollover as m

D0 = dt.date(2026, 7, 1)


def rows(spark):
    day = lambda n: None if n is None else D0 + dt.timedelta(days=n)
    data = [(i, day((i * 7) % 50 - 5) if i % 4 else None, ["fixed", "always", "until-filled", None][i % 4], ["", "상시채용", "마감됨", None][i % 5 % 4], day(-((i * 5) % 35)) if i % 3 else None, dt.datetime(2026, 6, 1 + i % 28)) for i in range(200)]
    return spark.createDataFrame(data, "ord int, deadline_at date, deadline_kind string, deadline string, published_at date, first_seen_at timestamp")


def test_rolled_table_equals_a_full_run_on_30_days(spark, tmp_path):
    path, df = str(tmp_path / "t"), rows(spark).cache()
    cols = ["ord", "deadline_at", *m.DERIVED]
    m.start(df, path, D0)
    touched = []
    for n in range(1, 31):
        day = D0 + dt.timedelta(days=n)
        if n % 6 == 5:
            continue  # a day without a run
        touched.append(m.roll(spark, path, day))
        if n in (1, 2, 4, 6, 12, 13, 22, 30):
            got = {tuple(r) for r in m.read_day(spark, path, day).select(cols).collect()}
            assert got == {tuple(r) for r in m.derive(df, F.lit(day)).select(cols).collect()} and len(got) == 200
    assert m.roll(spark, path, day) == touched[-1]  # again, and nothing changes
    assert m.read_day(spark, path, day).count() == 200
    assert 0 < max(touched) < 100  # of 200 rows


def test_only_due_folders_are_read(spark, tmp_path):
    path = str(tmp_path / "t")
    m.start(rows(spark), path, D0)
    plan = m._rows(spark, path).where(F.col("due_month") <= m._month(D0))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(" in plan
    assert m.roll(spark, path, D0) == 0
