import threading

from pyspark.sql import functions as F

from postloom.operators import feed as m


def table(spark, n, more=0):
    return spark.range(n).select(F.col("id"), (F.col("id") % 3 + more).alias("v"))


def first(df):
    return df.orderBy("id").limit(2)


def test_versions_only_go_up_and_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert m.read_published(spark, path) is None and m.read_page(spark, path, "first", first, day="d1") is None
    assert not m.publish(table(spark, 0), path, version=1, day="d1")
    assert m.publish(table(spark, 5), path, version=1, day="d1")
    assert not m.publish(table(spark, 7), path, version=1, day="d1") and not m.publish(table(spark, 5).orderBy(F.desc("id")), path, version=2, day="d1")
    assert m.read_published(spark, path, day="d1").where("not stale").count() == 5
    assert m.publish(table(spark, 5), path, version=2, day="d2") and not m.publish(table(spark, 9), path, version=1, day="d2")
    assert [p["version"] for p in m.pointers(spark, path)] == [2, 1]


def test_one_of_several_writers_wins(spark, tmp_path):
    path, won = str(tmp_path / "feed"), []
    go = threading.Barrier(4)

    def write(k):
        df = table(spark, 10 + k)
        go.wait()
        if m.publish(df, path, version=1, day="d"):
            won.append(10 + k)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and m.read_published(spark, path).count() == won[0]
    assert len(list((tmp_path / "feed" / "data").iterdir())) == 1 and len(list((tmp_path / "feed" / "versions").glob("[!.]*"))) == 1
    pointer = m.last_pointer(spark, path)
    assert not m._claim(spark, path, pointer | {"rows": 1}) and m.last_pointer(spark, path) == pointer


def test_damaged_versions_are_passed_over(spark, tmp_path):
    path = str(tmp_path / "feed")
    for k in (1, 2, 3):
        assert m.publish(table(spark, 5 + k), path, version=k, day="d")
    newest = m.last_pointer(spark, path)
    files = sorted((tmp_path / "feed" / newest["data"] / "rows").glob("part-*.parquet"))
    files[0].unlink()
    got = m.read_published(spark, path, day="d")
    assert got.count() == 7 and got.where("stale").count() == 7
    (tmp_path / "feed" / "versions" / f"{2:020d}.json").write_text('{"schema": 1, "ver')
    assert m.read_published(spark, path).count() == 6
    for f in (tmp_path / "feed" / newest["data"] / "rows").iterdir():
        f.unlink()
    assert m.read_published(spark, path).count() == 6


def test_default_pages_are_kept_by_day_and_profile(spark, tmp_path):
    path = str(tmp_path / "feed")
    assert m.publish(table(spark, 5), path, version=1, day="d1", profile="p1", pages={"first": first})
    page, kept = m.read_page(spark, path, "first", first, day="d1", profile="p1")
    assert kept and [r["id"] for r in page.orderBy("id").collect()] == [0, 1]
    for day, profile, name in (("d2", "p1", "first"), ("d1", "p2", "first"), ("d1", "p1", "other")):
        page, kept = m.read_page(spark, path, name, first, day=day, profile=profile)
        assert not kept and page.count() == 2
    pointer = m.last_pointer(spark, path)
    for f in (tmp_path / "feed" / pointer["data"] / "pages" / "first").glob("part-*"):
        f.unlink()
    page, kept = m.read_page(spark, path, "first", first, day="d1", profile="p1")
    assert not kept and page.count() == 2
    assert m.publish(table(spark, 5), path, version=2, day="d1", profile="p2", pages={"first": first})
