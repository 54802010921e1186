import duckdb
import pytest
from pyspark.sql import functions as F

from postloom.llm import mixing as m


def plain_targets(sizes, share=1.5, cap=2.0):
    """Reshare what is over, again and again."""
    w = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, out, open_ = share * sum(sizes.values()), {}, set(sizes)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > cap * sizes[s]}
        if not over:
            return out | {s: left * w[s] / total for s in open_}
        for s in over:
            out[s] = cap * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_targets_fill_to_a_level(spark):
    sizes = {"a": 1000, "b": 10, "c": 500, "d": 40, None: 300, "ä": 77}
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    got = {r["source"]: r["target"] for r in m.source_targets(df, "source").collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_taken_words_and_sql(spark, tmp_path):
    rows = [(i, "w " * (1 + i * 7 % 50), "abcd"[i % 4] if i % 9 else None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = m.mixture_copies(df).toPandas()
    assert (got.taken <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 2 * g["size"].max()
    df.write.parquet(str(tmp_path / "d"))
    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/d/*.parquet')")
    want = c.sql(m.ORACLE).df().sort_values("doc_id").reset_index(drop=True)
    assert (got.sort_values("doc_id").reset_index(drop=True)[list(want)] == want).all().all()


def test_mixture_repeats_rows(odd_docs, no_docs):
    mixed = m.mix_documents(odd_docs)
    copies = m.mixture_copies(odd_docs).agg(F.sum("copies")).first()[0]
    assert mixed.columns == odd_docs.columns and mixed.count() == copies
    assert sorted(map(str, m.mix_documents(odd_docs).collect())) == sorted(map(str, mixed.collect()))
    assert {r["size"] for r in mixed.collect()} == {7}
    assert m.mixture_copies(no_docs).count() == 0 == m.mix_documents(no_docs).count()


def test_any_column_names_and_repeated_rows(spark):
    names = ("_source", "_part", "_base", "_copy", "part", "before", "copies", "id", "hash", "row", "rows", "copy", "turn")
    rows = [(i % 40 if i % 5 else None, "w " * (1 + i % 3), "ab"[i % 2]) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in names})
    mixed, copies = m.mix_documents(df), m.mixture_copies(df)
    assert mixed.columns == df.columns
    got = {tuple(r): n for *r, n in mixed.groupBy("doc_id", "source").count().collect()}
    want = {tuple(r): n for *r, n in copies.groupBy("doc_id", "source").agg(F.sum("copies")).where("`sum(copies)` > 0").collect()}
    assert got == want and {tuple(r) for r in mixed.select(*names).distinct().collect()} == {(7,) * len(names)}
    assert sorted(map(str, m.mix_documents(df).collect())) == sorted(map(str, mixed.collect()))
