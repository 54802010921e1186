import json

from postloom.llm import queries


def test_pipeline_on_small_tables(spark, tmp_path):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "near_dedup", "decontaminate", "mix", "encode"]
    columns, ids = docs.columns, {r["doc_id"] for r in docs.select("doc_id").collect()}
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        docs = stage(spark, docs, sf)
        docs.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.columns == columns
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.5 * len(ids)
        ids = left
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_near_dedup_drops_what_fingerprints_link_and_what_they_miss(spark):
    import corpus_pipeline
    from postloom.llm import jaccard, simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    left = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    both, by_bits, by_sets = left(corpus_pipeline.near_dedup(spark, docs, "")), left(simhash.drop_near_duplicates(docs)), left(jaccard.drop_near_duplicates(docs))
    assert both <= by_bits & by_sets and by_bits - by_sets
    text = " ".join(f"word{i}" for i in range(60))
    far = " ".join(f"other{i}" for i in range(60))
    chain = spark.createDataFrame([(1, text), (2, far), (3, far)], "doc_id long, text string")
    assert left(jaccard.drop_near_duplicates(chain, also=spark.createDataFrame([(1, 3)], "l long, r long"))) == {1}


def test_each_operator_has_one_query():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == ["op1_toxicity", "op2_mtree", "op3_language", "op4_pii", "op5_mixing", "op6_token_files", "op7_token_counts", "op8_simhash", "op9_html_text", "op10_decontamination", "op11_prefix_trie", "op12_filter_audit", "op13_metric_join"]
    assert json.dumps(queries.ORACLE_SQL)
