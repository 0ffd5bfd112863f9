from codeweft.operators import search
from codeweft.plans import text_queries
from pyspark.sql import functions as F

TEXTS = {
    20: "budget warning in the snapshot writer", 40: "parse_tree nodes of the GraphBuilder, testing", 60: "of the and", 80: "x" * 70 + "y budgets", 1: "The budget of snapshot_writer warned; writers' budgets",
    2: "GraphBuilder builds parse_tree: nodes", 3: "nothing here", 4: "x" * 75 + "y", 5: "Snapshot snapshot SNAPSHOT", 6: "tests of a tree", 7: None,
}


def test_batch_equals_single_queries(spark, tmp_path):
    rows = [(i, "en", "test" if i % 2 else "budget", t) for i, t in TEXTS.items()]
    spark.createDataFrame(rows, "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    d = str(tmp_path)
    docs, regions = text_queries._documents(spark, d), text_queries._regions(spark, d)
    asked = text_queries._queries(spark, d)
    assert {r.query_id for r in asked.collect()} == {20, 40, 80}
    terms = asked.select("query_id", F.inline("terms"))
    scores = search.bm25_batch(regions, docs, terms).collect()
    sparse = search.bm25_batch(regions, docs, terms, sparse=True).collect()
    top = text_queries.bm25_batch_top(spark, d).collect()
    df = {r.term: (r.df, r.n_docs, r.idf) for r in text_queries.doc_frequency_batch(spark, d).collect()}
    assert {r.query_id for r in text_queries.sparse_batch_top(spark, d).collect()} == {20, 40, 80}
    for q in (20, 40, 80):
        query = search.build_query(TEXTS[q])
        for got, flag in ((scores, False), (sparse, True)):
            want = {r.region_id: (r.bm25, r.coverage, r.score) for r in search.bm25(regions, docs, query.table(spark), sparse=flag).collect()}
            assert {r.region_id: (r.bm25, r.coverage, r.score) for r in got if r.query_id == q} == want and want
        for r in search.document_frequency(docs, query.table(spark)).collect():
            assert df[r.term] == (r.df, r.n_docs, round(r.idf, 6))
        whole = search.bm25(regions, docs, query.table(spark)).join(regions.select("region_id", "path"), "region_id")
        total = F.col("score") + search.path_score(F.col("path"), query) + search.path_prior(F.col("path"), query)
        best = search.ranked(whole.select("region_id", "path", F.round(total, 4).alias("score")), "score", ["path", "region_id"], 10).collect()
        assert [(r.region_id, r.score, r["rank"]) for r in best] == [(r.region_id, r.score, r["rank"]) for r in sorted(top, key=lambda r: r["rank"]) if r.query_id == q]
