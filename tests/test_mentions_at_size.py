"""Mentions keep their document's language where the texts are read: no shuffle and no join."""


def test_mentions_stay_where_texts_are_read(spark):
    from spanframe.plans.pool_queries import mentions

    sf = "/root/testdata/sf0.001"
    out = mentions(spark, sf)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    docs = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    rows = out.select("doc_id", "lang").distinct().collect()
    assert rows and all(docs[r["doc_id"]] == r["lang"] for r in rows)
