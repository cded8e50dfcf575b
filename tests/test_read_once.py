"""Work that a query does once, however many answers are drawn from it."""

from turnledger.plans import notes as plans
from turnledger.sources import notes as src

DATA = "/root/testdata/sf0.001"


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def test_notes_are_read_once(spark):
    assert scans(plans.s6_claims(spark, DATA)) == 1


def test_said_is_the_three_tables(spark):
    n = src.parse_notes(plans._notes(spark, DATA))
    three = [r for df in (src.claims(n), src.withdrawals(n), src.links(n).withColumnsRenamed({"a": "subject", "b": "key", "relation": "claim"})) for r in df.select("session_id", "date", "subject", "key", "claim").collect()]
    said = src.said(n)
    assert {r.kind for r in said.select("kind").distinct().collect()} == {"claim", "withdrawal", "link"}
    assert sorted(map(tuple, said.drop("kind").collect())) == sorted(map(tuple, three))


def test_search_shuffles_no_postings(spark):
    """Neither the postings nor the distinct terms of the corpus are written or joined: what is left after the hits has a row a word and document at most."""
    from turnledger.operators import search as ops
    from turnledger.plans import texts

    docs = spark.createDataFrame([(1, "ab abc abc x"), (2, "abcdef zz"), (3, None), (4, "q")], "doc_id long, text string")
    asked = spark.createDataFrame([(7, "abcd ab"), (8, "zz z"), (9, "")], "query_id long, query string")
    best = ops.search_many(ops.build_index(docs), asked)
    assert [(r.query_id, r.doc_id) for r in best.orderBy("query_id", "rank").collect()] == [(7, 2), (7, 1), (8, 2)]
    only = ops.search_many(ops.build_index(docs), asked, among=docs.filter("doc_id = 1").select("doc_id"))
    assert [(r.query_id, r.doc_id) for r in only.collect()] == [(7, 1)]
    index = ops.build_field_index(texts._docs(spark, DATA).withColumn("title", texts.F.split("text", "\n")[0]), {"title": 3.0, "text": 1.0})
    assert scans(index.words) <= 2  # once for texts with combining marks, once for the others; it was twice a field


def test_quarantine_reads_documents_once(spark):
    from turnledger.plans import texts

    assert scans(texts.p11_quarantine(spark, DATA)) == 1
