"""What the pipeline's filters pass through Python: each text once, and next to nothing back."""

from pyspark.sql import functions as F

from turnledger.llm import decontamination, exact_dedup, ngram_join, quality

WORDS = 400
PASSAGE = " ".join(f"bench{j}" for j in range(12))


def documents(spark):
    """Texts of some 4 kB, and every tenth twice; every seventh holds the passage."""
    word = F.concat(F.lit("w"), (F.col("id") % 450).cast("string"), F.lit("x"))
    body = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(WORDS)), lambda j: F.concat(word, j.cast("string"))), " ")
    text = F.when(F.col("id") % 7 == 0, F.concat(body, F.lit(" " + PASSAGE))).otherwise(body)
    return spark.range(0, 500, 1, 2).select(F.col("id").alias("doc_id"), text.alias("text"), F.lit("kept").alias("note"))


def moved(spark, frame):
    """Bytes sent to Python and back while the frame is run, and its rows."""
    rows = frame.collect()

    def below(node):
        if node.nodeName() == "AdaptiveSparkPlan":
            yield from below(node.executedPlan())
            return
        if "QueryStage" in node.nodeName():
            yield from below(node.plan())
            return
        yield node
        children = node.children()
        for i in range(children.size()):
            yield from below(children.apply(i))

    sent = {"pythonDataSent": 0, "pythonDataReceived": 0}
    for node in below(frame._jdf.queryExecution().executedPlan()):
        for name in sent:
            metric = node.metrics().get(name)
            if metric.isDefined():
                sent[name] += metric.get().value()
    return *sent.values(), rows


def size(docs):
    return docs.agg(F.sum(F.length("text"))).first()[0]


def test_decontamination_sends_each_text_once(spark):
    docs = documents(spark)
    items = spark.createDataFrame([("i", PASSAGE)], "item_id string, text string")
    sent, back, rows = moved(spark, decontamination.decontaminated(docs, items))
    assert sorted(r["doc_id"] for r in rows) == [i for i in range(500) if i % 7]
    assert all(r["note"] == "kept" and r["text"] for r in rows)
    assert size(docs) <= sent < 1.2 * size(docs) and 0 < back < 0.05 * size(docs)


def test_blocks_of_windows_keep_columns(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WINDOWS", 1)
    docs = documents(spark)
    items = spark.createDataFrame([("i", PASSAGE), ("j", " ".join(f"w5x{j}" for j in range(1, 11)))], "item_id string, text string")
    left = decontamination.decontaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [i for i in range(500) if i % 7 and i % 450 != 5]


def test_quality_sends_each_text_once(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    sent, back, rows = moved(spark, quality.good_documents(docs, labels))
    predicted = quality.quality_scores(docs, labels).filter("predicted = 1").collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in predicted)
    assert size(docs) <= sent < 1.2 * size(docs) and 0 < back < 0.05 * size(docs)


def test_dedup_stages_send_hashes_only(spark):
    docs = documents(spark)
    sent, back, rows = moved(spark, exact_dedup.exact_dedup(docs))
    first = {}
    for r in docs.collect():
        first.setdefault(r["text"], r["doc_id"])
    assert sorted(r["doc_id"] for r in rows) == sorted(first.values())
    assert 0 < sent < 0.1 * size(docs) and 0 < back < 0.1 * size(docs)
    sent, back, rows = moved(spark, ngram_join.one_of_each(docs))
    assert len(rows) == 450 and all(r["note"] == "kept" for r in rows)
    assert 0 < sent < 0.1 * size(docs) and 0 < back < 0.1 * size(docs)
