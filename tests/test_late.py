"""Late notes as a stream: batches in any order and batches that come twice; files of untouched buckets stay."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from turnledger.operators import decide
from turnledger.operators import reconcile as fold
from turnledger.operators import search
from turnledger.streaming import late

CLAIM = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double"


def rows(df):
    return sorted(map(str, df.collect()))


def live(facts):
    return rows(fold.live(facts).select("subject", "key", "claim", "confidence", "session_id", "created_at"))


@pytest.fixture(scope="module")
def said():
    r = random.Random(6)
    return [(f"s{i // 2}", f"d{i // 2 % 7}", i % 2, f"x{r.randrange(9)}", "term", f"k{r.randrange(3)}", f"claim number {r.randrange(5)}", r.choice([0.6, 0.8, 0.9])) for i in range(60)]


def test_any_order_and_twice(spark, said, tmp_path):
    want = live(decide.derived(decide.Notes(spark.createDataFrame(said, CLAIM), spark.createDataFrame([], late._GONE))).facts)
    parts = [spark.createDataFrame([c for c in said if int(c[0][1:]) % 2 == k], CLAIM) for k in range(2)]
    for name, order in (("a", (0, 1)), ("b", (1, 0))):
        root = str(tmp_path / name)
        late.create(spark, root)
        for number in order:
            late.take_batch(spark, root, parts[number], f"t{number}")
        assert live(late.table(spark, root, "facts")) == want
        facts, claims = rows(late.table(spark, root, "facts")), rows(late.table(spark, root, "claims"))
        late.take_batch(spark, root, parts[order[-1]], "t9")
        assert rows(late.table(spark, root, "facts")) == facts and rows(late.table(spark, root, "claims")) == claims


def test_a_note_that_says_less(spark, said, tmp_path):
    root = str(tmp_path / "m")
    late.create(spark, root)
    late.take_batch(spark, root, spark.createDataFrame(said, CLAIM), "t0")
    before = {r.subject: r.seq for r in late.table(spark, root, "facts").groupBy("subject").agg(F.count("*").alias("seq")).collect()}
    files = {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{root}/facts/*/*.parquet")}
    again = [c for c in said if c[0] == "s3"][:1]
    late.take_batch(spark, root, spark.createDataFrame(again, CLAIM), "t1")
    now = [c for c in said if c[0] != "s3"] + again
    assert live(late.table(spark, root, "facts")) == live(decide.derived(decide.Notes(spark.createDataFrame(now, CLAIM), spark.createDataFrame([], late._GONE))).facts)
    after = {r.subject: r.seq for r in late.table(spark, root, "facts").groupBy("subject").agg(F.count("*").alias("seq")).collect()}
    assert all(after[s] >= n for s, n in before.items())  # no row disappears
    changed = {c[3] for c in said if c[0] == "s3"}
    which = {r.bucket for r in spark.createDataFrame([(s,) for s in changed], "subject string").select(late.bucket()).collect()}
    kept = {f: t for f, t in files.items() if int(f.split("bucket=")[1].split("/")[0]) not in which}
    assert kept and all(os.stat(f).st_mtime_ns == t for f, t in kept.items())
    assert late.table(spark, root, "claims").filter("session_id = 's3' AND NOT live").count() == 1


def test_a_title_outranks_prose(spark):
    docs = spark.createDataFrame([(1, "other words", "budget here", ""), (2, "budget here", "other words", ""), (3, "nothing", "at all here", "")], "doc_id int, title string, prose string, norm string")
    asked = spark.createDataFrame([(0, "budg")], "query_id int, query string")
    got = search.search_many(search.build_field_index(docs, {"title": 3, "prose": 1, "norm": 2}), asked).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [2, 1]
