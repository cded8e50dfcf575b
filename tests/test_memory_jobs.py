"""Jobs over memory that tables of the driver cannot show: nested notes, late data in any order, files that grew, closing streams."""

import json
import random
import time

from pyspark.sql import functions as F

from turnledger.operators import audit, decide, facts, redact, search
from turnledger.operators import reconcile as fold
from turnledger.sources import jsonl, notes
from turnledger.streaming import ingest

CLAIM = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double"
GONE = CLAIM + ", created_at string, retracted_at string, reason string"


def table(rows):
    return sorted(map(str, rows.drop("seq", "superseded_by").collect()))


def test_late_data_in_any_order(spark):
    rng = random.Random(4)
    said = [(f"s{i}", f"d{rng.randrange(6)}", 0, f"x{rng.randrange(3)}", "term", f"k{rng.randrange(3)}", f"claim number {rng.randrange(5)}", rng.choice([0.6, 0.8, 0.9, 1.0])) for i in range(40)]
    gone = [(f"s{i}", f"d{i % 6}", 0, f"x{i % 3}", "term", f"k{i % 3}", f"claim number {i % 5}", 0.9, f"d{i % 6}", f"d{i % 6}", "r") for i in range(0, 40, 5)]
    every = decide.Notes(spark.createDataFrame(said, CLAIM), spark.createDataFrame(gone, GONE))
    want = table(fold.live(decide.derived(every).facts))
    order = list(range(3))
    rng.shuffle(order)
    known, held = [], None
    for part in order:
        new = [r for i, r in enumerate(said) if i % 3 == part]
        known += new
        arrived = {r[0] for r in known}
        now = decide.Notes(spark.createDataFrame(known, CLAIM), every.withdrawals.filter(F.col("session_id").isin(*arrived)))
        touched = spark.createDataFrame(sorted({(r[3],) for r in new} | {(g[3],) for g in gone if g[0] in arrived}), "subject string")
        held = decide.derived(now).facts if held is None else decide.rebase(held, now, touched, "d9")
    assert table(fold.live(held)) == want


def test_nested_scrub_and_quarantine(spark):
    key = "AKIA" + "ABCDEFGH12345678"
    note = spark.createDataFrame([(1, {"title": f"a {key}", "items": [{"what": f"{key} b", "why": None}]}, [f"{key}"])], "i int, note struct<title:string,items:array<struct<what:string,why:string>>>, did array<string>")
    r = redact.scrub(note).first()
    assert r.note.title == "a [REDACTED-AWS-KEY]" and r.note["items"][0].what == "[REDACTED-AWS-KEY] b" and r.note["items"][0].why is None and r.did == ["[REDACTED-AWS-KEY]"] and r.i == 1
    rows = spark.createDataFrame([(1, f"{key} and 4041 8949 7460 8795"), (2, "fine")], "i int, text string")
    safe, unsafe = redact.split_quarantine(redact.redact(rows, rules=redact.RULES[-1:], verify=redact.RULES))
    assert [x.i for x in safe.collect()] == [2] and [x.reason for x in unsafe.collect()] == ["credit-card×1, survived:aws-access-key"]


def test_touched_files(spark, tmp_path):
    patch = "*** Begin Patch\n*** Update File: src/a.py\n@@\n*** Add File: src/b.py\n"
    records = [
        {"type": "assistant", "message": {"content": [{"type": "tool_use", "name": "Edit", "input": {"file_path": " /w/x.py ", "new_string": "path: no"}}, {"type": "tool_use", "name": "Read", "input": {"path": "/w/y.py", "filePath": "/w/x.py"}}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"path": "z.txt"})}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": patch}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "patch", "arguments": json.dumps({"patch": patch})}},
        {"type": "user", "message": {"content": "path"}},
    ]
    (tmp_path / "a.jsonl").write_text("\n".join(map(json.dumps, records)))
    got = sorted(jsonl.touched_files(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))).collect(), key=lambda r: r.line_ord)
    assert [r.files for r in got] == [["/w/x.py", "/w/y.py"], ["z.txt"], ["src/a.py", "src/b.py"], ["src/a.py", "src/b.py"]]


def test_replies(spark):
    rows = [(1, 'x {"title": "a } b", "facts": "none"} {y}'), (2, '{"a": "\\"}"} tail }'), (3, "{ never closed"), (4, None), (5, '{"facts": [{"subject": " s ", "key": "k", "claim": true, "confidence": "0.5", "subjectKind": "planet"}], "open": [null]}')]
    done, dropped = notes.parse_replies(spark.createDataFrame(rows, "session_id int, reply string"))
    got = {r.session_id: r for r in done.collect()}
    assert [got[i].status for i in (1, 2, 3, 4, 5)] == ["ok", "ok", "unreadable", "no-json", "ok"]
    assert got[1].title == "a } b" and got[2].title == notes.UNTITLED and got[1].facts == []
    assert [tuple(f) for f in got[5].facts] == [("s", "term", "k", "true", 0.5)] and {(r.session_id, r.field) for r in dropped.collect()} == {(5, "open")}


def test_files_that_grew(spark, tmp_path):
    one = {"type": "user", "message": {"content": "hi"}}
    for name in ("a", "b", "agent-c"):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps(one))
    roots = {"claude": [str(tmp_path)]}
    empty = spark.createDataFrame([], "path string, fingerprint string, status string, min_user_chars int")
    taken, records = ingest.ingest_changed(spark, roots, empty)
    assert taken.count() == 2 == records.count()
    ledger = taken.select("path", "fingerprint", F.lit("ok").alias("status"), F.lit(200).alias("min_user_chars"))
    time.sleep(1.1)
    (tmp_path / "b.jsonl").write_text(json.dumps(one) + "\n" + json.dumps(one))
    again, records = ingest.ingest_changed(spark, roots, ledger)
    assert [r.verdict for r in again.collect()] == ["changed"] and records.count() == 2
    done = again.select("path", "fingerprint", F.lit("ok").alias("status"), F.lit(200).alias("min_user_chars")).unionByName(ledger.join(again.select("path"), "path", "left_anti"))
    assert ingest.ingest_changed(spark, roots, done)[1].count() == 0
    assert ingest.ingest_file(spark, str(tmp_path / "a.jsonl")).count() == 1


def test_sessions_close_in_a_stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    at = lambda s: f"2026-01-01 {s}"
    parts = [[("a", at("00:00:00"), False), ("b", at("00:00:00"), True)], [("a", at("00:01:00"), False), ("b", at("05:00:00"), False)], [("c", at("12:00:00"), False)], [("c", at("12:00:01"), False)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, "session_id string, t string, busy boolean").select("session_id", F.to_timestamp("t").alias("ts"), "busy").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        time.sleep(0.2)
    stream = spark.readStream.schema("session_id string, ts timestamp, busy boolean").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")).withWatermark("ts", "0 seconds")
    closed = ingest.close_sessions_stream(stream)
    seen = []
    query = closed.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = {r.session_id: (r.busy, r.records) for r in seen}
    # a's second record deletes its first timer; b was busy, so five hours of silence did not close it
    assert got["a"] == (False, 2) and got["b"] == (False, 2)


def test_named_questions(spark):
    subjects = spark.createDataFrame([("Acme",), ("Acme Server",), ("Other",)], "subject string")
    asked = spark.createDataFrame([("acme",), ("Other",), ("the other one",)], "name string")
    assert {tuple(r) for r in facts.near_names(subjects, asked).collect()} == {("acme", "Acme"), ("acme", "Acme Server"), ("the other one", "Other")}
    rng = random.Random(3)
    words = ["".join(rng.choice("abC") for _ in range(rng.randrange(7))) for _ in range(120)]
    some, others = words[:60], words[60:]
    want = {(n, s) for n in set(others) - set(some) for s in set(some) if n and s and (n.lower() in s.lower() or s.lower() in n.lower())}
    got = facts.near_names(spark.createDataFrame([(w,) for w in some], "subject string"), spark.createDataFrame([(w,) for w in others], "name string"))
    assert {tuple(r) for r in got.collect()} == want


def test_letters_and_accents_are_one(spark):
    """e with an accent of its own and the one letter for both are the same to search, near keys and the queue."""
    one, two = "caf\u00e9 noir", "cafe\u0301 noir"
    docs = spark.createDataFrame([(1, one), (2, two), (3, "cafe noir")], "doc_id int, text string")
    terms = {(r.doc_id, r.term) for r in search.build_index(docs).postings.collect()}
    assert {t for d, t in terms if d in (1, 2)} == {"caf\u00e9", "noir"} and (3, "cafe") in terms
    got = search.search_many(search.build_index(docs), spark.createDataFrame([(0, two.split()[0])], "query_id int, query string")).collect()
    assert {r.doc_id for r in got} == {1, 2}
    slot = ("s", "x", "k", "term")
    schema = "session_id string, subject string, key string, subject_kind string, claim string, confidence double, reason string, created_at string"
    settled = decide.settle_queue(spark.createDataFrame([(*slot, two, 0.7, "w", "d")], schema), spark.createDataFrame([(*slot, one, 0.7, "w", "d", "rejected")], schema + ", status string"))
    assert [(r.claim, r.status) for r in settled.collect()] == [(one, "rejected")]


def test_near_keys_against_all_pairs(spark):
    rng = random.Random(8)
    words = [f"word{i}" for i in range(14)]
    rows = [("s", "term", rng.choice(("a", "b")) + "." + "-".join(rng.sample(words[:6], rng.randrange(1, 3))), " ".join(rng.sample(words, rng.randrange(3, 9))), 0.9, f"s{i}", i, "d", None, None) for i in range(60)]
    held = {}
    for r in rows:
        held[r[2]] = r[3]
    want = {}
    for k in held:
        for o in held:
            if k < o:
                (p, x), (q, y) = ((n.split(".")[0], set(n.split(".")[1].split("-"))) for n in (k, o))
                both = len(set(held[k].split()) & set(held[o].split()))
                if p == q and x != y and (x <= y or y <= x):
                    want[k, o] = "key-subset"
                elif p != q and x == y:
                    want[k, o] = "key-same-noun"
                elif both >= 4 and 3 * both >= min(len(held[k].split()), len(held[o].split())):
                    want[k, o] = "claim-overlap"
    table_ = spark.createDataFrame(rows, "subject string, subject_kind string, key string, claim string, confidence double, session_id string, seq long, created_at string, superseded_at string, retracted_at string")
    assert {(r.key, r.other): r.why for r in audit.near_keys(table_).collect()} == want


def test_as_of_against_plain_filter(spark):
    rng = random.Random(2)
    said = [(f"s{i}", f"d{rng.randrange(20):02}", 0, f"x{rng.randrange(2)}", "term", f"k{rng.randrange(3)}", f"claim number {rng.randrange(9)}", 0.9) for i in range(50)]
    gone = [(f"s{i}", f"d{i % 20:02}", 0, f"x{i % 2}", "term", f"k{i % 3}", f"claim number {i % 9}", 0.9, f"d{i % 20:02}", f"d{i % 20:02}", "r") for i in range(0, 50, 4)]
    out = fold.replay(fold.events(spark.createDataFrame(said, CLAIM), spark.createDataFrame(gone, GONE).drop("reason"))).facts
    probes = [(f"x{i % 2}", f"d{i:02}", i) for i in range(21)]
    want = set()
    for s, d, i in probes:
        for f in out.collect():
            closed = min((c for c in (f.superseded_at, f.retracted_at) if c), default=None)
            if f.subject == s and f.created_at < d and (closed is None or closed >= d):
                want.add((i, f.seq))
    got = fold.facts_as_of(out, spark.createDataFrame(probes, "subject string, date string, i int")).collect()
    assert {(r.i, r.seq) for r in got} == want
