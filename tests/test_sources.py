import json
import time

from pyspark.sql import functions as F

from turnledger.operators import redact
from turnledger.sources import activity, jsonl
from turnledger.streaming import ingest

ID = "0a1b2c3d-0000-4000-8000-00000000000"


def write(path, *records):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in records))


def test_dialect_a(spark, tmp_path):
    me, other = ID + "1", ID + "2"
    write(
        tmp_path / "p" / f"{me}.jsonl",
        {"type": "user", "sessionId": me, "cwd": "/w", "timestamp": "2026-01-01", "message": {"role": "user", "content": "hello there"}},
        {"type": "assistant", "sessionId": me, "message": {"content": [{"type": "text", "text": "one"}, {"type": "thinking", "text": "no"}, {"type": "tool_use", "name": "Bash"}, {"type": "text", "text": "two"}]}},
        {"type": "user", "sessionId": other, "message": {"content": "copied"}},
        {"type": "user", "isSidechain": True, "message": {"content": "side"}},
        {"type": "summary"},
        '{"type": "user", "message": {"cont',
        "[1]",
    )
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert jsonl.rejects(lines).count() == 2
    turns = sorted(jsonl.parse_claude(jsonl.parsed(lines)).collect(), key=lambda r: r.line_ord)
    assert [(r.session_id, r.role, r.text, r.tools) for r in turns] == [(me, "user", "hello there", []), (me, "assistant", "one\ntwo", ["Bash"])]
    assert jsonl.sessions(jsonl.parse_claude(jsonl.parsed(lines))).collect()[0].cwd == "/w"


def test_dialect_b(spark, tmp_path):
    me = ID + "3"
    write(
        tmp_path / f"rollout-x-{me}.jsonl",
        {"type": "session_meta", "payload": {"id": "zz", "cwd": "/w"}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "<environment_context> x"}]}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": "{}"}},
        {"type": "event_msg", "payload": {"type": "task_complete"}},
        {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "done"}]},
    )
    turns = sorted(jsonl.parse_codex(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))).collect(), key=lambda r: r.line_ord)
    assert [(r.session_id, r.role, r.text, r.tools, r.cwd) for r in turns] == [(me, "user", "do it", [], "/w"), (me, "assistant", "", ["shell"], "/w"), (me, "assistant", "done", [], "/w")]


def test_dialect_c(spark, tmp_path):
    m = lambda i, t, kind, text: {"id": i, "timestamp": t, "type": kind, "content": text}
    write(tmp_path / "proj/chats/session-2026-ab.jsonl", {"sessionId": "ab"}, m("1", "t1", "user", "first"), {"$set": {"messages": [m("1", "t1", "user", "first, edited"), m("2", "t2", "gemini", "answer"), m("3", "t3", "info", "noise")]}}, m("4", "t4", "user", "first, edited"))
    turns = sorted(jsonl.parse_gemini(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))).collect(), key=lambda r: r.ts)
    assert [(r.role, r.text, r.ts) for r in turns] == [("user", "first, edited", "t1"), ("assistant", "answer", "t2")]


def records_of(spark, tmp_path, name, *records):
    write(tmp_path / name, *records)
    return jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))


def test_contents_to_any_depth(spark, tmp_path):
    call = {"type": "custom_tool_call", "name": "", "input": "*** Add File: n.py"}
    deep = [["a", [{"content": [{"content": ["b", {"type": "reasoning", "text": "no"}]}, {"type": "strange", "text": "c"}]}]], {"functionCall": {"name": "look", "args": {"path": " q "}}}, {"functionResponse": {}, "text": "no"}, call, {"type": "local_shell_call"}, "d", None, 7]
    got = jsonl.parse_claude(records_of(spark, tmp_path, "x.jsonl", {"type": "user", "sessionId": "s", "message": {"content": deep}}, {"type": "assistant", "sessionId": "s", "message": {"content": [{"type": "text", "text": " flat "}]}}))
    got = {r.role: (r.text, r.tools) for r in got.collect()}
    assert got == {"user": ("a\nb\nc\nd", ["look", "tool", "shell"]), "assistant": ("flat", [])}
    assert [r.files for r in jsonl.touched_files(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))).collect()] == [["q", "n.py"]]


def test_discover_without_roots(spark):
    assert jsonl.discover(spark, {}).count() == 0 and jsonl.discover(spark, {"claude": []}).columns == ["agent", "path", "size", "mtime"]


def test_names_decide_sessions(spark, tmp_path):
    one = {"id": "1", "timestamp": "t", "type": "user", "content": [" words ", {"text": "more"}]}
    nudge = {"id": "2", "timestamp": "u", "type": "user", "content": "[System: please go on]"}
    write(tmp_path / "chats/session-2026-0a1b2c3d.jsonl", {"sessionId": "0A1B2C3D-full"}, one, nudge)
    write(tmp_path / "chats/session-2026-ffffffff.jsonl", {"sessionId": "0A1B2C3D-full"}, one)
    got = {(r.session_id, r.text) for r in jsonl.parse_gemini(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path)))).collect()}
    assert got == {("0A1B2C3D-full", "words \nmore"), ("session-2026-ffffffff", "words \nmore")}


def test_activity(spark, tmp_path):
    t = lambda s: f"2026-01-01T00:00:{s:02}Z"
    said = lambda role, content, s=None, **more: {"type": role, "message": {"content": content, **more}} | ({"timestamp": t(s)} if s is not None else {})
    a = {
        "asks": [said("user", "q", 1), said("assistant", [{"type": "tool_use"}], 2), {"type": "summary", "timestamp": t(3)}],
        "stop": [said("assistant", "x", 1, stop_reason="tool_use")],
        "ended": [said("user", "q", 1), said("assistant", "done", 2)],
        "prompt": [said("assistant", "done", 1), said("user", [{"type": "tool_result"}], 2), {"type": "user", "isSidechain": True, "message": {"content": "side"}, "timestamp": t(9)}],
        "broken-off": [said("user", " [Request interrupted by user for tool use]", 4)],
        "command": [said("user", "<local-command-stdout>ok", 4)],
        "late": [said("user", "q", 1), said("assistant", "unstamped")],
        "none": [{"type": "summary", "timestamp": t(5)}],
    }
    for name, rows in a.items():
        write(tmp_path / "a" / f"{name}.jsonl", *rows)
    name_of = lambda r: r.path.rsplit("/", 1)[1][:-6]
    got = {name_of(r): (r.at.second, r.busy) for r in activity.activity(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path / "a"))), "claude").collect()}
    assert got == {"asks": (3, True), "stop": (1, True), "ended": (2, False), "prompt": (9, True), "broken-off": (4, False), "command": (4, False), "none": (5, False)}
    event = lambda kind, s: {"type": "event_msg", "timestamp": t(s), "payload": {"type": kind}}
    write(tmp_path / "b/x.jsonl", event("task_started", 1), event("task_complete", 2), event("task_started", 3), event("thread_settings_applied", 4))
    write(tmp_path / "b/y.jsonl", event("task_started", 1), event("turn_aborted", 2), {"type": "response_item", "timestamp": t(7)})
    got = {name_of(r): (r.at.second, r.busy) for r in activity.activity(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path / "b"))), "codex").collect()}
    assert got == {"x": (4, True), "y": (7, False)}
    m = lambda kind, content, s, **more: {"type": kind, "timestamp": t(s), "content": content, **more}
    c = {
        "user": [m("gemini", "hi", 1), m("user", "q", 2)], "calls": [m("gemini", "let me", 1, toolCalls=[{}])], "words": [m("user", "q", 1), m("gemini", [["said"]], 2, toolCalls=[]), m("info", "x", 3)],
        "silent": [m("gemini", "", 1)], "error": [m("user", "q", 1), m("error", "e", 2)], "set": [m("user", "q", 1), {"$set": {"lastUpdated": t(8), "messages": [m("user", "q", 1), m("gemini", "a", 2)]}}],
    }
    for name, rows in c.items():
        write(tmp_path / "c" / f"{name}.jsonl", *rows)
    got = {name_of(r): (r.at.second, r.busy) for r in activity.activity(jsonl.parsed(jsonl.read_lines(spark, str(tmp_path / "c"))), "gemini").collect()}
    assert got == {"user": (2, True), "calls": (1, True), "words": (3, False), "silent": (1, True), "error": (2, False), "set": (8, False)}


def test_sessions_close_by_the_clock(spark, tmp_path):
    """No record comes after the first ones: silence alone closes what no running turn holds open."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = [("quiet", 1, False), ("quiet", 2, None), ("busy", 1, True), ("answered", 1, True), ("answered", 2, False)]
    marks = spark.createDataFrame(rows, "path string, n long, busy boolean").select("path", F.struct(F.lit(0).cast("long").alias("block"), F.col("n").alias("line")).alias("line_ord"), F.current_timestamp().alias("at"), "busy")
    marks.coalesce(1).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema(marks.schema).parquet(str(tmp_path / "in"))
    query = ingest.close_sessions_by_clock(stream, 1_000, 3_600_000).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "ck")).trigger(processingTime="1 second").start()
    until = time.time() + 90
    while len(seen) < 2 and time.time() < until:
        time.sleep(0.5)
    query.stop()
    assert {(r.session_id, r.records) for r in seen} == {("quiet", 2), ("answered", 2)}


def test_stream_reads_what_batch_reads(spark, tmp_path):
    write(tmp_path / "in" / f"{ID}5.jsonl", {"type": "user", "message": {"content": "hi you"}}, "broken")
    seen = []
    query = ingest.start_ingest(ingest.ingest_stream(spark, str(tmp_path / "in")), lambda df, _: seen.extend(r.text for r in jsonl.parse_claude(df).collect()), str(tmp_path / "ck"), None)
    query.awaitTermination(60)
    assert seen == ["hi you"]


def test_redaction(spark):
    half = "AKIA" + "ABCDEFGH12345678"
    rows = [(1, f"é{half} and 123456789 here"), (2, "API_KEY=" + "x" * 10), (3, "plain words"), (4, None), (5, "see 123456789. Then 1.123456789")]
    out = {r.i: r for r in redact.redact(spark.createDataFrame(rows, "i int, text string")).collect()}
    assert out[1].text == "é[REDACTED-AWS-KEY] and [REDACTED-ID] here" and [f.kind for f in out[1].findings] == ["aws-access-key", "national-id"]
    assert out[2].text == "API_KEY=[REDACTED-SECRET]" and out[3].text == "plain words" and out[4].text is None
    assert out[5].text == "see [REDACTED-ID]. Then 1.123456789" and all(r.safe for r in out.values())
