"""Conversations written as transcript lines of each dialect, read back through the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import activity, jsonl

START = 1_767_225_600  # 2026-01-01


def _turns(spark, sf_dir):
    """conv_id, turn, role, and what lines are made of: q, the text as a JSON string; at, a stamp that grows with the turn."""
    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    listed = F.to_json(F.array(F.coalesce("text", F.lit(""))))
    stamp = F.date_format(F.timestamp_seconds(F.col("turn") + START), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return t.select("conv_id", "turn", "role", F.substr(listed, F.lit(2), F.length(listed) - 2).alias("q"), stamp.alias("at"))


def _records(lines, path):
    """lines: conv_id, turn, part, value."""
    return jsonl.parsed(lines.select("value", path.alias("path"), F.struct(F.col("turn").alias("block"), F.col("part").cast("long").alias("line")).alias("line_ord")))


def _line(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _claude(spark, sf_dir):
    t, q = _turns(spark, sf_dir), F.col("q")
    content = (
        F.when(F.col("turn") % 3 == 0, q)
        .when(F.col("turn") % 3 == 1, _line('[{"type":"text","text":', q, '},{"type":"tool_use","name":"Bash","input":{"file_path":"/w/', F.col("conv_id").cast("string"), '.py"}},{"type":"tool_result","content":"no"}]'))
        .otherwise(_line('[{"type":"wrap","content":[["lead",{"content":[{"type":"text","text":', q, '},{"type":"tool_use","input":{}}]}],{"type":"thinking","text":"no"}]},"tail",{"functionCall":{"name":"open","args":{"path":"a.txt"}}}]'))
    )
    value = _line('{"type":"', F.col("role"), '","sessionId":"s', F.col("conv_id").cast("string"), '","timestamp":"', F.col("at"), '","message":{"content":', content, "}}")
    return _records(t.select("conv_id", "turn", F.lit(0).alias("part"), value.alias("value")), _line("/p/s", F.col("conv_id").cast("string"), ".jsonl"))


def _read(turns):
    return turns.select("session_id", F.col("line_ord.block").alias("turn"), "role", "text", F.array_join("tools", ",").alias("tools"))


def s3_turns(spark, sf_dir):
    """Blocks in blocks, bare strings, calls, results and reasoning, at several depths."""
    return _read(jsonl.parse_claude(_claude(spark, sf_dir)))


def p2_files(spark, sf_dir):
    """Files that calls name, at whatever depth."""
    out = jsonl.touched_files(_claude(spark, sf_dir))
    return out.select(F.regexp_extract("path", "s([0-9-]+)", 1).alias("conv_id"), F.col("line_ord.block").alias("turn"), F.array_join("files", ",").alias("files"))


def _codex(spark, sf_dir):
    t, q = _turns(spark, sf_dir), F.col("q")
    said = lambda mark: _line('{"type":"message","role":"', F.col("role"), '","content":[{"type":"input_text","text":"', F.lit(mark), '"},', q, "]}")
    payload = (
        F.when((F.col("role") == "user") & (F.col("turn") % 4 == 0), _line('{"type":"message","role":"user","content":[', F.regexp_replace(q, '^"', '"PLEASE IMPLEMENT THIS PLAN:  '), "]}"))
        .when(F.col("turn") % 8 == 5, '{"type":"custom_tool_call","name":"apply_patch","input":"*** Update File: a.py"}')
        .when(F.col("turn") % 8 == 3, '{"type":"local_shell_call","action":{}}')
        .when(F.col("turn") % 4 == 2, said("<environment_context>"))
        .otherwise(said("plain"))
    )
    value = _line('{"type":"response_item","timestamp":"', F.col("at"), '","payload":', payload, "}")
    header = t.filter("turn = 0").select("conv_id", "turn", F.lit(-1).alias("part"), F.lit('{"type":"session_meta","payload":{"id":"of-the-header","cwd":"/w"}}').alias("value"))
    ended = F.when(F.col("role") == "assistant", "task_complete").otherwise("task_started")
    events = t.filter("role <> 'system'").select("conv_id", "turn", F.lit(1).alias("part"), _line('{"type":"event_msg","timestamp":"', F.col("at"), '","payload":{"type":"', ended, '"}}').alias("value"))
    lines = t.select("conv_id", "turn", F.lit(0).alias("part"), value.alias("value")).unionByName(header).unionByName(events)
    name = _line("/r/rollout-2026-0a1b2c3d-0000-4000-8000-", F.lpad(F.col("conv_id").cast("string"), 12, "0"))
    return _records(lines, F.concat(name, F.when(F.col("conv_id") % 2 == 0, "").otherwise("x"), F.lit(".jsonl")))


def s4_turns(spark, sf_dir):
    """Calls of three kinds, the plan banner, preambles; the session by the file's name, or by its header where the name does not end in a uuid."""
    out = jsonl.parse_codex(_codex(spark, sf_dir))
    return _read(out.withColumn("session_id", F.concat("session_id", F.lit(":"), F.regexp_extract("path", "-0*([0-9]+)x?\\.jsonl$", 1))))


def _gemini(spark, sf_dir):
    t, q = _turns(spark, sf_dir), F.col("q")
    kind = F.when(F.col("role") == "assistant", "gemini").when(F.col("role") == "user", "user").otherwise("info")
    message = lambda id_, content, at=F.col("at"): _line('{"id":"', id_, '","timestamp":"', at, '","type":"', kind, '","content":', content, "}")
    turn = F.col("turn").cast("string")
    bare = t.select("conv_id", "turn", F.lit(0).alias("part"), message(turn, q).alias("value"))
    # a snapshot tells the message again, and once more as a retry does: under a new id and with a nudge in the user's voice
    nudge = message(_line("n", turn), F.lit('["[System: go on]",{"text":"now"}]'))
    again = t.select("conv_id", "turn", F.lit(1).alias("part"), _line('{"$set":{"lastUpdated":"', F.col("at"), '","messages":[', message(turn, q), ",", message(_line("r", turn), _line('[{"text":', q, "}]"), F.lit("2027")), ",", nudge, "]}}").alias("value"))
    header = t.filter("turn = 0").select("conv_id", "turn", F.lit(-1).alias("part"), _line('{"sessionId":"', F.lpad(F.col("conv_id").cast("string"), 8, "0"), '-full"}').alias("value"))
    other = F.when(F.col("conv_id") % 2 == 0, F.lpad(F.col("conv_id").cast("string"), 8, "0")).otherwise("ffffffff")
    return _records(bare.unionByName(again).unionByName(header), _line("/g/p/chats/session-", F.col("conv_id").cast("string"), "-", other, ".jsonl"))


def s5_turns(spark, sf_dir):
    """Messages told twice, retries and nudges; the header's id where the name begins it, else the name."""
    out = jsonl.parse_gemini(_gemini(spark, sf_dir))
    return out.select("session_id", F.col("line_ord.block").alias("turn"), "role", "text", "ts")


def t2_states(spark, sf_dir):
    """By dialect: when each conversation last spoke and whether that leaves a turn running."""
    out = None
    for dialect, records in (("claude", _claude(spark, sf_dir)), ("codex", _codex(spark, sf_dir)), ("gemini", _gemini(spark, sf_dir))):
        one = activity.activity(records, dialect).select(F.lit(dialect).alias("dialect"), F.regexp_extract("path", r"^/p/s(-?\d+)|-0*(\d+)x?\.jsonl$", 1).alias("a"), F.regexp_extract("path", r"-0*(\d+)x?\.jsonl$", 1).alias("b"), F.regexp_extract("path", r"session-(\d+)-", 1).alias("c"), "at", "busy")
        key = {"claude": "a", "codex": "b", "gemini": "c"}[dialect]
        one = one.select("dialect", F.col(key).alias("conv_id"), F.unix_seconds("at").alias("at"), "busy")
        out = one if out is None else out.unionByName(one)
    return out


QUERIES = {f.__name__: f for f in (s3_turns, p2_files, s4_turns, s5_turns, t2_states)}

_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_T = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_S3 = _BARE.format("CASE turn % 3 WHEN 2 THEN 'lead' || chr(10) || text || chr(10) || 'tail' ELSE text END")
_SAID = _BARE.format("text")

SQL = {
    "s3_turns": f"""WITH {_T}, r AS (SELECT 's' || conv_id AS session_id, turn, role, {_S3} AS text, CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN 'Bash' ELSE 'tool,open' END AS tools FROM t WHERE role IN ('user', 'assistant'))
SELECT * FROM r WHERE (text <> '' OR tools <> '') AND NOT (role = 'user' AND text LIKE 'tool_result%')""",
    "p2_files": "SELECT CAST(conv_id AS VARCHAR) AS conv_id, turn, CASE turn % 3 WHEN 1 THEN '/w/' || conv_id || '.py' ELSE 'a.txt' END AS files FROM conversations WHERE turn % 3 <> 0",
    "s4_turns": f"""WITH {_T}, r AS (SELECT CASE conv_id % 2 WHEN 0 THEN '0a1b2c3d-0000-4000-8000-' || lpad(CAST(conv_id AS VARCHAR), 12, '0') ELSE 'of-the-header' END || ':' || conv_id AS session_id, turn,
  CASE WHEN role = 'user' AND turn % 4 = 0 THEN 'user' WHEN turn % 8 IN (3, 5) THEN 'assistant' ELSE role END AS role,
  CASE WHEN role = 'user' AND turn % 4 = 0 THEN {_SAID} WHEN turn % 8 IN (3, 5) THEN '' WHEN turn % 4 = 2 THEN {_BARE.format("'<environment_context>' || chr(10) || text")} ELSE {_BARE.format("'plain' || chr(10) || text")} END AS text,
  CASE turn % 8 WHEN 5 THEN 'apply_patch' WHEN 3 THEN 'shell' ELSE '' END AS tools FROM t)
SELECT * FROM r WHERE role IN ('user', 'assistant') AND (text <> '' OR tools <> '') AND NOT (role = 'user' AND text LIKE '<environment_context%')""",
    "s5_turns": f"""WITH {_T}, r AS (SELECT conv_id, turn, role, {_SAID} AS text, strftime(to_timestamp({START} + turn) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS ts FROM t WHERE role IN ('user', 'assistant')),
m AS (SELECT conv_id, role, text, min(struct_pack(ts := ts, turn := turn)) AS f FROM r WHERE text <> '' GROUP BY ALL
  UNION ALL SELECT conv_id, 'assistant', '[System: go on]' || chr(10) || 'now', min(struct_pack(ts := ts, turn := turn)) FROM r WHERE role = 'assistant' GROUP BY conv_id)
SELECT CASE conv_id % 2 WHEN 0 THEN lpad(CAST(conv_id AS VARCHAR), 8, '0') || '-full' ELSE 'session-' || conv_id || '-ffffffff' END AS session_id, f.turn AS turn, role, text, f.ts AS ts FROM m""",
    "t2_states": f"""WITH {_T}, l AS (SELECT conv_id, max(turn) AS top, max(turn) FILTER (role <> 'system') AS decides, arg_max(role, turn) FILTER (role <> 'system') AS who FROM t GROUP BY 1)
SELECT 'claude' AS dialect, CAST(conv_id AS VARCHAR) AS conv_id, CAST({START} + top AS BIGINT) AS "at", coalesce(who = 'user' OR decides % 3 = 1, false) AS busy FROM l
UNION ALL SELECT 'codex', CAST(conv_id AS VARCHAR), CAST({START} + top AS BIGINT), coalesce(who = 'user', false) FROM l UNION ALL SELECT 'gemini', CAST(conv_id AS VARCHAR), CAST({START} + top AS BIGINT), coalesce(who = 'user', false) FROM l""",
}
