"""Conversations as sessions, the event log as activity, pages as working folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import routing, turns as ops

LIMITS = {"max_chars": 400, "user": 120, "assistant": 300}


def turns(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), "role", "text")


def s8_sessions(spark, sf_dir):
    return ops.sessions_from_turns(turns(spark, sf_dir))


def p3_tool_markers(spark, sf_dir):
    """Every first word of a system turn stands for a tool."""
    t = turns(spark, sf_dir).withColumn("tools", F.when(F.col("role") == "system", F.array(F.split(F.lower("text"), " ")[0])).otherwise(F.array().cast("array<string>")))
    return ops.tool_markers(t)


def p5_stats(spark, sf_dir):
    return ops.session_stats(turns(spark, sf_dir))


def p6_clip(spark, sf_dir):
    return ops.clip_turns(turns(spark, sf_dir), LIMITS["user"], LIMITS["assistant"]).select("session_id", "seq", "text")


def p7_distil(spark, sf_dir):
    return ops.distil(turns(spark, sf_dir), **LIMITS)


def p8_digest(spark, sf_dir):
    return ops.with_digest(ops.distil(turns(spark, sf_dir), **LIMITS)).select("session_id", "digest")


def p9_local_notes(spark, sf_dir):
    return ops.local_notes(turns(spark, sf_dir))


def f2_same_text(spark, sf_dir):
    """Even sessions were read before, every fourth with another text."""
    new = ops.with_digest(ops.distil(turns(spark, sf_dir), **LIMITS)).select("session_id", "digest")
    old = new.filter("session_id % 2 = 0").withColumn("digest", F.when(F.col("session_id") % 4 == 0, F.lit("other")).otherwise(F.col("digest")))
    return ops.same_text(new, old).select("session_id", "verdict")


def f3_tiny(spark, sf_dir):
    return ops.drop_tiny(ops.session_stats(turns(spark, sf_dir))).select("session_id", "user_chars")


def _log(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("busy"))


def t2_activity(spark, sf_dir):
    return ops.activity(_log(spark, sf_dir))


def t3_open(spark, sf_dir):
    log = _log(spark, sf_dir)
    now = log.agg(F.max("ts").alias("now"))
    return ops.close_sessions(ops.activity(log).crossJoin(F.broadcast(now)), F.col("now"), quiet="2 hours", busy="6 hours").drop("now")  # one row


def t3_islands(spark, sf_dir):
    return ops.islands(_log(spark, sf_dir), quiet="2 hours", busy="6 hours").select("key", "opened", "last_at", "records", "busy")


_WALLS = (("en", "english", "model"), ("en/4", "fours", "local"), ("de", "german", "local"), ("fr", "french", "same-provider"))


def _routed(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    parts = pages.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"), F.regexp_extract("url", r"\.example\.([a-z]+)", 1).alias("agent"))
    return routing.route(parts, spark.createDataFrame(list(_WALLS), "base string, project string, destination string"))


def j1_route(spark, sf_dir):
    return _routed(spark, sf_dir)


_SESSION_WALLS = (("C:/Work/EN", "english", False, True), ("c:\\work\\en\\4\\", "fours", True, True), ("/srv/de/", "german", False, False), ("/srv/de/9", "nines", True, False))
_ROOTS = ("C:\\Work\\Fr", "/srv/ES/", "/srv/es/2", "c:/work/en")


def _folders(spark, sf_dir):
    """Pages as sessions: a quarter without a folder, the others in three spellings, some a folder deeper."""
    n = F.col("page_id")
    path = F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1)
    cwd = F.when(n % 4 == 0, F.concat(F.lit("C:\\Work\\"), F.replace(path, F.lit("/"), F.lit("\\")))).when(n % 4 == 1, F.concat(F.lit("/srv/"), path, F.lit("/Src/"))).when(n % 4 == 2, F.concat(F.lit("c:/work/"), F.upper(path)))
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", cwd.alias("cwd"))


def _walls(spark, rows):
    return spark.createDataFrame(list(rows), "path string, project string, local_only boolean, same_provider boolean")


def j1_sessions(spark, sf_dir):
    """Sessions by wall, repository or folder, and where they may go."""
    return routing.route_sessions(_folders(spark, sf_dir), _walls(spark, _SESSION_WALLS), spark.createDataFrame([(r,) for r in _ROOTS], "path string"))


def j1_no_walls(spark, sf_dir):
    """The same without any wall."""
    return routing.route_sessions(_folders(spark, sf_dir), _walls(spark, ()), spark.createDataFrame([(r,) for r in _ROOTS], "path string"))


def a12_egress(spark, sf_dir):
    return routing.egress(_routed(spark, sf_dir))


QUERIES = {f.__name__: f for f in (s8_sessions, p3_tool_markers, p5_stats, p6_clip, p7_distil, p8_digest, p9_local_notes, f2_same_text, f3_tiny, t2_activity, t3_open, t3_islands, j1_route, j1_sessions, j1_no_walls, a12_egress)}

_T = "t AS (SELECT conv_id AS session_id, turn AS seq, role, text FROM conversations)"


def _sql_clip(limit: int) -> str:
    half = (limit - 24) // 2
    return f"CASE WHEN length(flat) <= {limit} THEN flat ELSE flat[:{half}] || '{ops.CUT.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || right(flat, {half}) END"


_CLIP = f"""{_T}, flat AS (
  SELECT session_id, seq, role, regexp_replace(regexp_replace(text, '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS flat FROM t WHERE role IN ('user', 'assistant')
), clip AS (SELECT session_id, seq, role, CASE WHEN role = 'user' THEN {_sql_clip(LIMITS["user"])} ELSE {_sql_clip(LIMITS["assistant"])} END AS text FROM flat)"""
_HEADER = f"{ops.SESSION}chat' || chr(10) || '{ops.FOLDER}{ops.UNKNOWN}"
_BUDGET = LIMITS["max_chars"] - len(f"{ops.SESSION}chat\n{ops.FOLDER}{ops.UNKNOWN}")
_DISTIL = f"""{_CLIP}, b AS (
  SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY seq) - 1 AS i, count(*) OVER (PARTITION BY session_id) AS n,
    '### ' || CASE WHEN role = 'user' THEN '{ops.USER}' ELSE '{ops.ASSISTANT}' END || chr(10) || text AS block FROM clip
), u AS (
  SELECT *, sum(length(block) + 2) OVER (PARTITION BY session_id ORDER BY least(2 * i, 2 * (n - 1 - i) + 1)) AS used, sum(length(block) + 2) OVER (PARTITION BY session_id) AS total FROM b
), k AS (SELECT *, total <= {_BUDGET} OR used <= {_BUDGET} AS keep FROM u),
parts AS (
  SELECT session_id, i, block FROM k WHERE keep
  UNION ALL SELECT session_id, min(i), '{ops.DROPPED[0]}' || count(*) || '{ops.DROPPED[1]}' FROM k WHERE NOT keep GROUP BY 1
), d AS (
  SELECT p.session_id, '{_HEADER}' || string_agg(block, chr(10) || chr(10) ORDER BY i) AS text, any_value(dropped) AS dropped
  FROM parts p JOIN (SELECT session_id, count(*) FILTER (NOT keep) AS dropped FROM k GROUP BY 1) USING (session_id) GROUP BY 1
)"""
_LOG = "log AS (SELECT user_id AS key, ts, event_id AS id, event_type = 'error' AS busy FROM events), act AS (SELECT key, max(ts) AS at, arg_max(busy, (ts, id)) AS busy FROM log GROUP BY 1)"
_PATHS = """p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path, regexp_extract(url, '\\.example\\.([a-z]+)', 1) AS agent FROM pages),
w(base, project, destination) AS (VALUES """ + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in _WALLS) + """),
best AS (SELECT page_id, arg_max(project, length(base)) AS project, arg_max(destination, length(base)) AS destination FROM p JOIN w ON path = base OR starts_with(path, base || '/') GROUP BY 1),
routed AS (SELECT page_id, path, agent, coalesce(project, 'unsorted') AS project, coalesce(destination, 'local') AS destination FROM p LEFT JOIN best USING (page_id))"""


def _sessions_sql(walls) -> str:
    """Longest match over walls, then over roots, by comparing every path with every wall."""
    one = lambda c: f"lower(regexp_replace(replace({c}, '\\', '/'), '/+$', ''))"
    listed = ", ".join(f"('{p}', '{n}', {a}, {b})" for p, n, a, b in walls) or "(NULL, NULL, NULL, NULL)"
    under = lambda base: f"(c = {one(base)} OR starts_with(c, {one(base)} || '/'))"
    last = lambda c: f"regexp_extract(regexp_replace({c}, '[\\\\/]+$', ''), '([^\\\\/]*)$', 1)"
    return f"""WITH p AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'C:\\Work\\' || replace(path, '/', '\\') WHEN 1 THEN '/srv/' || path || '/Src/' WHEN 2 THEN 'c:/work/' || upper(path) END AS cwd FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages)),
k AS (SELECT *, {one("cwd")} AS c FROM p), w(path, project, local_only, same_provider) AS (SELECT * FROM (VALUES {listed}) v(path, project, local_only, same_provider) WHERE path IS NOT NULL), r(path) AS (VALUES {", ".join(f"('{x}')" for x in _ROOTS)}),
bw AS (SELECT page_id, arg_max(struct_pack(project := project, local_only := local_only, same_provider := same_provider), length({one("path")})) AS w FROM k JOIN w ON {under("path")} GROUP BY 1),
br AS (SELECT page_id, arg_max({last("path")}, length({one("path")})) AS r FROM k JOIN r ON {under("path")} GROUP BY 1),
j AS (SELECT page_id, cwd, CASE WHEN cwd IS NULL THEN 'unsorted' WHEN w IS NOT NULL THEN w.project ELSE coalesce(r, {last("cwd")}) END AS project, CASE WHEN cwd IS NULL THEN 'none' WHEN w IS NOT NULL THEN 'wall' WHEN r IS NOT NULL THEN 'root' ELSE 'folder' END AS via,
  cwd IS NOT NULL AND CASE WHEN w IS NOT NULL THEN NOT w.local_only ELSE {"false" if walls else "true"} END AS network, CASE WHEN cwd IS NOT NULL AND w IS NOT NULL THEN w.same_provider ELSE true END AS same_provider FROM k LEFT JOIN bw USING (page_id) LEFT JOIN br USING (page_id))
SELECT *, CASE WHEN NOT network THEN 'local' WHEN same_provider THEN 'same-provider' ELSE 'model' END AS destination FROM j"""


SQL = {
    "j1_sessions": _sessions_sql(_SESSION_WALLS),
    "j1_no_walls": _sessions_sql(()),
    "s8_sessions": f"WITH {_T} SELECT session_id, count(*) AS turns, count(*) FILTER (role = 'user') AS user_turns, count(*) FILTER (role = 'assistant') AS assistant_turns, min(seq) AS first_seq, max(seq) AS last_seq FROM t GROUP BY 1",
    "p3_tool_markers": f"""WITH {_T}, a AS (SELECT *, role = 'assistant' AND trim(text) <> '' AS answer FROM t),
g AS (SELECT *, coalesce(sum(CAST(answer AS INT)) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM a),
n AS (SELECT session_id, part, string_split(lower(text), ' ')[1] AS name, min(seq) AS s FROM g WHERE role = 'system' GROUP BY 1, 2, 3),
e AS (SELECT session_id, part, max(seq) FILTER (answer) AS seq FROM g GROUP BY 1, 2)
SELECT session_id, seq, string_agg(name, ',' ORDER BY s) AS tool FROM n JOIN e USING (session_id, part) WHERE seq IS NOT NULL GROUP BY 1, 2""",
    "p5_stats": f"WITH {_T} SELECT session_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars, count(*) FILTER (role IN ('user', 'assistant')) AS blocks FROM t GROUP BY 1",
    "p6_clip": f"WITH {_CLIP} SELECT session_id, seq, text FROM clip",
    "p7_distil": f"WITH {_DISTIL} SELECT session_id, text, dropped FROM d",
    "p8_digest": f"WITH {_DISTIL} SELECT session_id, sha256(text) AS digest FROM d",
    "p9_local_notes": f"""WITH {_T}, s AS (SELECT session_id, seq, trim(regexp_extract(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '^[^.!?\\n]*')) AS sentence FROM t WHERE role = 'user'),
r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY seq) AS rn FROM s WHERE length(sentence) > 12)
SELECT session_id, arg_min(sentence, seq) AS title, string_agg(sentence, ' | ' ORDER BY seq) FILTER (rn <= 12) AS did, arg_max(sentence, seq) AS where_left FROM r GROUP BY 1""",
    "f2_same_text": f"WITH {_DISTIL} SELECT session_id, CASE WHEN session_id % 2 = 0 AND session_id % 4 <> 0 THEN 'same' ELSE 'todo' END AS verdict FROM d",
    "f3_tiny": f"WITH {_T} SELECT session_id, CAST(sum(length(text)) FILTER (role = 'user') AS BIGINT) AS user_chars FROM t GROUP BY 1 HAVING sum(length(text)) FILTER (role = 'user') >= 200",
    "t2_activity": f"WITH {_LOG} SELECT * FROM act",
    "t3_open": f"WITH {_LOG} SELECT key, \"at\", busy, \"at\" + CASE WHEN busy THEN INTERVAL 6 HOUR ELSE INTERVAL 2 HOUR END > (SELECT max(ts) FROM log) AS open FROM act",
    "t3_islands": f"""WITH {_LOG}, g AS (SELECT *, coalesce(ts >= lag(ts) OVER o + CASE WHEN lag(busy) OVER o THEN INTERVAL 6 HOUR ELSE INTERVAL 2 HOUR END, true) AS starts FROM log WINDOW o AS (PARTITION BY key ORDER BY ts, id)),
i AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY key ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT key, min(ts) AS opened, max(ts) AS last_at, count(*) AS records, arg_max(busy, (ts, id)) AS busy FROM i GROUP BY key, island""",
    "j1_route": f"WITH {_PATHS} SELECT page_id, path, agent, project, destination FROM routed",
    "a12_egress": f"WITH {_PATHS} SELECT agent, project, destination, CAST(grouping(agent, project, destination) AS BIGINT) AS grouping, count(*) AS files FROM routed GROUP BY GROUPING SETS ((agent), (project), (destination), ())",
}
