"""Gates and scans over the event log and the talks: which files are read, which are set aside, what a reader is offered."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import context
from ..operators import facts as questions
from ..operators import search
from ..operators import turns as ops
from .memory import CLAIMS_SQL, claims, fold_sql, folded
from .sessions import turns


def _events(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumns({"k": F.get_json_object("props", "$.k").cast("int"), "ts": F.col("ts").cast("timestamp")})


def _files(spark, sf_dir):
    """Each event is a transcript; its value makes its size."""
    e = _events(spark, sf_dir)
    return e.select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), F.floor(F.col("value") * 100).cast("long").alias("size"), F.unix_millis("ts").alias("mtime"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"), F.col("event_type").alias("agent"), "k", F.col("event_id").alias("n"))


def f1_changed(spark, sf_dir):
    """Every fourth file is new, every fifth of the others changed since; some wait, some were too short."""
    f = _files(spark, sf_dir)
    was = F.concat_ws(":", F.when(F.col("n") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")).cast("string"), F.col("mtime").cast("string"))
    status = F.when(F.col("k") % 6 == 0, "quarantined").when(F.col("k") % 6 == 1, "pending-extraction").when(F.col("k") % 6 == 2, "empty").otherwise("ok")
    ledger = f.filter("n % 4 > 0").select("path", was.alias("fingerprint"), status.alias("status"), F.when(F.col("k") % 12 == 2, 100).otherwise(200).alias("min_user_chars"))
    return ops.changed_files(f, ledger).select("path", "verdict")


def f4_self(spark, sf_dir):
    e = _events(spark, sf_dir).select("event_id", F.when(F.col("k") % 3 == 0, "C:\\\\Work\\\\").when(F.col("k") % 3 == 1, F.concat(F.lit("/home/"), "event_type")).alias("cwd"))
    return ops.drop_self(e, "c:/work").select("event_id", "cwd")


def f5_select(spark, sf_dir):
    """One project's and agent's files: the oldest hundred, and how many are left."""
    return ops.select_candidates(_files(spark, sf_dir), 100, "p3", "view").select("path", F.coalesce("rank", F.lit(0)).alias("rank"), "left")


def f6_unread(spark, sf_dir):
    f = _files(spark, sf_dir)
    name = F.concat(F.lit("s"), F.col("n").cast("string"))
    ledger = f.filter("n % 2 = 0").select(name.alias("session_id"), F.lit("old").alias("fingerprint"), F.when(F.col("k") % 3 == 0, "ok").when(F.col("k") % 3 == 1, "empty").otherwise("pending-extraction").alias("status"), F.lit(None).cast("int").alias("min_user_chars"))
    kind = F.when(F.col("k") % 5 == 0, "self").when(F.col("k") % 5 == 1, "none").otherwise("tiny")
    judged = f.filter("n % 3 = 0").select(F.when(F.col("k") % 5 != 1, name).alias("session_id"), "agent", "path", F.when(F.col("k") % 7 > 0, F.lit("new")).alias("fingerprint"), kind.alias("kind"), F.col("k").alias("user_chars"))
    return ops.record_unread(ledger, judged).select("session_id", "fingerprint", "status", F.coalesce("min_user_chars", F.lit(0)).alias("min_user_chars"))


def f7_offered(spark, sf_dir):
    """Users are subjects, of which every fifth is a tool; five projects read, each by one agent."""
    s = _files(spark, sf_dir).select(F.col("n").cast("string").alias("session_id"), "project", "agent")
    readers = spark.createDataFrame([("r1", "p1", "view"), ("r2", "p2", "error"), ("r3", "p3", None), ("r4", "p4", "click"), ("r5", "nowhere", "view")], "reader string, project string, agent string")
    tools = claims(spark, sf_dir).select("subject").distinct().filter("cast(replace(subject, 'u', '') as long) % 5 = 0")
    return ops.offered_facts(folded(spark, sf_dir).facts, s, readers, tools).select("reader", "subject", "key", "session_id")


def f8_digests(spark, sf_dir):
    e, hour = _events(spark, sf_dir), lambda n: F.expr(f"INTERVAL {n} HOURS")
    name = F.concat(F.lit("n"), F.col("event_id").cast("string"))
    note = e.select(name.alias("note"), F.col("event_id").alias("session_id"), F.col("ts").alias("processed_at"), F.when(F.col("k") % 11 == 0, "git").otherwise(F.concat((F.floor(F.col("value") * 100)).cast("string"), F.lit(":1"))).alias("fingerprint"), F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"))
    commits = e.filter("k % 13 > 0").select(name.alias("note"), F.when(F.col("k") % 7 == 0, F.col("ts") + hour(13)).otherwise(F.col("ts") + hour(1)).alias("at"), F.lit("scan").alias("kind"))
    commits = commits.unionByName(e.filter("k % 9 = 0").select(name.alias("note"), (F.col("ts") + hour(2)).alias("at"), F.lit("revert").alias("kind")))
    files = e.filter("k % 17 > 0").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"), (F.floor(F.col("value") * 100) + F.when(F.col("k") % 5 == 0, 1).otherwise(0)).cast("long").alias("size"), F.when(F.col("k") % 19 > 0, F.col("event_id")).alias("parsed_id"))
    return ops.infer_digests(note, commits, files)


def a13_tally(spark, sf_dir):
    return ops.tally(f1_changed(spark, sf_dir).select(F.col("verdict").alias("outcome")))


def t4_open(spark, sf_dir):
    """Users with an event within two hours of the log's end, or six where the last was an error; files of every seventh were touched since."""
    e = _events(spark, sf_dir)
    log = e.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), (F.col("event_type") == "error").alias("busy"))
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    files = e.groupBy(F.col("user_id").alias("key")).agg(F.when(F.col("user_id") % 7 == 0, F.lit(now)).otherwise(F.min("ts")).alias("mtime"))
    return ops.open_report(ops.activity(log), files, F.lit(now), quiet="2 hours", busy="6 hours")


def t6_retry(spark, sf_dir):
    f = _files(spark, sf_dir)
    s = f.select(F.col("n").alias("session_id"), F.col("path").alias("source_file"), F.when(F.col("k") % 6 == 0, "quarantined").when(F.col("k") % 6 == 1, "pending-extraction").otherwise("ok").alias("status"))
    return ops.retry(s, f.filter("n % 2 = 0").select("path"))


def t6_kept(spark, sf_dir):
    """Even talks had a note; every third is read again, every sixth without an answer."""
    t = turns(spark, sf_dir).groupBy("session_id").agg(F.min_by("text", "seq").alias("text"))
    again = t.filter("session_id % 3 = 0").select("session_id", F.when(F.col("session_id") % 6 > 0, F.lit("read again")).alias("text"))
    return ops.kept_notes(t.filter("session_id % 2 = 0"), again)


def p4_resume(spark, sf_dir):
    """The places of a user's events are paths; those of clicks lie in scratch folders."""
    e = _events(spark, sf_dir)
    path = F.when(F.col("event_type") == "click", F.concat(F.lit("C:\\\\Temp\\\\"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("/src/"), F.col("event_id").cast("string")))
    files = e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("pos"), path.alias("path"))
    stats = e.filter("k % 4 > 0").select(path.alias("path"), F.col("k").cast("long").alias("mtime"))
    return ops.resume_files(files, stats)


def p5_tools(spark, sf_dir):
    """With each system turn's first word as a tool."""
    t = turns(spark, sf_dir).withColumn("tools", F.when(F.col("role") == "system", F.array(F.split(F.lower("text"), " ")[0])).otherwise(F.array().cast("array<string>")))
    return ops.session_stats(t)


def a10_cost(spark, sf_dir):
    """Purchases have no price at all, every third of the other calls neither."""
    e = _events(spark, sf_dir)
    cost = F.when((F.col("event_type") != "purchase") & (F.col("event_id") % 3 > 0), F.col("value") / 100)
    return questions.usage(e.select(F.col("event_type").alias("provider"), F.col("k").cast("long").alias("tokens"), cost.alias("cost")))


def a11_scans(spark, sf_dir):
    e = _events(spark, sf_dir)
    return questions.rereads(e.select(F.col("user_id").alias("note"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "scan").otherwise("other").alias("kind")))


def w7_nearest(spark, sf_dir):
    """Each talk's first turn against the parts, whose brand's number and whose talk's number fall into one of five projects."""
    p = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("fact_id"), F.concat(F.lit("p"), (F.col("doc_id") % 5).cast("string")).alias("project"), "text")
    s = turns(spark, sf_dir).groupBy("session_id").agg(F.min_by("text", "seq").alias("text")).withColumn("project", F.concat(F.lit("p"), (F.col("session_id") % 5).cast("string")))
    return search.nearest(p, s, 5).select("session_id", "fact_id", "rank")


def _context(spark, sf_dir):
    """Documents as facts of five projects: seven subjects, of which one is hidden and two are tools, one with a definition."""
    n = F.col("doc_id")
    subject = F.when(n % 35 == 0, "p0").otherwise(F.concat(F.lit("s"), (n % 7).cast("string")))
    facts = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        n.alias("fact_id"), F.concat(F.lit("p"), (n % 5).cast("string")).alias("project"), subject.alias("subject"), F.when(n % 7 > 4, "tool").otherwise("term").alias("subject_kind"),
        F.concat(F.lit("k"), n.cast("string")).alias("key"), F.left("text", F.lit(60)).alias("claim"), (subject == "s3").alias("hidden"),
    )
    s = turns(spark, sf_dir).groupBy("session_id").agg(F.min_by("text", "seq").alias("text")).withColumn("project", F.concat(F.lit("p"), (F.col("session_id") % 5).cast("string")))
    told = spark.createDataFrame([("s5", " what it takes "), ("s6", " ")], "tool string, admits string")
    return s, facts, told, 4, 5


def w8_context(spark, sf_dir):
    """What each talk is shown of memory, line by line."""
    return context.memory_context(*_context(spark, sf_dir))


def w8_texts(spark, sf_dir):
    """The same as one text a talk."""
    return context.memory_texts(*_context(spark, sf_dir)).select("session_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.length("text").cast("long").alias("chars"))


QUERIES = {f.__name__: f for f in (w8_context, w8_texts, f1_changed, f4_self, f5_select, f6_unread, f7_offered, f8_digests, a13_tally, t4_open, t6_retry, t6_kept, p4_resume, p5_tools, a10_cost, a11_scans, w7_nearest)}

_E = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)"
_F1 = f"""WITH {_E} SELECT 'f' || event_id AS path, CASE WHEN event_id % 4 = 0 THEN 'new' WHEN event_id % 5 = 0 THEN 'changed' WHEN k % 6 IN (0, 1) THEN 'retry' WHEN k % 12 = 2 THEN 'rejudge' ELSE 'unchanged' END AS verdict FROM e"""
_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 3))"

_CTX = f"""f AS (SELECT doc_id AS fact_id, 'p' || doc_id % 5 AS project, CASE WHEN doc_id % 35 = 0 THEN 'p0' ELSE 's' || doc_id % 7 END AS subject, 'k' || doc_id AS key, left(text, 60) AS claim FROM documents),
o AS (SELECT *, CASE subject WHEN 's5' THEN 'what it takes' END AS admits FROM f WHERE subject NOT IN ('s3', 's6')),
l AS (SELECT project, subject, any_value(admits) AS admits, row_number() OVER (PARTITION BY project ORDER BY min(fact_id)) AS place FROM o GROUP BY 1, 2 QUALIFY place <= 5),
w AS (SELECT DISTINCT conv_id AS session_id, 'p' || conv_id % 5 AS project FROM conversations),
fw AS (SELECT fact_id, project, unnest({_TERMS.format("concat_ws(' ', subject, key, claim)")}) AS word FROM o), d AS (SELECT project, word, count(*) AS df FROM fw GROUP BY 1, 2), n AS (SELECT project, count(*) AS docs FROM o GROUP BY 1),
sw AS (SELECT session_id, 'p' || session_id % 5 AS project, unnest({_TERMS.format("text")}) AS word FROM (SELECT conv_id AS session_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)),
m AS (SELECT session_id, fact_id, round(sum(ln(1 + docs / df)), 6) AS score FROM sw JOIN d USING (project, word) JOIN n USING (project) JOIN fw USING (project, word) GROUP BY 1, 2),
b AS (SELECT session_id, fact_id, max(score) AS score FROM (SELECT * FROM m UNION ALL SELECT session_id, fact_id, 0.0 FROM w JOIN o USING (project)) GROUP BY 1, 2),
near AS (SELECT session_id, fact_id FROM b QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY score DESC, fact_id) <= 4),
lines AS (
  SELECT session_id, 1 AS section, CAST(0 AS BIGINT) AS ord, '{context.TITLE}' AS line FROM w UNION ALL SELECT session_id, 1, 1, '{context.PROJECT}' || project FROM w
  UNION ALL SELECT session_id, 2, 0, '{context.SUBJECTS}' || names FROM w JOIN (SELECT project, string_agg(subject, '{context.BETWEEN}' ORDER BY place) AS names FROM l GROUP BY 1) USING (project)
  UNION ALL SELECT session_id, 3, 0, '{context.TOOLS}' FROM w WHERE project IN (SELECT project FROM l WHERE admits IS NOT NULL) UNION ALL SELECT session_id, 3, place, '- ' || subject || ': ' || admits FROM w JOIN l USING (project) WHERE admits IS NOT NULL
  UNION ALL SELECT w.session_id, CASE WHEN x.fact_id IS NULL THEN 5 ELSE 4 END, o.fact_id, '- ' || subject || '.' || key || CASE WHEN x.fact_id IS NULL THEN '' ELSE ': ' || claim END FROM w JOIN o USING (project) LEFT JOIN near x ON x.session_id = w.session_id AND x.fact_id = o.fact_id
)"""

SQL = {
    "w8_context": f"WITH {_CTX} SELECT * FROM lines",
    "w8_texts": f"""WITH {_CTX}, e AS (SELECT * FROM lines UNION ALL SELECT DISTINCT session_id, 5, CAST(-1 AS BIGINT), '{context.OTHERS}' FROM lines WHERE section = 5), t AS (SELECT session_id, string_agg(line, chr(10) ORDER BY section, ord) AS text FROM e GROUP BY 1)
SELECT session_id, sha256(text) AS digest, CAST(length(text) AS BIGINT) AS chars FROM t""",
    "f1_changed": _F1,
    "f4_self": f"WITH {_E}, c AS (SELECT event_id, CASE k % 3 WHEN 0 THEN 'C:\\Work\\' WHEN 1 THEN '/home/' || event_type END AS cwd FROM e) SELECT * FROM c WHERE cwd IS NULL OR cwd LIKE '/home/%'",
    "f5_select": """WITH f AS (SELECT 'f' || event_id AS path, row_number() OVER (ORDER BY epoch_ms(ts), 'f' || event_id) AS rank, count(*) OVER () AS n FROM events WHERE user_id % 10 = 3 AND event_type = 'view')
SELECT path, CASE WHEN rank <= 100 THEN rank ELSE 0 END AS rank, greatest(n - 100, 0) AS "left" FROM f""",
    "f6_unread": f"""WITH {_E}, l AS (SELECT 's' || event_id AS session_id, 'old' AS fingerprint, CASE k % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'empty' ELSE 'pending-extraction' END AS status FROM e WHERE event_id % 2 = 0),
n AS (SELECT CASE WHEN k % 5 <> 1 THEN 's' || event_id ELSE event_type || ':f' || event_id END AS session_id, CASE WHEN k % 5 = 0 THEN 'skipped' ELSE 'empty' END AS status, CASE WHEN k % 5 > 1 THEN 200 END AS m FROM e WHERE event_id % 3 = 0 AND k % 7 > 0)
SELECT session_id, CASE WHEN l.status IS NOT NULL AND (n.status IS NULL OR l.status NOT IN ('empty', 'skipped')) THEN 'old' ELSE 'new' END AS fingerprint,
  CASE WHEN l.status IS NOT NULL AND (n.status IS NULL OR l.status NOT IN ('empty', 'skipped')) THEN l.status ELSE n.status END AS status,
  CASE WHEN l.status IS NOT NULL AND (n.status IS NULL OR l.status NOT IN ('empty', 'skipped')) THEN 0 ELSE coalesce(m, 0) END AS min_user_chars FROM l FULL JOIN n USING (session_id)""",
    "f7_offered": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql('k')}, s AS (SELECT CAST(event_id AS VARCHAR) AS session_id, 'p' || (user_id % 10) AS project, event_type AS agent FROM events),
r(reader, project, agent) AS (VALUES ('r1', 'p1', 'view'), ('r2', 'p2', 'error'), ('r3', 'p3', NULL), ('r4', 'p4', 'click'), ('r5', 'nowhere', 'view'))
SELECT reader, subject, key, x.session_id FROM facts x JOIN s USING (session_id) JOIN r ON s.project = r.project OR (s.agent = r.agent AND CAST(replace(subject, 'u', '') AS BIGINT) % 5 = 0) WHERE superseded_at IS NULL""",
    "f8_digests": f"""WITH {_E} SELECT 'n' || event_id AS note, event_id AS session_id, CASE WHEN k % 13 = 0 THEN 'no reading' WHEN k % 9 = 0 AND k % 7 > 0 THEN 'reverted since' WHEN k % 7 = 0 THEN 'another reading''s row' WHEN k % 11 = 0 THEN 'not a reading''s fingerprint'
  WHEN k % 17 = 0 THEN 'no file' WHEN k % 5 = 0 THEN 'file grew' WHEN k % 19 = 0 THEN 'another session' END AS skipped FROM e""",
    "a13_tally": f"SELECT coalesce(verdict, 'discovered') AS what, count(*) AS files FROM ({_F1}) GROUP BY GROUPING SETS ((verdict), ())",
    "t4_open": """WITH a AS (SELECT user_id AS key, max(ts) AS at, arg_max(event_type = 'error', (ts, event_id)) AS busy FROM events GROUP BY 1), n AS (SELECT max(ts) AS now FROM events),
o AS (SELECT key, CASE WHEN "at" + CASE WHEN busy THEN INTERVAL 6 HOUR ELSE INTERVAL 2 HOUR END > now THEN CASE WHEN busy THEN 'busy' ELSE 'quiet' END WHEN key % 7 = 0 THEN 'mtime' WHEN (SELECT min(ts) FROM events WHERE user_id = key) + INTERVAL 2 HOUR > now THEN 'mtime' END AS why FROM a, n)
SELECT * FROM o WHERE why IS NOT NULL""",
    "t6_retry": f"WITH {_E} SELECT 'f' || event_id AS path, event_id AS session_id, CASE k % 6 WHEN 0 THEN 'quarantined' ELSE 'pending-extraction' END AS status FROM e WHERE event_id % 2 = 0 AND k % 6 IN (0, 1)",
    "t6_kept": """WITH t AS (SELECT conv_id AS session_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)
SELECT session_id, CASE WHEN session_id % 3 = 0 AND session_id % 6 > 0 THEN 'read again' WHEN session_id % 2 = 0 THEN text END AS text FROM t WHERE session_id % 2 = 0 OR session_id % 3 = 0""",
    "p4_resume": f"""WITH {_E}, f AS (SELECT user_id AS session_id, event_id AS pos, '/src/' || event_id AS path, CASE WHEN k % 4 > 0 THEN k ELSE 0 END AS m FROM e WHERE event_type <> 'click'),
r AS (SELECT *, count(*) OVER (PARTITION BY session_id) AS n, row_number() OVER (PARTITION BY session_id ORDER BY m DESC, pos) AS newest, row_number() OVER (PARTITION BY session_id ORDER BY pos) AS first FROM f)
SELECT session_id, path, CASE WHEN n <= 15 THEN first ELSE newest END AS rank FROM r WHERE CASE WHEN n <= 15 THEN first ELSE newest END <= 15""",
    "p5_tools": """SELECT conv_id AS session_id, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS user_chars, count(*) FILTER (role IN ('user', 'assistant')) AS blocks,
  coalesce(string_agg(DISTINCT string_split(lower(text), ' ')[1], ',' ORDER BY string_split(lower(text), ' ')[1]) FILTER (role = 'system'), '') AS tool_names FROM conversations GROUP BY 1""",
    "a10_cost": f"""WITH {_E}, c AS (SELECT *, CASE WHEN event_type <> 'purchase' AND event_id % 3 > 0 THEN value / 100 END AS cost FROM e)
SELECT event_type AS provider, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, round(sum(cost), 4) AS cost, count(*) FILTER (cost IS NULL) AS unpriced FROM c GROUP BY 1""",
    "a11_scans": "SELECT user_id AS note, count(*) AS readings FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) > 3",
    "w7_nearest": f"""WITH fw AS (SELECT doc_id AS fact_id, doc_id % 5 AS project, unnest({_TERMS.format("text")}) AS word FROM documents), d AS (SELECT project, word, count(*) AS df FROM fw GROUP BY 1, 2), n AS (SELECT doc_id % 5 AS project, count(*) AS docs FROM documents GROUP BY 1),
sw AS (SELECT session_id, session_id % 5 AS project, unnest({_TERMS.format("text")}) AS word FROM (SELECT conv_id AS session_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1)),
m AS (SELECT session_id, fact_id, round(sum(ln(1 + docs / df)), 6) AS score FROM sw JOIN d USING (project, word) JOIN n USING (project) JOIN fw USING (project, word) GROUP BY 1, 2),
z AS (SELECT DISTINCT conv_id AS session_id, doc_id AS fact_id, 0.0 AS score FROM conversations, documents WHERE conv_id % 5 = doc_id % 5),
b AS (SELECT session_id, fact_id, max(score) AS score FROM (SELECT * FROM m UNION ALL SELECT * FROM z) GROUP BY 1, 2)
SELECT session_id, fact_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, fact_id) AS rank FROM b) WHERE rank <= 5""",
}
