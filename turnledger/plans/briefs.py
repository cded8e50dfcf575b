"""Briefs over the event log: ten projects of users, each event a session that may leave decisions and a place to resume."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import briefs as ops
from .memory import CLAIMS_SQL, fold_sql, folded
from .sessions import turns

MAX_CHARS = 1500


def sessions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_id").cast("string").alias("session_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"), F.col("event_type").alias("agent"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("started_at"), F.get_json_object("props", "$.k").cast("int").alias("k"), "value",
    )


def _tables(spark, sf_dir):
    out, s = folded(spark, sf_dir), sessions(spark, sf_dir)
    n = F.floor("value").cast("string")
    decisions = s.filter("k % 4 = 0").select("session_id", F.array(F.concat(F.lit("keep "), n), F.concat("agent", F.lit(" decides"))).alias("items"))
    resumes = s.filter("k % 3 > 0").select("session_id", F.array(F.concat(F.lit("stopped at "), n), F.concat(F.lit("next: "), "agent")).alias("lines"))
    return s, out.facts, out.pending, decisions, resumes


def j2_project_facts(spark, sf_dir):
    return ops.project_facts(folded(spark, sf_dir).facts, sessions(spark, sf_dir)).select("project", "subject", "key", "claim", "session_id")


def w6_sections(spark, sf_dir):
    return ops.brief_sections(*_tables(spark, sf_dir))


def w5_briefs(spark, sf_dir):
    return ops.briefs(ops.brief_sections(*_tables(spark, sf_dir)), MAX_CHARS)


def q1_brief(spark, sf_dir):
    """One project's brief at the usual length."""
    return ops.brief(*_tables(spark, sf_dir), "p3")


def q5_read_session(spark, sf_dir):
    """Every session that the log or the talks name: odd ones have no note, those of the log alone are unknown."""
    t = turns(spark, sf_dir)
    known = t.select("session_id").distinct()
    wanted = known.unionByName(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("session_id"))).distinct()
    status = known.withColumn("status", F.when(F.col("session_id") % 4 == 1, "empty").otherwise("ok"))
    notes = t.filter("session_id % 2 = 0").groupBy("session_id").agg(F.min_by("text", "seq").alias("text"))
    return ops.read_sessions(status, notes, wanted)


STAMPED = ops.stamp_line("2026-01-01 00:00 UTC", "run it")


def w5_stamped(spark, sf_dir):
    """Briefs that say how old they are, which costs budget."""
    return ops.briefs(ops.brief_sections(*_tables(spark, sf_dir)), MAX_CHARS, STAMPED)


def d9_stale(spark, sf_dir):
    """Each talk has a brief of its own; even ones fence a command to resume it, odd ones speak of it. Some transcripts, folders and programs are gone."""
    n = F.col("session_id")
    s = turns(spark, sf_dir).select("session_id").distinct()
    resume = F.concat(F.lit('cd "/w/'), (n % 7).cast("string"), F.lit('" && run --resume '), n.cast("string"))
    command = F.when(n % 11 == 0, "mem scan").otherwise(F.concat(F.lit('"/bin/node" "/cli/'), (n % 5).cast("string"), F.lit('" scan')))
    stamp = F.concat(F.lit(f"{ops.STAMP} now{ops.AGED}"), command, F.lit(f"{ops.BEFORE_USE}\n\n"))
    text = F.concat(F.when(n % 13 == 0, "no stamp\n").otherwise(stamp), F.when(n % 2 == 0, F.concat(F.lit("```bash\n"), resume, F.lit("\n```\n"))).otherwise(F.concat(F.lit("we said ```bash "), resume, F.lit(" ```\n"))))
    documents = s.select(n.alias("doc_id"), n.cast("string").alias("project"), text.alias("text"))
    last = s.select(n.cast("string").alias("project"), resume.alias("resume"), F.concat(F.lit("t"), n.cast("string")).alias("source_file"))
    files = s.filter(n % 3 != 0).select(F.concat(F.lit("t"), n.cast("string")).alias("path")).unionByName(s.select(F.explode(F.array(F.lit("/bin/node"), F.concat(F.lit("/cli/"), (n % 4).cast("string")))).alias("path")).distinct())
    return ops.stale_offers(documents, last, files, spark.range(6).select(F.concat(F.lit("/w/"), F.col("id").cast("string")).alias("path")))


QUERIES = {f.__name__: f for f in (j2_project_facts, w6_sections, w5_briefs, w5_stamped, q1_brief, q5_read_session, d9_stale)}

_S = f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql("k")},
ss AS (SELECT CAST(event_id AS VARCHAR) AS session_id, 'p' || (user_id % 10) AS project, event_type AS agent, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS started_at, CAST(json_extract_string(props, '$.k') AS INT) AS kk, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS n FROM events)"""
_J2 = _S + ", pf AS (SELECT project, subject, key, claim, f.session_id FROM facts f JOIN ss USING (session_id) WHERE superseded_at IS NULL)"
_LINES = _J2 + f""", r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY started_at DESC, session_id DESC) AS rank FROM ss),
res AS (SELECT * FROM r WHERE rank = 1 AND kk % 3 > 0),
wt AS (SELECT r.project, p.*, row_number() OVER (PARTITION BY project ORDER BY p.created_at DESC, subject, key) AS rn FROM r JOIN pending p USING (session_id) WHERE rank = 1),
dc AS (SELECT project, item, row_number() OVER (PARTITION BY project ORDER BY rank, pos) AS rn FROM (
  SELECT project, rank, 0 AS pos, 'keep ' || n AS item FROM r WHERE rank <= {ops.DECIDED_IN} AND kk % 4 = 0 UNION ALL SELECT project, rank, 1, agent || ' decides' FROM r WHERE rank <= {ops.DECIDED_IN} AND kk % 4 = 0)),
body AS (
  SELECT project, 1 AS section, '1' AS a, 0 AS b, '' AS c, 'stopped at ' || n AS text FROM res UNION ALL SELECT project, 1, '1', 1, '', 'next: ' || agent FROM res
  UNION ALL SELECT project, 2, subject, 1, key, '- ' || key || ': ' || claim FROM pf
  UNION ALL SELECT DISTINCT project, 2, subject, 0, '', '**' || subject || '**' FROM pf UNION ALL SELECT DISTINCT project, 2, subject, 2, '', '' FROM pf
  UNION ALL SELECT project, 3, '1', CAST(rn AS INT), '', '- `' || subject || '.' || key || '` — ' || claim FROM wt WHERE rn <= {ops.OPEN}
  UNION ALL SELECT DISTINCT project, 3, '2', 0, '', '' FROM wt UNION ALL SELECT DISTINCT project, 3, '2', 1, '', '{ops.ASK}' FROM wt
  UNION ALL SELECT project, 4, '1', CAST(rn AS INT), '', '- ' || item FROM dc WHERE rn <= {ops.DECIDED}
  UNION ALL SELECT project, 5, '1', CAST(rank AS INT), '', '- ' || started_at[:10] || ' · ' || agent || ' · ' || session_id FROM r WHERE rank <= {ops.RECENT}
),
heads AS (SELECT DISTINCT b.project, b.section, '' AS a, 0 AS b, '' AS c, CASE b.section WHEN 1 THEN '{ops.RESUME}' || r.started_at[:10] || ' · ' || r.agent || ')' WHEN 2 THEN '{ops.FACTS}' WHEN 3 THEN '{ops.PENDING}' WHEN 4 THEN '{ops.DECISIONS}' ELSE '{ops.HISTORY}' END AS text
  FROM body b JOIN r ON r.project = b.project AND r.rank = 1),
lines AS (SELECT * FROM body UNION ALL SELECT * FROM heads UNION ALL SELECT project, section, a, 1, c, '' FROM heads)"""


def _brief_sql(limit: int, stamp: str = "") -> str:
    head = f"'{stamp}' || chr(10) || chr(10) || " if stamp else ""
    return _LINES + f""", u AS (SELECT *, length({head}'{ops.TITLE}' || project) + 1 + sum(length(text) + 1) OVER (PARTITION BY project ORDER BY section, a, b, c) <= {limit} AS fits FROM lines),
v AS (SELECT *, bool_and(fits) OVER (PARTITION BY project, section) AS whole, count(*) FILTER (fits) OVER (PARTITION BY project, section) AS kept FROM u),
sh AS (SELECT project, section, string_agg(text, chr(10) ORDER BY a, b, c) AS part FROM v WHERE fits AND (whole OR kept > 2) GROUP BY 1, 2),
br AS (SELECT project, regexp_replace({head}'{ops.TITLE}' || project || chr(10) || chr(10) || coalesce(string_agg(part || chr(10), chr(10) ORDER BY section), ''), '\\s+$', '') || chr(10) AS text FROM (SELECT DISTINCT project FROM lines) LEFT JOIN sh USING (project) GROUP BY 1)
SELECT * FROM br"""


SQL = {
    "j2_project_facts": _J2 + " SELECT * FROM pf",
    "w6_sections": _LINES + " SELECT * FROM lines",
    "w5_briefs": _brief_sql(MAX_CHARS),
    "w5_stamped": _brief_sql(MAX_CHARS, STAMPED),
    "d9_stale": """WITH s AS (SELECT DISTINCT conv_id AS n FROM conversations)
SELECT n AS doc_id, 'resume' AS why FROM s WHERE n % 2 = 0 AND (n % 3 = 0 OR n % 7 = 6)
UNION ALL SELECT n, 'stamp' FROM s WHERE n % 13 <> 0 AND (n % 11 = 0 OR n % 5 NOT IN (SELECT n % 4 FROM s))""",
    "q1_brief": _brief_sql(6000) + " WHERE project = 'p3'",
    "q5_read_session": """WITH t AS (SELECT DISTINCT conv_id AS session_id FROM conversations), w AS (SELECT session_id FROM t UNION SELECT user_id FROM events),
n AS (SELECT conv_id AS session_id, arg_min(text, turn) AS text FROM conversations WHERE conv_id % 2 = 0 GROUP BY 1)
SELECT w.session_id, coalesce(n.text, CASE WHEN t.session_id IS NULL THEN 'unknown session' ELSE 'no note: ' || CASE WHEN t.session_id % 4 = 1 THEN 'empty' ELSE 'ok' END END) AS text FROM w LEFT JOIN t USING (session_id) LEFT JOIN n USING (session_id)""",
}
