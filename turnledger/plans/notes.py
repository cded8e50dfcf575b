"""Notes and replies made of the event log, read back as tables; subjects as documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts as questions
from ..operators import search
from ..sources import notes as src
from . import texts
from .memory import CLAIMS_SQL, claims, fold_sql, folded


def _notes(spark, sf_dir):
    """One note for each event, some with Windows line ends, some without a trailer or a session."""
    c = claims(spark, sf_dir).withColumn("n", F.col("session_id").cast("long"))
    fact = F.struct("subject", F.col("subject_kind").alias("subjectKind"), "key", "claim", "confidence")
    gone = F.struct("subject", F.col("subject_kind").alias("subjectKind"), "key", F.lit("old words").alias("claim"), F.lit(0.8).alias("confidence"), F.col("date").alias("createdAt"), F.col("date").alias("retractedAt"), F.lit("why").alias("reason"))
    link = F.struct(F.col("subject").alias("from"), F.col("key").alias("to"), F.lit("uses").alias("relation"))
    some = lambda test, x: F.when(F.expr(test), F.array(x)).otherwise(F.slice(F.array(x), 1, 0))
    trailer = F.struct(some("true", fact).alias("facts"), some("n % 4 = 0", link).alias("links"), F.lit("p").alias("project"), some("n % 3 = 0", gone).alias("retracted"), F.lit(None).cast("string").alias("distilled"))
    rows = c.select("n", F.concat(F.lit("chat:"), "session_id").alias("session_id"), F.lit("chat").alias("agent"), F.lit("p").alias("project"), "date", F.lit("model").alias("extractor"), F.concat(F.lit("On "), "key").alias("title"), F.lit("What was said: a lot.").alias("summary"), F.array("claim").alias("did"), trailer.alias("trailer"))
    docs = src.rendered(rows.drop("n"))
    n = F.regexp_extract("md", "session: chat:([0-9]+)", 1).cast("long")
    md = F.when(n % 7 == 0, F.regexp_replace("md", "\n", "\r\n")).when(n % 7 == 1, F.substring_index("md", src.OPEN, 1)).when(n % 7 == 2, F.regexp_replace("md", "session: ", "sitting: ")).otherwise(F.col("md"))
    return docs.select("path", md.alias("md"))


def s6_notes(spark, sf_dir):
    n = src.parse_notes(_notes(spark, sf_dir))
    return n.select("session_id", "date", "project", "prose", F.coalesce(F.size("trailer.facts"), F.lit(-1)).alias("facts"))


def s6_claims(spark, sf_dir):
    """Notes are read once for all three kinds."""
    return src.said(src.parse_notes(_notes(spark, sf_dir))).select("session_id", "kind", "subject", "key", "claim")


def _replies(spark, sf_dir):
    """Replies as models give them: clean, fenced, with prose on both sides, odd values, cut off, without JSON."""
    c = claims(spark, sf_dir).withColumn("n", F.col("session_id").cast("long"))
    d = F.col("n") % 9
    fact = lambda subject, claim, confidence: F.concat(F.lit('{"subject":'), subject, F.lit(',"key":"'), "key", F.lit('"'), claim, F.lit(',"confidence":'), confidence, F.lit("}"))
    name, said, sure = F.concat(F.lit('"'), "subject", F.lit('"')), F.concat(F.lit(',"claim":"'), "claim", F.lit('"')), F.col("confidence").cast("string")
    one = F.when(d == 3, fact(F.col("n").cast("string"), said, F.concat(F.lit('"'), sure, F.lit('"')))).when(d == 4, fact(name, F.lit(""), sure)).when(d == 5, fact(name, said, F.lit("1.5"))).otherwise(fact(name, said, sure))
    body = F.concat(F.lit('{"title":'), F.when(d == 6, F.lit("7")).otherwise('" "'), F.lit(',"summary":"All is { well. Or so","did":["a",{"b":1},3," "],"facts":['), one, F.lit("]}"))
    reply = F.when(d == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(d == 2, F.concat(F.lit("Sure: "), body, F.lit(" and {more} to come"))).when(d == 7, F.substring(body, 1, 60)).when(d == 8, F.lit("nothing to report")).otherwise(body)
    return c.select("session_id", reply.alias("reply"))


def s7_replies(spark, sf_dir):
    notes, _ = src.parse_replies(_replies(spark, sf_dir))
    f = F.get("facts", F.lit(0))
    return notes.select("session_id", "status", "title", F.array_join("did", ",").alias("did"), F.coalesce(f["subject"], F.lit("")).alias("subject"), F.coalesce(f["claim"], F.lit("")).alias("claim"), F.coalesce(f["confidence"], F.lit(-1.0)).alias("confidence"))


def s7_rejects(spark, sf_dir):
    return src.parse_replies(_replies(spark, sf_dir))[1].groupBy("session_id", "field").agg(F.count(F.lit(1)).alias("items"))


def k2_subject_lines(spark, sf_dir):
    """The lines of each subject's document."""
    return questions.subject_lines(folded(spark, sf_dir).facts)


def k4_changed(spark, sf_dir):
    """Of the notes every fifth read otherwise before and every sixth is new."""
    docs = _notes(spark, sf_dir)
    n = F.regexp_extract("path", r"-([0-9]+)\.md$", 1).cast("long")
    return src.changed_docs(docs, docs.filter(n % 6 > 0).withColumn("md", F.when(n % 5 == 0, "other").otherwise(F.col("md")))).select("path")


def x3_search(spark, sf_dir):
    """One query over one project's documents, with snippets."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("lang").alias("project"), "text")
    index = search.build_index(docs.filter("text IS NOT NULL"))
    return search.search(index, "the licensed token", 20, docs.filter("text IS NOT NULL"), "en").select("doc_id", "rank", (F.size(F.split("snippet", " ")) <= 14).alias("short"))


QUERIES = {f.__name__: f for f in (s6_notes, s6_claims, s7_replies, s7_rejects, k2_subject_lines, k4_changed, x3_search)}

_C9 = f"WITH c AS (SELECT *, CAST(session_id AS BIGINT) AS n FROM ({CLAIMS_SQL}))"

SQL = {
    "s6_notes": _C9 + " SELECT 'chat:' || session_id AS session_id, date, 'p' AS project, '# On ' || key || chr(10) || chr(10) || 'What was said: a lot.' || chr(10) || chr(10) || '## عملنا' || chr(10) || '- ' || claim AS prose, CASE WHEN n % 7 = 1 THEN -1 ELSE 1 END AS facts FROM c WHERE n % 7 <> 2",
    "s6_claims": _C9 + """, d AS (SELECT *, 'chat:' || session_id AS sid FROM c WHERE n % 7 NOT IN (1, 2)) SELECT sid AS session_id, 'claim' AS kind, subject, key, claim FROM d
UNION ALL SELECT sid, 'withdrawal', subject, key, 'old words' FROM d WHERE n % 3 = 0 UNION ALL SELECT sid, 'link', subject, key, 'uses' FROM d WHERE n % 4 = 0""",
    "s7_replies": _C9 + """, d AS (SELECT *, n % 9 AS d, n % 9 NOT IN (4, 5, 7, 8) AS has FROM c)
SELECT session_id, CASE d WHEN 7 THEN 'unreadable' WHEN 8 THEN 'no-json' ELSE 'ok' END AS status, CASE WHEN d IN (7, 8) THEN 'جلسة بلا عنوان' WHEN d = 6 THEN '7' ELSE 'All is { well' END AS title, CASE WHEN d IN (7, 8) THEN '' ELSE 'a,3' END AS did,
  CASE WHEN NOT has THEN '' WHEN d = 3 THEN CAST(n AS VARCHAR) ELSE subject END AS subject, CASE WHEN has THEN claim ELSE '' END AS claim, CASE WHEN has THEN confidence ELSE -1.0 END AS confidence FROM d""",
    "s7_rejects": _C9 + " SELECT session_id, 'facts' AS field, 1 AS items FROM c WHERE n % 9 IN (4, 5) UNION ALL SELECT session_id, 'did', 2 FROM c WHERE n % 9 < 7",
    "k4_changed": _C9 + " SELECT 'sessions/' || date[:4] || '/' || date[6:7] || '/' || date[:10] || '-chat-' || session_id[:8] || '.md' AS path FROM c WHERE CAST(session_id[:8] AS BIGINT) % 6 = 0 OR CAST(session_id[:8] AS BIGINT) % 5 = 0",
    "k2_subject_lines": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql('k')}, x AS (SELECT *, lead(claim) OVER (PARTITION BY subject, key ORDER BY created_at, session_id) AS later FROM facts)
SELECT subject, CASE WHEN superseded_at IS NULL THEN 1 ELSE 2 END AS section, CASE WHEN superseded_at IS NULL THEN '- **' || key || '** — ' || claim || '  <sub>' || created_at[:10] || ' · ' || session_id || '</sub>'
  ELSE '- ~~**' || key || '** — ' || claim || '~~ → ' || later || '  <sub>حتى ' || superseded_at[:10] || '</sub>' END AS text FROM x""",
}

_QUERY = "SELECT 0 AS query_id, unnest(['the', 'licensed', 'token']) AS word"
SQL["x3_search"] = (
    texts.SQL["x4_search"].replace("documents", "(SELECT * FROM documents WHERE lang = 'en' AND text IS NOT NULL)").replace(texts.SQL["x4_search"].split("q AS (")[1].split("),\nh AS")[0], _QUERY)
    .replace("rank <= 10", "rank <= 20").replace("SELECT query_id, doc_id, rank FROM", "SELECT doc_id, rank, true AS short FROM")
)
