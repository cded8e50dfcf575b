"""Audits: near keys over the parts table, stale facts and waits over the event log, and both reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as ops
from ..operators import facts as questions
from ..operators import subjects as names
from . import subjects as subject_plans
from .memory import CLAIMS_SQL, claims, fold_sql, folded

NOW, DAYS, WAIT_DAYS = "2024-02-05T00:00:00", 20, 12


def near_facts(spark, sf_dir):
    """Brands as subjects; a part's name makes its key in five ways, its name, type and price its claim."""
    n, words = F.col("p_partkey"), F.split("p_name", " ")
    a, b = words[0], words[1]
    key = (
        F.when(n % 5 == 0, F.concat(F.lit("arch."), a, F.lit("-"), b)).when(n % 5 == 1, F.concat(F.lit("arch."), a, F.lit("_"), b, F.lit("s"))).when(n % 5 == 2, F.concat(F.lit("arch."), b))
        .when(n % 5 == 3, F.concat(F.lit("decision."), b, F.lit("."), a)).otherwise(F.concat(F.lit("gotcha"), (F.col("p_size") % 10).cast("string"), F.lit(".part"), n.cast("string")))
    )
    claim = F.concat_ws(" ", "p_name", F.lower("p_type"), F.lit("size"), F.concat(F.lit("number"), F.col("p_size").cast("string")), F.concat(F.lit("price"), (n % 40).cast("string")))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    none = F.lit(None).cast("string")
    return p.select(F.col("p_brand").alias("subject"), F.lit("term").alias("subject_kind"), key.alias("key"), claim.alias("claim"), F.lit(0.9).alias("confidence"), n.cast("string").alias("session_id"), n.alias("seq"), F.lit("d").alias("created_at"), none.alias("superseded_at"), none.alias("retracted_at"))


def j7_near_keys(spark, sf_dir):
    return ops.near_keys(near_facts(spark, sf_dir))


def sessions(spark, sf_dir):
    k, n = F.get_json_object("props", "$.k").cast("int"), F.col("event_id")
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    status = F.when(k % 5 == 0, "pending-extraction").when(k % 7 == 0, "quarantined").when(k % 11 == 0, "empty").otherwise("ok")
    return e.select(n.cast("string").alias("session_id"), F.concat(F.lit("p"), (F.col("user_id") % 10).cast("string")).alias("project"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("at"), status.alias("status"), F.col("event_type").alias("agent"), F.concat(F.lit("f"), n.cast("string")).alias("source_file"))


def files(spark, sf_dir):
    """Every third transcript is gone."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").filter("event_id % 3 > 0").select(F.concat(F.lit("f"), F.col("event_id").cast("string")).alias("path"))


def a16_stale(spark, sf_dir):
    """Claims of odd events are the only ones that notes still make."""
    said = claims(spark, sf_dir).filter("cast(session_id as long) % 2 = 1")
    return ops.stale(folded(spark, sf_dir).facts, said, sessions(spark, sf_dir), NOW, DAYS)


def j9_gone(spark, sf_dir):
    return ops.gone(sessions(spark, sf_dir), files(spark, sf_dir)).select("session_id", "source_file")


def a17_stale_pending(spark, sf_dir):
    waits, lost = ops.stale_pending(sessions(spark, sf_dir), files(spark, sf_dir), NOW, WAIT_DAYS)
    return waits.select(F.lit("waiting").alias("section"), "session_id", "age").unionByName(lost.select(F.lit("gone").alias("section"), "session_id", "age"))


def d8_audit(spark, sf_dir):
    """All checks in one table: the parts' near keys, rejected subjects and undefined tools, the log's orphans, stale facts and waits."""
    folded_, s, f = folded(spark, sf_dir), sessions(spark, sf_dir), files(spark, sf_dir)
    said = claims(spark, sf_dir).filter("cast(session_id as long) % 2 = 1")
    part_facts, part_sessions = subject_plans._facts(spark, sf_dir)
    waits, lost = ops.stale_pending(s, f, NOW, WAIT_DAYS)
    slot = F.concat_ws(".", "subject", "key")
    defined = spark.createDataFrame([("Brand#1", "what it is"), ("Brand#2", " ")], "subject string, definition string")
    parts = {
        "orphans": questions.orphans(folded_.facts, said).select(slot.alias("item"), F.col("why").alias("detail")),
        "near": ops.near_keys(near_facts(spark, sf_dir)).select(F.concat_ws(".", "subject", "key", "other").alias("item"), F.col("why").alias("detail")),
        "rejected": names.rejected_subjects(part_facts, part_sessions, subject_plans._folders(spark)).select(F.concat_ws(".", "subject", "project").alias("item"), F.col("why").alias("detail")),
        "undefined": names.undefined_tools(part_facts, part_sessions, defined).select(F.col("subject").alias("item"), F.col("facts").alias("detail")),
        "stale": ops.stale(folded_.facts, said, s, NOW, DAYS).select(slot.alias("item"), F.col("age").alias("detail")),
        "pending": waits.select(F.col("session_id").alias("item"), F.col("age").alias("detail")),
        "gone": lost.select(F.col("session_id").alias("item"), F.col("source_file").alias("detail")),
    }
    return ops.report(parts, {"sessions": s, "notes": said.select("session_id").distinct(), "subjects": ops.live_subjects(folded_.facts)})


def d10_health(spark, sf_dir):
    """Sources by agent, users read too often, transcripts gone, subjects the guard rejects, tools without a definition."""
    s = sessions(spark, sf_dir)
    part_facts, part_sessions = subject_plans._facts(spark, sf_dir)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    readings = e.select(F.col("user_id").cast("string").alias("note"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "scan").otherwise("other").alias("kind"))
    defined = spark.createDataFrame([("Brand#1", "what it is"), ("Brand#2", " ")], "subject string, definition string")
    return ops.report({
        "sources": s.groupBy(F.col("agent").alias("item")).agg(F.count(F.lit(1)).alias("detail")),
        "rereads": questions.rereads(readings).select(F.col("note").alias("item"), F.col("readings").alias("detail")),
        "gone": ops.gone(s, files(spark, sf_dir)).groupBy(F.col("agent").alias("item")).agg(F.count(F.lit(1)).alias("detail")),
        "rejected": names.rejected_subjects(part_facts, part_sessions, subject_plans._folders(spark)).groupBy(F.col("why").alias("item")).agg(F.count(F.lit(1)).alias("detail")),
        "undefined": names.undefined_tools(part_facts, part_sessions, defined).select(F.col("subject").alias("item"), F.col("projects").alias("detail")),
    }, {})


def w10_inbox(spark, sf_dir):
    return questions.inbox(folded(spark, sf_dir).pending, sessions(spark, sf_dir), files(spark, sf_dir))


def a7_vault(spark, sf_dir):
    """All of the statistics, with sessions by status and links."""
    from .memory import a14_links

    out = folded(spark, sf_dir)
    return questions.stats(out.facts, out.pending, sessions(spark, sf_dir), a14_links(spark, sf_dir))


def q3_near_names(spark, sf_dir):
    """Which brands a name stands for that is none: the first words of the parts' subjects."""
    brands = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_brand").alias("subject")).distinct()
    asked = brands.select(F.concat(F.lower("subject"), F.lit("1")).alias("name")).unionByName(brands.select(F.upper("subject").alias("name")))
    return questions.near_names(brands, asked)


QUERIES = {f.__name__: f for f in (j7_near_keys, a16_stale, j9_gone, a17_stale_pending, d8_audit, d10_health, w10_inbox, a7_vault, q3_near_names)}

_FORMS = "list_concat([{0}], list_concat(CASE WHEN length({0}) > 3 AND {0} LIKE '%s' AND {0} NOT LIKE '%ss' THEN [{0}[:-2]] ELSE [] END, CASE WHEN length({0}) > 4 AND {0} LIKE '%ies' THEN [{0}[:-4] || 'y'] ELSE [] END))"
_NEAR = f"""n AS (SELECT p_brand AS subject, p_partkey AS seq, string_split(p_name, ' ')[1] AS a, string_split(p_name, ' ')[2] AS b, p_name || ' ' || lower(p_type) || ' size number' || p_size || ' price' || (p_partkey % 40) AS claim, p_size FROM part),
nk AS (SELECT subject, key, arg_max(claim, seq) AS claim FROM (SELECT *, CASE seq % 5 WHEN 0 THEN 'arch.' || a || '-' || b WHEN 1 THEN 'arch.' || a || '_' || b || 's' WHEN 2 THEN 'arch.' || b WHEN 3 THEN 'decision.' || b || '.' || a ELSE 'gotcha' || (p_size % 10) || '.part' || seq END AS key FROM n) GROUP BY 1, 2),
nw AS (SELECT subject, key, string_split(key, '.')[1] AS prefix, list_sort(list_distinct(regexp_split_to_array(key[instr(key, '.') + 1:], '[^a-z0-9]+'))) AS ws,
  regexp_split_to_array(replace(key, '.', '-.-'), '[-_]') AS parts, list_distinct(list_filter(regexp_split_to_array(claim, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 4)) AS said FROM nk),
np AS (SELECT x.subject, x.key, y.key AS other, len(list_intersect(x.said, y.said)) AS shared, CASE
  WHEN len(x.parts) = len(y.parts) AND len(list_filter(list_zip(x.parts, y.parts), lambda z: NOT list_has_any({_FORMS.format("z[1]")}, {_FORMS.format("z[2]")}))) = 0 THEN 'same-key'
  WHEN x.prefix = y.prefix AND x.ws <> y.ws AND (list_has_all(x.ws, y.ws) OR list_has_all(y.ws, x.ws)) THEN 'key-subset'
  WHEN x.prefix <> y.prefix AND x.ws = y.ws THEN 'key-same-noun'
  WHEN len(list_intersect(x.said, y.said)) >= 4 AND 3 * len(list_intersect(x.said, y.said)) >= least(len(x.said), len(y.said)) THEN 'claim-overlap' END AS why
  FROM nw x JOIN nw y ON x.subject = y.subject AND x.key < y.key)"""
_ST = """st AS (SELECT CAST(event_id AS VARCHAR) AS session_id, event_id, 'p' || (user_id % 10) AS project, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS "at", event_type AS agent, 'f' || event_id AS source_file,
  CASE WHEN k % 5 = 0 THEN 'pending-extraction' WHEN k % 7 = 0 THEN 'quarantined' WHEN k % 11 = 0 THEN 'empty' ELSE 'ok' END AS status FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""
_AGE = f"CAST(floor((epoch_ms(TIMESTAMP '{NOW}') - epoch_ms({{}})) / 86400000.0) AS BIGINT)"
_STALE = f"""{_ST}, nowrows AS (SELECT arg_max(claim, created_at) AS claim, max(created_at) AS created_at, subject, key FROM facts WHERE superseded_at IS NULL AND confidence < 1 GROUP BY subject, key),
lastsaid AS (SELECT subject, key, max(date) AS said FROM k WHERE CAST(session_id AS BIGINT) % 2 = 1 GROUP BY 1, 2), pl AS (SELECT project, max("at") AS pl FROM st WHERE status = 'ok' GROUP BY 1),
sp AS (SELECT subject, max(pl) AS pl, arg_max(project, (pl, project)) AS project FROM (SELECT DISTINCT subject, project FROM facts JOIN st USING (session_id)) JOIN pl USING (project) GROUP BY 1),
sta AS (SELECT * FROM (SELECT subject, key, claim, coalesce(said, created_at) AS last_seen, {_AGE.format("CAST(coalesce(said, created_at) AS TIMESTAMP)")} AS age, project, {_AGE.format("CAST(pl AS TIMESTAMP)")} AS project_age
  FROM nowrows LEFT JOIN lastsaid USING (subject, key) JOIN sp USING (subject)) WHERE age >= {DAYS} AND project_age <= {DAYS})"""
_WAITS = f"""wts AS (SELECT CASE WHEN event_id % 3 > 0 THEN 'waiting' ELSE 'gone' END AS section, session_id, source_file, agent, {_AGE.format("ts")} AS age FROM st WHERE status = 'pending-extraction')"""
_SUBJECTS = subject_plans._J8.removeprefix("WITH ")
_REJ = subject_plans.SQL["j8_rejected"].removeprefix(subject_plans._J8)
_UND = subject_plans.SQL["j8_undefined"].removeprefix(subject_plans._J8)
_FACTS = f"{fold_sql('k')}"

SQL = {
    "j7_near_keys": f"WITH {_NEAR} SELECT subject, key, other, why, CAST(CASE WHEN why = 'claim-overlap' THEN shared ELSE 0 END AS BIGINT) AS shared FROM np WHERE why IS NOT NULL",
    "a16_stale": f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {_FACTS}, {_STALE} SELECT * FROM sta",
    "j9_gone": f"WITH {_ST} SELECT session_id, source_file FROM st WHERE event_id % 3 = 0",
    "a17_stale_pending": f"WITH {_ST}, {_WAITS} SELECT section, session_id, age FROM wts WHERE section = 'gone' OR age >= {WAIT_DAYS}",
    "d8_audit": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {_FACTS}, {_STALE}, {_WAITS}, {_NEAR}, {_SUBJECTS}, rej AS (SELECT * FROM ({"WITH g" + _REJ.removeprefix(", g")})), und AS ({_UND})
SELECT 'orphans' AS section, subject || '.' || key AS item, 'no-note' AS detail FROM facts WHERE superseded_at IS NULL AND CAST(session_id AS BIGINT) % 2 = 0
UNION ALL SELECT 'near', subject || '.' || key || '.' || other, why FROM np WHERE why IS NOT NULL
UNION ALL SELECT 'rejected', subject || '.' || project, why FROM rej UNION ALL SELECT 'undefined', subject, CAST(facts AS VARCHAR) FROM und
UNION ALL SELECT 'stale', subject || '.' || key, CAST(age AS VARCHAR) FROM sta
UNION ALL SELECT 'pending', session_id, CAST(age AS VARCHAR) FROM wts WHERE section = 'waiting' AND age >= {WAIT_DAYS} UNION ALL SELECT 'gone', session_id, source_file FROM wts WHERE section = 'gone'
UNION ALL SELECT 'scanned', 'sessions', CAST(count(*) AS VARCHAR) FROM st UNION ALL SELECT 'scanned', 'notes', CAST(count(*) AS VARCHAR) FROM k WHERE CAST(session_id AS BIGINT) % 2 = 1
UNION ALL SELECT 'scanned', 'subjects', CAST(count(DISTINCT subject) AS VARCHAR) FROM facts WHERE superseded_at IS NULL""",
    "d10_health": f"""WITH {_ST}, {_SUBJECTS}, rej AS (SELECT * FROM ({"WITH g" + _REJ.removeprefix(", g")})), und AS ({_UND})
SELECT 'sources' AS section, agent AS item, CAST(count(*) AS VARCHAR) AS detail FROM st GROUP BY 2
UNION ALL SELECT 'rereads', CAST(user_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id HAVING count(*) > 3
UNION ALL SELECT 'gone', agent, CAST(count(*) AS VARCHAR) FROM st WHERE event_id % 3 = 0 GROUP BY 2
UNION ALL SELECT 'rejected', why, CAST(count(*) AS VARCHAR) FROM rej GROUP BY 2 UNION ALL SELECT 'undefined', subject, projects FROM und""",
    "w10_inbox": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {_FACTS}, {_ST}, {_WAITS} SELECT 'pending' AS section, regexp_replace(reason, ':.*', '') AS provider, count(*) AS entries FROM pending GROUP BY 2
UNION ALL SELECT section, agent, count(*) FROM wts GROUP BY 1, 2""",
    "a7_vault": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {_FACTS}, {_ST}, l AS (SELECT 'u' || user_id AS p, 'u' || (user_id * 7 % 50) AS q, event_type AS relation FROM events)
SELECT count(*) FILTER (superseded_at IS NULL) AS live, count(*) FILTER (superseded_at IS NOT NULL) AS superseded, CAST(0 AS BIGINT) AS retracted, count(DISTINCT subject) FILTER (superseded_at IS NULL) AS subjects, (SELECT count(*) FROM pending) AS waiting,
  {", ".join(f"(SELECT count(*) FROM st WHERE status = '{a}') AS {b}" for a, b in (("ok", "read"), ("pending-extraction", "pending_sessions"), ("quarantined", "quarantined"), ("empty", "empty"), ("skipped", "skipped")))},
  (SELECT count(*) FROM (SELECT DISTINCT least(p, q), greatest(p, q), relation FROM l WHERE p <> q)) AS links FROM facts""",
    "q3_near_names": """WITH b AS (SELECT DISTINCT p_brand AS subject FROM part), n AS (SELECT lower(subject) || '1' AS name FROM b UNION SELECT upper(subject) FROM b)
SELECT name, subject FROM n JOIN b ON contains(lower(subject), lower(name)) OR contains(lower(name), lower(subject)) WHERE name NOT IN (SELECT subject FROM b)""",
}
