"""Claims, facts and the queue over the event log: a user is a subject, an event type a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import decide
from ..operators import facts as ops
from ..operators import reconcile as fold


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"),
        F.lit("person").alias("subject_kind"),
        F.col("event_type").alias("key"),
        F.concat("event_type", F.lit(" value is "), F.floor(F.col("value") * 100).cast("string")).alias("claim"),
        F.when(k >= 60, 0.95).when(k >= 30, 0.85).otherwise(0.6).alias("confidence"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"),
        F.col("event_id").cast("string").alias("session_id"),
        F.lit(0).cast("long").alias("ord"),
    )


def folded(spark: SparkSession, sf_dir: str) -> fold.Folded:
    return fold.replay(fold.events(claims(spark, sf_dir)))


CLAIMS_SQL = """SELECT 'u' || user_id AS subject, event_type AS key, event_type || ' value is ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR) AS claim,
    CAST(CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 60 THEN 0.95 WHEN CAST(json_extract_string(props, '$.k') AS INT) >= 30 THEN 0.85 ELSE 0.6 END AS DOUBLE) AS confidence,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS date, CAST(event_id AS VARCHAR) AS session_id FROM events"""


def fold_sql(source: str, p: str = "", where: str = "true") -> str:
    """The fold as common table expressions {p}c, {p}f, {p}facts, {p}pending over claims of one key a slot: no twins under other keys,
    no withdrawals."""
    return f"""{p}c AS (SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY date, session_id) AS rn FROM {source} WHERE {where}),
{p}f AS (
  SELECT {p}c.*, CASE WHEN confidence >= 0.75 THEN 'added' ELSE 'queued' END AS outcome,
    CASE WHEN confidence >= 0.75 THEN claim END AS held, CASE WHEN confidence >= 0.75 THEN confidence END AS held_conf,
    CAST('below-confidence-floor' AS VARCHAR) AS why
  FROM {p}c WHERE rn = 1
  UNION ALL
  SELECT s.subject, s.key, s.claim, s.confidence, s.date, s.session_id, s.rn, s.outcome,
    CASE WHEN s.outcome IN ('added', 'superseded') THEN s.claim ELSE s.held END,
    CASE WHEN s.outcome IN ('added', 'superseded') THEN s.confidence ELSE s.held_conf END,
    CASE WHEN s.held IS NULL THEN 'below-confidence-floor' ELSE 'conflicts-with:' || s.held[:120] END
  FROM (
    SELECT c.*, f.held, f.held_conf,
      CASE WHEN f.held IS NULL THEN CASE WHEN c.confidence >= 0.75 THEN 'added' ELSE 'queued' END
        WHEN c.claim = f.held OR (length(c.claim) > 12 AND length(f.held) > 12 AND (contains(c.claim, f.held) OR contains(f.held, c.claim))) THEN 'unchanged'
        WHEN c.confidence >= 0.75 AND c.confidence >= f.held_conf - CAST(0.1 AS DOUBLE) THEN 'superseded' ELSE 'queued' END AS outcome
    FROM {p}f f JOIN {p}c c ON c.subject = f.subject AND c.key = f.key AND c.rn = f.rn + 1
  ) s
), {p}facts AS (
  SELECT subject, key, claim, confidence, session_id, date AS created_at, lead(date) OVER (PARTITION BY subject, key ORDER BY rn) AS superseded_at
  FROM {p}f WHERE outcome IN ('added', 'superseded')
), {p}pending AS (SELECT subject, key, claim, confidence, session_id, date AS created_at, why AS reason FROM {p}f WHERE outcome = 'queued')
"""


_C = f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql('k')}"

#: Of notes with k % 10 = 7: the user's claim of this kind before is withdrawn by the note itself, with 3 by a note of the same date that
#: says nothing else.
WITHDRAWALS_SQL = """w AS (SELECT * FROM (
  SELECT 'u' || user_id AS subject, event_type AS key, lag(event_type || ' value is ' || CAST(CAST(floor(value * 100) AS BIGINT) AS VARCHAR)) OVER o AS claim, CAST(0.9 AS DOUBLE) AS confidence,
    strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS date, CAST(event_id AS VARCHAR) || CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) % 10 = 3 THEN 'w' ELSE '' END AS session_id, CAST(json_extract_string(props, '$.k') AS INT) % 10 AS d
  FROM events WINDOW o AS (PARTITION BY user_id, event_type ORDER BY ts, CAST(event_id AS VARCHAR))) WHERE claim IS NOT NULL AND d IN (3, 7)),
v AS (SELECT subject, key, claim, confidence, date, session_id, 1 AS kind FROM k UNION ALL SELECT subject, key, claim, confidence, date, session_id, 0 FROM w),
e AS (SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY date, session_id, kind) AS rn FROM v),
s AS (
  SELECT subject, key, CAST(0 AS BIGINT) AS rn, CAST(NULL AS VARCHAR) AS held, CAST(NULL AS DOUBLE) AS held_conf, CAST(NULL AS BIGINT) AS held_rn, CAST('none' AS VARCHAR) AS outcome, CAST(NULL AS BIGINT) AS ends
  FROM (SELECT DISTINCT subject, key FROM e)
  UNION ALL
  SELECT subject, key, rn,
    CASE outcome WHEN 'took' THEN claim WHEN 'withdrew-held' THEN NULL WHEN 'withdrawn-over' THEN NULL ELSE held END,
    CASE outcome WHEN 'took' THEN confidence WHEN 'withdrew-held' THEN NULL WHEN 'withdrawn-over' THEN NULL ELSE held_conf END,
    CASE outcome WHEN 'took' THEN rn WHEN 'withdrew-held' THEN NULL WHEN 'withdrawn-over' THEN NULL ELSE held_rn END,
    outcome, CASE WHEN outcome IN ('took', 'withdrew-held', 'withdrawn-over') THEN held_rn END
  FROM (
    SELECT e.*, s.held, s.held_conf, s.held_rn, CASE
      WHEN kind = 0 AND held IS NOT NULL AND same THEN 'withdrew-held'
      WHEN kind = 0 AND held IS NOT NULL AND e.confidence >= 0.75 AND e.confidence >= held_conf - CAST(0.1 AS DOUBLE) THEN 'withdrawn-over'
      WHEN kind = 0 THEN 'withdrawn-new'
      WHEN held IS NULL THEN CASE WHEN e.confidence >= 0.75 THEN 'took' ELSE 'queued' END
      WHEN same THEN 'unchanged'
      WHEN e.confidence >= 0.75 AND e.confidence >= held_conf - CAST(0.1 AS DOUBLE) THEN 'took' ELSE 'queued' END AS outcome
    FROM s JOIN e ON e.subject = s.subject AND e.key = s.key AND e.rn = s.rn + 1,
      LATERAL (SELECT e.claim = held OR (length(e.claim) > 12 AND length(held) > 12 AND (contains(e.claim, held) OR contains(held, e.claim))) AS same)
  )
),
made AS (SELECT e.*, s.outcome FROM s JOIN e USING (subject, key, rn) WHERE s.outcome IN ('took', 'withdrawn-new', 'withdrawn-over')),
ended AS (SELECT s.subject, s.key, s.ends AS rn, s.outcome AS how, e.date AS ended_at, e.session_id AS ended_by FROM s JOIN e USING (subject, key, rn) WHERE s.ends IS NOT NULL),
took AS (SELECT subject, key, date, session_id FROM made WHERE outcome = 'took'),
history AS (
  SELECT m.subject, m.key, m.claim, m.confidence, m.session_id,
    -- what a note withdrew from a slot that its own claim then took was replaced
    CASE WHEN m.kind = 0 THEN CASE WHEN r.session_id IS NULL THEN 'retracted' ELSE 'superseded' END
      WHEN x.how IS NULL THEN 'live' WHEN x.how = 'withdrew-held' AND q.session_id IS NULL THEN 'retracted' ELSE 'superseded' END AS state
  FROM made m LEFT JOIN ended x USING (subject, key, rn)
  LEFT JOIN took r ON m.kind = 0 AND r.subject = m.subject AND r.key = m.key AND r.date = m.date AND r.session_id = m.session_id
  LEFT JOIN took q ON q.subject = m.subject AND q.key = m.key AND q.date = x.ended_at AND q.session_id = x.ended_by
)"""


def a1_reconcile_outcomes(spark, sf_dir):
    return folded(spark, sf_dir).outcomes.select("subject", "key", "session_id", "claim", "outcome")


def a1_facts(spark, sf_dir):
    return folded(spark, sf_dir).facts.select("subject", "key", "claim", "confidence", "session_id", "created_at", "superseded_at")


def a1_pending(spark, sf_dir):
    return folded(spark, sf_dir).pending.drop("subject_kind")


def w2_current(spark, sf_dir):
    return fold.current(folded(spark, sf_dir).facts).select("subject", "key", "claim", "confidence", "session_id")


def w3_history(spark, sf_dir):
    return fold.history(folded(spark, sf_dir).facts).select("subject", "key", "claim", "created_at", "state", "until")


def a7_stats(spark, sf_dir):
    out = folded(spark, sf_dir)
    return ops.stats(out.facts, out.pending)


def a8_subjects(spark, sf_dir):
    return ops.subjects(folded(spark, sf_dir).facts)


def a9_waiting(spark, sf_dir):
    return ops.waiting(folded(spark, sf_dir).pending)


def a15_known_keys(spark, sf_dir):
    return ops.known_keys(folded(spark, sf_dir).facts).select("subject", "key", "first_seen")


def j3_facts_as_of(spark, sf_dir):
    """What each user's log held when each of their errors happened."""
    log = claims(spark, sf_dir)
    probes = log.filter("key = 'error'").select("subject", F.col("date"), F.col("session_id").alias("probe"))
    return fold.facts_as_of(folded(spark, sf_dir).facts, probes).select("probe", "subject", "key", "claim")


def _laid(spark, sf_dir):
    """A replay of all claims laid onto memory that knew every second event."""
    log = claims(spark, sf_dir)
    new, old = fold.replay(fold.events(log)).facts, fold.replay(fold.events(log.filter("cast(session_id as long) % 2 = 0"))).facts
    return decide.changes_of(decide.lay_onto(new, old, "2030-01-01"))


def j5_pairing(spark, sf_dir):
    return _laid(spark, sf_dir).groupBy("change").agg(F.count(F.lit(1)).alias("rows"))


def j5_changes(spark, sf_dir):
    """The rows behind j5_pairing."""
    return _laid(spark, sf_dir).select("session_id", "subject", "key", "change")


def withdrawals(spark, sf_dir):
    """See WITHDRAWALS_SQL."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    d = F.get_json_object("props", "$.k").cast("int") % 10
    said = F.concat("event_type", F.lit(" value is "), F.floor(F.col("value") * 100).cast("string"))
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", F.col("event_id").cast("string"))
    date = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("subject"), F.lit("person").alias("subject_kind"), F.col("event_type").alias("key"), F.lag(said).over(order).alias("claim"),
        F.lit(0.9).alias("confidence"), date.alias("date"), F.concat(F.col("event_id").cast("string"), F.when(d == 3, "w").otherwise("")).alias("session_id"), F.lit(0).cast("long").alias("ord"),
        date.alias("created_at"), date.alias("retracted_at"), d.alias("d"),
    )
    return rows.filter("claim IS NOT NULL AND d IN (3, 7)").drop("d")


def a2_withdrawals(spark, sf_dir):
    """The state of every fact where notes withdraw earlier wordings, some of them to replace them."""
    facts = fold.replay(fold.events(claims(spark, sf_dir), withdrawals(spark, sf_dir))).facts
    return fold.history(facts).select("subject", "key", "claim", "confidence", "session_id", "state")


def a3_replaced(spark, sf_dir):
    """Facts by state, with withdrawals."""
    facts = fold.replay(fold.events(claims(spark, sf_dir), withdrawals(spark, sf_dir))).facts
    return fold.history(facts).groupBy("subject", "state").agg(F.count(F.lit(1)).alias("facts"))


def a14_links(spark, sf_dir):
    """Every user linked with one other, by kind of event; the first event names the link."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    links = e.select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("a"), F.concat(F.lit("u"), (F.col("user_id") * 7 % 50).cast("string")).alias("b"),
        F.col("event_type").alias("relation"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("date"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("session_id"),
    )
    return ops.link_set(links)


def a10_usage(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.groupBy(F.col("event_type").alias("provider")).agg(F.count(F.lit(1)).alias("calls"), F.sum(F.get_json_object("props", "$.k").cast("long")).alias("tokens"), F.count_distinct("user_id").alias("users"))


def a11_rereads(spark, sf_dir):
    """Users with more than three errors in the log's last seven days."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    last = e.agg(F.max("ts").alias("now"))
    recent = e.filter("event_type = 'error'").crossJoin(F.broadcast(last)).filter(F.col("ts") > F.col("now") - F.expr("INTERVAL 7 DAYS"))  # one row
    return recent.groupBy("user_id").agg(F.count(F.lit(1)).alias("readings")).filter("readings > 3")


def p15_canonical_keys(spark, sf_dir):
    """Part names as keys of their brand; a plural or differently dashed spelling joins the oldest."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    known = p.select(F.col("p_brand").alias("subject"), F.lower(F.regexp_replace("p_type", " ", "-")).alias("key"), F.col("p_partkey").alias("first_seen"))
    known = known.groupBy("subject", "key").agg(F.min("first_seen").alias("first_seen"))
    said = p.select(F.col("p_brand").alias("subject"), F.concat(F.regexp_replace("p_type", " ", "_"), F.when(F.col("p_partkey") % 2 == 0, "s").otherwise("")).alias("key")).distinct()
    return ops.canonicalise(said, known)


def w4_recent(spark, sf_dir):
    """The three newest events of each user."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ops.recent(e, 3, "user_id", "ts", "event_id").select("user_id", "event_id", "rank")


def w9_subject_view(spark, sf_dir):
    return ops.subject_view(folded(spark, sf_dir).facts).select("subject", "key", "claim", "state", "replaced_by")


def w10_pending(spark, sf_dir):
    return ops.pending_view(folded(spark, sf_dir).pending).select("subject", "key", "session_id", "reason")


def j6_orphans(spark, sf_dir):
    """The fold against notes of which every third is gone and every fifth reads otherwise."""
    n = F.col("session_id").cast("long")
    notes = claims(spark, sf_dir).filter(n % 3 != 0).withColumns({"claim": F.when(n % 5 == 0, F.lit("other words")).otherwise(F.col("claim")), "key": F.when(n % 7 == 0, F.lit("elsewhere")).otherwise(F.col("key"))})
    return ops.orphans(folded(spark, sf_dir).facts, notes).select("subject", "key", "session_id", "why")


QUERIES = {f.__name__: f for f in (a1_reconcile_outcomes, a1_facts, a1_pending, w2_current, w3_history, a7_stats, a8_subjects, a9_waiting, a10_usage, a11_rereads, a14_links, a15_known_keys, a2_withdrawals, a3_replaced, j3_facts_as_of, j5_changes, j5_pairing, j6_orphans, p15_canonical_keys, w4_recent, w9_subject_view, w10_pending)}

_PAIRED = f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql("k")}, {fold_sql("k", "o", "CAST(session_id AS BIGINT) % 2 = 0")},
b AS (SELECT session_id, subject, key, n.claim IS NOT NULL AS stays, o.claim IS NOT NULL AS known, n.superseded_at AS is_over, o.superseded_at AS was_over FROM facts n FULL JOIN ofacts o USING (session_id, subject, key, claim, confidence)),
ch AS (SELECT session_id, subject, key, 'inserted' AS change FROM b WHERE NOT known UNION ALL SELECT session_id, subject, key, 'superseded' FROM b WHERE stays AND is_over IS NOT NULL AND was_over IS NULL
  UNION ALL SELECT session_id, subject, key, 'restored' FROM b WHERE stays AND is_over IS NULL AND was_over IS NOT NULL UNION ALL SELECT session_id, subject, key, 'retracted' FROM b WHERE NOT stays AND was_over IS NULL)"""

#: What makes spellings of the part keys one: every word without its plural ending.
_PART_FORM = "list_transform(string_split(replace({}, '_', '-'), '-'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] ELSE w END)"

SQL = {
    "a2_withdrawals": f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {WITHDRAWALS_SQL} SELECT * FROM history",
    "a3_replaced": f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {WITHDRAWALS_SQL} SELECT subject, state, count(*) AS facts FROM history GROUP BY 1, 2",
    "j5_changes": _PAIRED + " SELECT * FROM ch WHERE change IS NOT NULL",
    "j5_pairing": _PAIRED + " SELECT change, count(*) AS rows FROM ch WHERE change IS NOT NULL GROUP BY 1",
    "p15_canonical_keys": f"""WITH n AS (SELECT p_brand AS subject, lower(replace(p_type, ' ', '-')) AS key, min(p_partkey) AS seen FROM part GROUP BY 1, 2),
c AS (SELECT DISTINCT p_brand AS subject, replace(p_type, ' ', '_') || CASE WHEN p_partkey % 2 = 0 THEN 's' ELSE '' END AS key FROM part)
SELECT subject, c.key, coalesce(max(n.key) FILTER (n.key = c.key), arg_min(n.key, (seen, n.key)), c.key) AS canonical_key FROM c LEFT JOIN n USING (subject)
WHERE n.key IS NULL OR n.key = c.key OR {_PART_FORM.format("lower(c.key)")} = {_PART_FORM.format("n.key")} GROUP BY 1, 2""",
    "a1_reconcile_outcomes": _C + "SELECT subject, key, session_id, claim, outcome FROM f",
    "a1_facts": _C + "SELECT * FROM facts",
    "a1_pending": _C + "SELECT subject, key, claim, confidence, reason, session_id, created_at FROM pending",
    "w2_current": _C + "SELECT subject, key, claim, confidence, session_id FROM facts WHERE superseded_at IS NULL",
    "w3_history": _C + "SELECT subject, key, claim, created_at, CASE WHEN superseded_at IS NULL THEN 'live' ELSE 'superseded' END AS state, superseded_at AS until FROM facts",
    "a7_stats": _C + "SELECT count(*) FILTER (superseded_at IS NULL) AS live, count(*) FILTER (superseded_at IS NOT NULL) AS superseded, CAST(0 AS BIGINT) AS retracted, count(DISTINCT subject) FILTER (superseded_at IS NULL) AS subjects, (SELECT count(*) FROM pending) AS waiting FROM facts",
    "a8_subjects": _C + "SELECT subject, 'person' AS kind, count(*) AS facts FROM facts WHERE superseded_at IS NULL GROUP BY 1",
    "a9_waiting": _C + "SELECT regexp_replace(reason, ':.*', '') AS reason, count(*) AS entries FROM pending GROUP BY 1",
    "a10_usage": "SELECT event_type AS provider, count(*) AS calls, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS tokens, count(DISTINCT user_id) AS users FROM events GROUP BY 1",
    "a11_rereads": "SELECT user_id, count(*) AS readings FROM events WHERE event_type = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1 HAVING count(*) > 3",
    "a14_links": """WITH l AS (SELECT 'u' || user_id AS p, 'u' || (user_id * 7 % 50) AS q, event_type AS relation, ts, lpad(CAST(event_id AS VARCHAR), 12, '0') AS session_id FROM events)
SELECT least(p, q) AS a, greatest(p, q) AS b, relation, arg_min(session_id, (ts, session_id)) AS session_id FROM l WHERE p <> q GROUP BY 1, 2, 3""",
    "a15_known_keys": _C + "SELECT subject, key, min(created_at) AS first_seen FROM facts GROUP BY 1, 2",
    "j3_facts_as_of": _C + "SELECT p.session_id AS probe, p.subject, x.key, x.claim FROM k p JOIN facts x ON x.subject = p.subject AND x.created_at < p.date AND (x.superseded_at IS NULL OR x.superseded_at >= p.date) WHERE p.key = 'error'",
    "w4_recent": "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 3",
    "w9_subject_view": _C + """, x AS (SELECT *, lead(claim) OVER (PARTITION BY subject, key ORDER BY created_at, session_id) AS replaced_by FROM facts),
o AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY superseded_at DESC, created_at DESC, session_id DESC) AS rank FROM x WHERE superseded_at IS NOT NULL)
SELECT subject, key, claim, 'live' AS state, NULL AS replaced_by FROM facts WHERE superseded_at IS NULL
UNION ALL SELECT subject, key, claim, 'superseded', replaced_by FROM o WHERE rank <= 15""",
    "w10_pending": _C + "SELECT subject, key, session_id, reason FROM pending ORDER BY created_at DESC, session_id DESC LIMIT 100",
    "j6_orphans": _C + """SELECT subject, key, session_id, CASE WHEN CAST(session_id AS BIGINT) % 3 = 0 THEN 'no-note' WHEN CAST(session_id AS BIGINT) % 7 = 0 THEN 'not-claimed' ELSE 'reworded' END AS why
FROM facts WHERE superseded_at IS NULL AND (CAST(session_id AS BIGINT) % 3 = 0 OR CAST(session_id AS BIGINT) % 7 = 0 OR CAST(session_id AS BIGINT) % 5 = 0)""",
}
