"""Decisions over the event log: verdicts on the queue, slots withdrawn by hand and restored, moves, late data."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import decide as ops
from ..operators import facts as questions
from ..operators import reconcile as fold
from .memory import CLAIMS_SQL, claims, fold_sql, folded

LATER = "2030-01-01T00:00:00.000000"
_NONE = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double, created_at string, retracted_at string, reason string"


def notes(spark, sf_dir):
    return ops.Notes(claims(spark, sf_dir), spark.createDataFrame([], _NONE))


def verdicts(pending):
    """Of the queue a third is accepted and a third rejected."""
    n = F.col("session_id").cast("long") % 3
    return pending.filter(n < 2).select("session_id", "subject", "key", "claim", F.when(n == 0, "accepted").otherwise("rejected").alias("verdict"), F.lit(LATER).alias("at"))


def d1_queue(spark, sf_dir):
    pending = folded(spark, sf_dir).pending
    queue, _ = ops.decide(pending, verdicts(pending))
    return queue.select("session_id", "subject", "key", "status")


def a4_with_accepts(spark, sf_dir):
    """All facts once the accepted entries are claims too."""
    pending = folded(spark, sf_dir).pending
    _, accepts = ops.decide(pending, verdicts(pending))
    return ops.derived(notes(spark, sf_dir), accepts).facts.select("subject", "key", "claim", "confidence", "session_id", "created_at", "superseded_at")


def _retracted(spark, sf_dir):
    """The errors of every tenth user are withdrawn; for every other of them no reason is given."""
    said = notes(spark, sf_dir)
    facts = folded(spark, sf_dir).facts
    user = F.regexp_replace("subject", "u", "").cast("long")
    slots = said.claims.select("subject", F.lit("error").alias("key")).distinct().filter(user % 10 == 0)
    slots = slots.select("subject", "key", F.lit(LATER).alias("at"), F.when(user % 20 == 0, "never true").otherwise("").alias("reason"))
    nowhere = spark.createDataFrame([("nobody", "error", LATER, "why not")], "subject string, key string, at string, reason string")
    return ops.retract(said, slots.unionByName(nowhere), facts)


def d2_retract(spark, sf_dir):
    """Live facts after the withdrawals."""
    left, _ = _retracted(spark, sf_dir)
    return fold.live(ops.derived(left).facts).select("subject", "key", "claim", "session_id")


def d2_outcomes(spark, sf_dir):
    return _retracted(spark, sf_dir)[1]


def d3_restore(spark, sf_dir):
    """The newest error of each user whose errors were withdrawn is restored and confirmed; views of the same users were never withdrawn."""
    left, _ = _retracted(spark, sf_dir)
    named = left.withdrawals.groupBy("subject", "key").agg(F.max_by("session_id", F.struct("date", "session_id")).alias("session_id"))
    asked = named.select("subject", "key", "session_id", F.lit(True).alias("confirm"))
    asked = asked.unionByName(named.select("subject", F.lit("view").alias("key"), F.lit(None).cast("string").alias("session_id"), F.lit(False).alias("confirm")))
    moves = spark.createDataFrame([], "session_id string, subject string, key string, to_subject string, to_key string")
    back, outcomes = ops.restore(left, asked, moves)
    facts = fold.live(ops.derived(back).facts).select("subject", "key", "claim", "confidence")
    return facts.join(outcomes.select("subject", "key", "outcome").hint("shuffle_merge"), ["subject", "key"], "left")


def d3_ambiguous(spark, sf_dir):
    """Without a session named, a slot that several notes withdrew is ambiguous."""
    left, _ = _retracted(spark, sf_dir)
    asked = left.withdrawals.select("subject", "key").distinct().select("subject", "key", F.lit(None).cast("string").alias("session_id"), F.lit(False).alias("confirm"))
    moves = spark.createDataFrame([], "session_id string, subject string, key string, to_subject string, to_key string")
    return ops.restore(left, asked, moves)[1].select("subject", "key", "outcome", "candidates")


def _plan(spark, sf_dir):
    """Every seventh user's errors move to a team."""
    users = claims(spark, sf_dir).select("subject").distinct().withColumn("n", F.regexp_replace("subject", "u", "").cast("long"))
    team = F.concat(F.lit("team"), (F.col("n") % 10).cast("string"))
    return users.filter("n % 7 = 1").select(F.col("n").alias("ord"), "subject", F.lit("error").alias("key"), team.alias("to_subject"), F.concat(F.lit("errors-of-"), "subject").alias("to_key"), F.lit("org").alias("kind"))


def j10_check(spark, sf_dir):
    """The plan with rows that cannot be: into itself, a source twice, a source that no note claims, a target that is known."""
    plan = _plan(spark, sf_dir)
    rows = claims(spark, sf_dir).select("subject").distinct().withColumn("n", F.regexp_replace("subject", "u", "").cast("long"))
    bad = lambda cut, add, key, to, to_key: rows.filter(cut).select((F.col("n") + add).alias("ord"), F.col("subject"), F.lit(key).alias("key"), to.alias("to_subject"), F.lit(to_key).alias("to_key"), F.lit("org").alias("kind"))
    u = F.col("subject")
    plan = plan.unionByName(bad("n % 14 = 3", 1_000_000, "view", u, "view")).unionByName(bad("n % 14 = 1", 2_000_000, "error", F.lit("x"), "y")).unionByName(bad("n % 14 = 5", 3_000_000, "nothing", F.lit("x"), "z")).unionByName(bad("n % 14 = 6", 4_000_000, "click", F.concat(F.lit("u"), F.col("n").cast("string")), "login"))
    return ops.check_plan(plan, notes(spark, sf_dir), folded(spark, sf_dir).facts)


def d4_moved(spark, sf_dir):
    """Live facts after the move."""
    after, _ = ops.move(notes(spark, sf_dir), _plan(spark, sf_dir), LATER, "teams")
    return fold.live(ops.derived(after).facts).select("subject", "key", "claim", "session_id")


def a18_preview(spark, sf_dir):
    before, plan = notes(spark, sf_dir), _plan(spark, sf_dir)
    after, _ = ops.move(before, plan, LATER, "teams")
    return ops.move_preview(before, after, plan)[0]


def _early(spark, sf_dir):
    """Memory that knew every second event, every third of these in more words, and entries that were accepted and withdrawn by hand; notes of which some were lost since."""
    all_ = notes(spark, sf_dir)
    n = F.col("session_id").cast("long")
    said = all_.claims.filter(n % 2 == 0).withColumn("claim", F.when(n % 3 == 0, F.concat("claim", F.lit(" or so"))).otherwise(F.col("claim")))
    held = ops.derived(ops.Notes(said, all_.withdrawals)).facts
    hand = said.select("subject").distinct().filter("cast(replace(subject, 'u', '') as long) % 20 = 0").select(
        "subject", F.lit(-1).cast("long").alias("seq"), F.lit("view").alias("key"), F.lit("person").alias("subject_kind"), F.lit("accepted by hand").alias("claim"), F.lit(1.0).alias("confidence"), F.lit("0").alias("session_id"),
        F.lit("2000").alias("created_at"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("string").alias("superseded_at"), F.lit("2001").alias("retracted_at"),
    )
    return held.unionByName(hand), ops.Notes(all_.claims.filter(n % 10 != 4), all_.withdrawals)


def d5_rebase(spark, sf_dir):
    """That memory, brought up to date for users below 100 alone: rows are kept, refined, withdrawn or left to the hand that withdrew them."""
    held, now = _early(spark, sf_dir)
    touched = now.claims.select("subject").distinct().filter("cast(replace(subject, 'u', '') as long) < 100")
    return ops.rebase(held, now, touched, LATER).select("subject", "key", "claim", "session_id", "superseded_at", "retracted_at")


def d5_successors(spark, sf_dir):
    """What superseded each row of that memory, by the successor's own words."""
    held, now = _early(spark, sf_dir)
    out = ops.rebase(held, now, now.claims.select("subject").distinct(), LATER)
    heirs = out.select("subject", F.col("seq").alias("superseded_by"), F.col("claim").alias("by_claim"), F.col("session_id").alias("by_session"))
    return out.join(heirs.hint("shuffle_merge"), ["subject", "superseded_by"]).select("subject", "key", "claim", "session_id", "by_claim", "by_session")


def d6_reindex(spark, sf_dir):
    """What every derived table holds when it is built from the notes alone."""
    out = ops.derived(notes(spark, sf_dir))
    return out.facts.select(F.lit("fact").alias("kind"), "subject", "key").unionByName(out.pending.select(F.lit("pending").alias("kind"), "subject", "key")).groupBy("kind", "subject", "key").agg(F.count(F.lit(1)).alias("rows"))


def d7_queue(spark, sf_dir):
    """The queue of the memory that knew every second event, with verdicts, against what a full replay raises."""
    log = claims(spark, sf_dir)
    old = fold.replay(fold.events(log.filter("cast(session_id as long) % 2 = 0"))).pending
    queue, _ = ops.decide(old, verdicts(old))
    queue = queue.withColumn("status", F.when((F.col("status") == "waiting") & (F.col("session_id").cast("long") % 4 == 0), "obsolete").otherwise(F.col("status")))
    return ops.settle_queue(folded(spark, sf_dir).pending, queue).select("session_id", "subject", "key", "status")


def d7_rewordings(spark, sf_dir):
    """Each queued claim was raised and answered in two wordings, one accepted and one rejected or obsolete; it is raised again as it was, in a third wording that fits either, and in words of its own."""
    now = folded(spark, sf_dir).pending
    told = lambda words, status: now.withColumns({"claim": F.concat("claim", F.lit(words)), "status": status})
    n = F.col("session_id").cast("long")
    queue = told(" as of today", F.lit("accepted")).unionByName(told(" as said", F.when(n % 2 == 0, "rejected").otherwise("obsolete"))).unionByName(now.filter(n % 3 == 0).withColumns({"claim": F.lit("gone"), "status": F.lit("waiting")}))
    again = now.unionByName(now.withColumn("claim", F.concat("claim", F.lit(" as")))).unionByName(now.filter(n % 5 == 0).withColumn("claim", F.lit("unheard of so far")))
    return ops.settle_queue(again, queue).select("session_id", "subject", "key", "claim", "status")


def a5_unconfirmed(spark, sf_dir):
    """Sessions that are read again: every third says nothing, every fifth something else in the same slot, the others the same."""
    n = F.col("session_id").cast("long")
    again = claims(spark, sf_dir).filter(n % 2 == 0).withColumns({"claim": F.when(n % 5 == 0, "something else entirely").otherwise(F.col("claim")), "key": F.when(n % 3 == 0, "elsewhere").otherwise(F.col("key"))})
    again = again.withColumn("claim", F.when(n % 3 == 0, "a claim of its own").otherwise(F.col("claim")))
    return questions.retract_unconfirmed(folded(spark, sf_dir).facts, again).select("session_id", "subject", "key", "withdrawn")


def a6_retractions(spark, sf_dir):
    """Each user's clicks name the user's errors as no longer true; a session of the same kind fills the slot again for every fourth."""
    s = claims(spark, sf_dir)
    requests = s.filter("key = 'click'").select("session_id", "subject", F.lit("error ").alias("key"), F.lit("").alias("reason"))
    fills = s.filter("key = 'click' AND cast(session_id as long) % 4 = 0").select("session_id", "subject", F.lit("error").alias("key"))
    return questions.apply_retractions(requests, folded(spark, sf_dir).facts, s.select("session_id", "date"), fills).select("session_id", "subject", "key", "made_by", "withdrawn")


def j11_in_slot(spark, sf_dir):
    """Which slots of errors some click's user fills."""
    s = claims(spark, sf_dir)
    rows = s.filter("key = 'view'").select("session_id", F.concat(F.lit(" "), "subject").alias("subject"), F.lit("error ").alias("key"))
    return ops.in_slot(rows, s).select("session_id", "subject")


QUERIES = {f.__name__: f for f in (d1_queue, a4_with_accepts, d2_retract, d2_outcomes, d3_restore, d3_ambiguous, j10_check, d4_moved, a18_preview, d5_rebase, d5_successors, d6_reindex, d7_queue, d7_rewordings, a5_unconfirmed, a6_retractions, j11_in_slot)}

_W = f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql('k')}"
_N = "CAST(session_id AS BIGINT)"
_U = "CAST(replace(subject, 'u', '') AS BIGINT)"
_GONE = f"key = 'error' AND {_U} % 20 = 0"
_PLAN = f"plan AS (SELECT DISTINCT {_U} AS ord, subject, 'error' AS key, 'team' || ({_U} % 10) AS ts, 'errors-of-' || subject AS tk FROM k WHERE {_U} % 7 = 1)"
#: Two claims say the same.
_SAME = "({0}.claim = {1}.claim OR (length({0}.claim) > 12 AND length({1}.claim) > 12 AND (contains({0}.claim, {1}.claim) OR contains({1}.claim, {0}.claim))))"
#: Facts once errors of many users are keys of one team, where a claim that a live fact of another key holds already opens no slot. me: claims that may stand; mn: what replaces each, once it holds;
#: mtwin: a claim and one of another key that says the same and, if it ever held, holds then; mopen: claims that may open their slot, as all before them may be such twins; mchain: what holds after each opening;
#: mdep: an opening that fails if another one stands; mfail: which fail, until nothing changes. Moved slots have withdrawals at their source alone, so that a slot once held stays held.
_MOVED = f"""{_PLAN}, mk AS (SELECT coalesce(ts, k.subject) AS subject, coalesce(tk, k.key) AS key, claim, confidence, date, session_id FROM k LEFT JOIN plan ON plan.subject = k.subject AND plan.key = k.key),
me AS (SELECT *, row_number() OVER (PARTITION BY subject, key ORDER BY date, session_id) AS rn FROM mk WHERE confidence >= 0.75),
mx AS (SELECT a.subject, a.key, a.rn, min(b.rn) AS nrn FROM me a JOIN me b ON b.subject = a.subject AND b.key = a.key AND b.rn > a.rn AND b.confidence >= a.confidence - CAST(0.1 AS DOUBLE) AND NOT {_SAME.format("a", "b")} GROUP BY 1, 2, 3),
mn AS (SELECT a.*, mx.nrn, b.date AS ends, b.session_id AS ended_by FROM me a LEFT JOIN mx ON mx.subject = a.subject AND mx.key = a.key AND mx.rn = a.rn LEFT JOIN me b ON b.subject = a.subject AND b.key = a.key AND b.rn = mx.nrn),
mtwin AS (SELECT a.subject, a.key, a.rn, b.key AS okey, b.rn AS orn FROM mn a JOIN mn b ON b.subject = a.subject AND b.key <> a.key AND (b.date, b.session_id) < (a.date, a.session_id) AND (b.ends IS NULL OR (b.ends, b.ended_by) > (a.date, a.session_id)) AND {_SAME.format("a", "b")}),
mopen AS (SELECT subject, key, rn FROM (SELECT e.subject, e.key, e.rn, coalesce(bool_and(t.rn IS NOT NULL) OVER (PARTITION BY e.subject, e.key ORDER BY e.rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS may
  FROM me e LEFT JOIN (SELECT DISTINCT subject, key, rn FROM mtwin) t ON t.subject = e.subject AND t.key = e.key AND t.rn = e.rn) WHERE may),
mchain AS (SELECT subject, key, rn AS first, rn FROM mopen UNION ALL SELECT c.subject, c.key, c.first, x.nrn FROM mchain c JOIN mx x ON x.subject = c.subject AND x.key = c.key AND x.rn = c.rn),
mdep AS (SELECT DISTINCT t.subject, t.key, t.rn, t.okey, c.first AS ofirst FROM mtwin t JOIN mopen o ON o.subject = t.subject AND o.key = t.key AND o.rn = t.rn JOIN mchain c ON c.subject = t.subject AND c.key = t.okey AND c.rn = t.orn),
mfail AS (SELECT 0 AS n, CAST([] AS VARCHAR[]) AS failed, CAST(NULL AS VARCHAR[]) AS before UNION ALL
  SELECT any_value(s.n) + 1, coalesce(list(DISTINCT d.subject || '/' || d.key || '/' || d.rn ORDER BY d.subject || '/' || d.key || '/' || d.rn) FILTER (d.ofirst = f.first), []), any_value(s.failed)
  FROM mfail s CROSS JOIN (SELECT 1) LEFT JOIN mdep d ON true LEFT JOIN (SELECT o.subject, o.key, min(o.rn) AS first FROM mopen o, mfail s WHERE NOT list_contains(s.failed, o.subject || '/' || o.key || '/' || o.rn) GROUP BY 1, 2) f ON f.subject = d.subject AND f.key = d.okey
  WHERE s.failed IS DISTINCT FROM s.before HAVING count(*) > 0),
mfirst AS (SELECT subject, key, min(rn) AS first FROM mopen WHERE subject || '/' || key || '/' || rn NOT IN (SELECT unnest(failed) FROM (SELECT failed FROM mfail ORDER BY n DESC LIMIT 1)) GROUP BY 1, 2),
mfacts AS (SELECT n.subject, n.key, n.claim, n.confidence, n.session_id, n.date AS created_at, n.ends AS superseded_at FROM mfirst f JOIN mchain c ON c.subject = f.subject AND c.key = f.key AND c.first = f.first JOIN mn n ON n.subject = c.subject AND n.key = c.key AND n.rn = c.rn)"""
#: laid: the replay of what notes say now (facts), and rows of the early memory (ofacts) that it does not have.
_EARLY = f"""k AS ({CLAIMS_SQL}), e AS (SELECT subject, key, CASE WHEN {_N} % 3 = 0 THEN claim || ' or so' ELSE claim END AS claim, confidence, date, session_id FROM k WHERE {_N} % 2 = 0),
{fold_sql('e', 'o')}, {fold_sql('k', '', _N + ' % 10 <> 4')}, laid AS (
  SELECT subject, key, claim, session_id, superseded_at, CAST(NULL AS VARCHAR) AS retracted_at FROM facts
  UNION ALL SELECT o.subject, o.key, o.claim, o.session_id, coalesce(o.superseded_at, f.created_at), CASE WHEN o.superseded_at IS NULL AND f.claim IS NULL THEN '{LATER}' END
  FROM ofacts o LEFT JOIN facts p ON p.session_id = o.session_id AND p.claim = o.claim LEFT JOIN facts f ON f.session_id = o.session_id AND f.superseded_at IS NULL AND contains(o.claim, f.claim) WHERE p.claim IS NULL)"""

SQL = {
    "d1_queue": _W + f"SELECT session_id, subject, key, CASE {_N} % 3 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'waiting' END AS status FROM pending",
    "a4_with_accepts": _W + f", kk AS (SELECT subject, key, claim, confidence, date, session_id FROM k UNION ALL SELECT subject, key, claim, CAST(1.0 AS DOUBLE), '{LATER}', session_id FROM pending WHERE {_N} % 3 = 0), {fold_sql('kk', 'q')} SELECT subject, key, claim, confidence, session_id, created_at, superseded_at FROM qfacts",
    "d2_retract": _W + f"SELECT subject, key, claim, session_id FROM facts WHERE superseded_at IS NULL AND NOT ({_GONE})",
    "d2_outcomes": _W + f"SELECT DISTINCT subject, 'error' AS key, CASE WHEN {_U} % 20 <> 0 THEN 'no-reason' WHEN EXISTS (SELECT 1 FROM k x WHERE x.subject = k.subject AND x.key = 'error') THEN 'withdrawn' ELSE 'nothing' END AS outcome FROM k WHERE {_U} % 10 = 0 UNION ALL SELECT 'nobody', 'error', 'nothing'",
    "d3_restore": _W + f""", back AS (SELECT subject, key, arg_max(claim, (date, session_id)) AS claim FROM k WHERE {_GONE} GROUP BY 1, 2)
SELECT subject, key, claim, confidence, CASE WHEN key = 'view' AND subject IN (SELECT subject FROM back) THEN 'nothing' END AS outcome FROM facts WHERE superseded_at IS NULL AND NOT ({_GONE})
UNION ALL SELECT subject, key, claim, CAST(1.0 AS DOUBLE), 'restored' FROM back""",
    "d3_ambiguous": _W + f"SELECT subject, key, CASE WHEN count(*) > 1 THEN 'ambiguous' ELSE 'restored' END AS outcome, count(*) AS candidates FROM k WHERE {_GONE} GROUP BY 1, 2",
    "j10_check": _W + f""", us AS (SELECT DISTINCT subject, {_U} AS n FROM k), {_PLAN}, p AS (SELECT ord, subject, key, ts, tk FROM plan
  UNION ALL SELECT n + 1000000, subject, 'view', subject, 'view' FROM us WHERE n % 14 = 3 UNION ALL SELECT n + 2000000, subject, 'error', 'x', 'y' FROM us WHERE n % 14 = 1
  UNION ALL SELECT n + 3000000, subject, 'nothing', 'x', 'z' FROM us WHERE n % 14 = 5 UNION ALL SELECT n + 4000000, subject, 'click', subject, 'login' FROM us WHERE n % 14 = 6)
SELECT ord, 'same-slot' AS refusal FROM p WHERE subject = ts AND key = tk
UNION ALL SELECT ord, 'source-repeats' FROM (SELECT ord, row_number() OVER (PARTITION BY subject, key ORDER BY ord) AS nth FROM p) WHERE nth > 1
UNION ALL SELECT ord, 'source-is-target' FROM p WHERE (subject, key) IN (SELECT (ts, tk) FROM p) UNION ALL SELECT ord, 'no-note' FROM p WHERE (subject, key) NOT IN (SELECT (subject, key) FROM k)
UNION ALL SELECT ord, 'target-known' FROM p WHERE (ts, tk) IN (SELECT (subject, key) FROM k)""",
    "d4_moved": f"WITH RECURSIVE k AS ({CLAIMS_SQL}), {_MOVED} SELECT subject, key, claim, session_id FROM mfacts WHERE superseded_at IS NULL",
    "a18_preview": f"""WITH RECURSIVE k AS ({CLAIMS_SQL}), {fold_sql('k')}, {_MOVED}
SELECT 'before' AS state, count(*) AS facts, count(DISTINCT subject) AS subjects FROM facts WHERE superseded_at IS NULL UNION ALL SELECT 'after', count(*), count(DISTINCT subject) FROM mfacts WHERE superseded_at IS NULL""",
    "d5_rebase": f"WITH RECURSIVE {_EARLY} SELECT subject, key, claim, session_id, superseded_at, retracted_at FROM laid WHERE {_U} < 100 UNION ALL SELECT subject, key, claim, session_id, superseded_at, NULL FROM ofacts WHERE {_U} >= 100 UNION ALL SELECT subject, 'view', 'accepted by hand', '0', NULL, '2001' FROM (SELECT DISTINCT subject FROM e) WHERE {_U} % 20 = 0",
    "d5_successors": f"""WITH RECURSIVE {_EARLY}, nx AS (SELECT *, lead(claim) OVER w AS by_claim, lead(session_id) OVER w AS by_session FROM facts WINDOW w AS (PARTITION BY subject, key ORDER BY created_at, session_id)),
ox AS (SELECT *, lead(claim) OVER w AS by_claim, lead(session_id) OVER w AS by_session FROM ofacts WINDOW w AS (PARTITION BY subject, key ORDER BY created_at, session_id))
SELECT subject, key, claim, session_id, by_claim, by_session FROM nx WHERE superseded_at IS NOT NULL
UNION ALL SELECT ox.subject, ox.key, ox.claim, ox.session_id, coalesce(ox.by_claim, f.claim), coalesce(ox.by_session, f.session_id) FROM ox LEFT JOIN facts p ON p.session_id = ox.session_id AND p.claim = ox.claim LEFT JOIN facts f ON f.session_id = ox.session_id AND f.superseded_at IS NULL AND contains(ox.claim, f.claim)
WHERE p.claim IS NULL AND (ox.superseded_at IS NOT NULL OR f.claim IS NOT NULL)""",
    "d6_reindex": _W + "SELECT 'fact' AS kind, subject, key, count(*) AS rows FROM facts GROUP BY 2, 3 UNION ALL SELECT 'pending', subject, key, count(*) FROM pending GROUP BY 2, 3",
    "d7_queue": _W + f", {fold_sql('k', 'o', _N + ' % 2 = 0')}" + f""", old AS (SELECT session_id, subject, key, CASE WHEN {_N} % 3 = 0 THEN 'accepted' WHEN {_N} % 3 = 1 THEN 'rejected' WHEN {_N} % 4 = 0 THEN 'obsolete' ELSE 'waiting' END AS status FROM opending)
SELECT session_id, subject, key, CASE WHEN o.status IS NULL THEN 'waiting' WHEN n.claim IS NULL AND o.status = 'waiting' THEN 'obsolete' WHEN n.claim IS NOT NULL AND o.status = 'obsolete' THEN 'waiting' ELSE o.status END AS status
FROM old o FULL JOIN pending n USING (session_id, subject, key)""",
    # the claim as it was takes the accepted wording (of the earlier date and claim), the third wording the other one
    "d7_rewordings": _W + f"""SELECT session_id, subject, key, claim || ' as of today' AS claim, 'accepted' AS status FROM pending UNION ALL SELECT session_id, subject, key, claim || ' as said', CASE WHEN {_N} % 2 = 0 THEN 'rejected' ELSE 'waiting' END FROM pending
UNION ALL SELECT session_id, subject, key, 'gone', 'obsolete' FROM pending WHERE {_N} % 3 = 0 UNION ALL SELECT session_id, subject, key, 'unheard of so far', 'waiting' FROM pending WHERE {_N} % 5 = 0""",
    "a5_unconfirmed": _W + f"SELECT session_id, subject, key, {_N} % 3 = 0 AS withdrawn FROM facts WHERE superseded_at IS NULL AND {_N} % 2 = 0 AND ({_N} % 3 = 0 OR {_N} % 5 = 0)",
    "a6_retractions": _W + f""", cur AS (SELECT * FROM facts WHERE superseded_at IS NULL AND key = 'error' AND confidence < 1)
SELECT k.session_id, k.subject, 'error' AS key, cur.session_id AS made_by, CAST(k.session_id AS BIGINT) % 4 <> 0 AS withdrawn FROM k JOIN cur ON cur.subject = k.subject AND k.key = 'click' JOIN k m ON m.session_id = cur.session_id WHERE m.date <= k.date""",
    "j11_in_slot": _W + "SELECT session_id, ' ' || subject AS subject FROM k WHERE key = 'view' AND subject IN (SELECT subject FROM k WHERE key = 'error')",
}
