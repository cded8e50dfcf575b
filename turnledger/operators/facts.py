"""Questions over facts, the queue and sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import claim_form, equivalent, key_forms
from ..sources.scratch import written
from .reconcile import current, live


def stats(facts: DataFrame, pending: DataFrame, sessions: DataFrame | None = None, links: DataFrame | None = None) -> DataFrame:
    """One row: live, superseded and retracted facts, live subjects, waiting entries; with sessions (status) those that were read, wait or were
    set aside, with links their number."""
    alive = F.col("superseded_at").isNull() & F.col("retracted_at").isNull()
    counts = facts.agg(
        F.count_if(alive).alias("live"),
        F.count_if(F.col("superseded_at").isNotNull()).alias("superseded"),
        F.count_if(F.col("retracted_at").isNotNull()).alias("retracted"),
        F.count_distinct(F.when(alive, F.col("subject"))).alias("subjects"),
    )
    more = [pending.agg(F.count(F.lit(1)).alias("waiting"))]
    if sessions is not None:
        kinds = {"ok": "read", "pending-extraction": "pending_sessions", "quarantined": "quarantined", "empty": "empty", "skipped": "skipped"}
        more.append(sessions.agg(*(F.count_if(F.col("status") == k).alias(v) for k, v in kinds.items())))
    if links is not None:
        more.append(links.agg(F.count(F.lit(1)).alias("links")))
    for one in more:  # one row each
        counts = counts.crossJoin(F.broadcast(one))
    return counts


def subjects(facts: DataFrame) -> DataFrame:
    return live(facts).groupBy("subject").agg(F.min("subject_kind").alias("kind"), F.count(F.lit(1)).alias("facts"))


def known_keys(facts: DataFrame) -> DataFrame:
    """Every key a subject ever had, with when it was first seen."""
    return facts.groupBy("subject", "key").agg(F.min("created_at").alias("first_seen"), F.min("seq").alias("first_seq"))


def waiting(pending: DataFrame) -> DataFrame:
    """Queue entries by kind of reason."""
    return pending.groupBy(F.regexp_replace("reason", ":.*", "").alias("reason")).agg(F.count(F.lit(1)).alias("entries"))


def link_set(links: DataFrame) -> DataFrame:
    """links: a, b, relation, date, session_id. Undirected pairs, first namer kept, self-pairs dropped."""
    pair = links.select(F.trim("a").alias("p"), F.trim("b").alias("q"), F.coalesce(F.nullif("relation", F.lit("")), F.lit("related")).alias("relation"), "date", "session_id")
    pair = pair.filter("p <> '' AND q <> '' AND p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "relation", "date", "session_id")
    return pair.groupBy("a", "b", "relation").agg(F.min(F.struct("date", "session_id")).alias("f")).select("a", "b", "relation", F.col("f.session_id").alias("session_id"))


def canonicalise(claims: DataFrame, known: DataFrame) -> DataFrame:
    """Adds canonical_key: the oldest known key of the subject that is the same key, else the key itself.
    known: subject, key, first_seen. Many spellings of a key meet by their forms, never pair by pair."""
    forms = known.select("subject", F.col("key").alias("known_key"), "first_seen", F.explode(key_forms(F.col("key"))).alias("form"))
    oldest = forms.groupBy("subject", "form").agg(F.min(F.struct("first_seen", "known_key")).alias("k"))
    keys = claims.select("subject", "key").distinct()
    met = keys.withColumn("form", F.explode(key_forms(F.col("key")))).join(oldest.hint("shuffle_merge"), ["subject", "form"])
    chosen = met.groupBy("subject", "key").agg(F.min("k").alias("k"))
    exact = keys.join(known.select("subject", "key", F.lit(True).alias("is_known")).hint("shuffle_merge"), ["subject", "key"], "left")
    names = exact.join(chosen.hint("shuffle_merge"), ["subject", "key"], "left").select("subject", "key", F.when(F.col("is_known"), F.col("key")).otherwise(F.coalesce("k.known_key", "key")).alias("canonical_key"))
    return claims.join(names.hint("shuffle_merge"), ["subject", "key"])


def retract_unconfirmed(facts: DataFrame, reread: DataFrame) -> DataFrame:
    """Live facts of sessions read again (below confidence 1) that no new claim of the subject repeats. reread: session_id, subject, key,
    claim, of model readings only. withdrawn is false where the new reading fills the same slot: the wording was replaced."""
    old = live(facts).join(reread.select("session_id").distinct().hint("shuffle_merge"), "session_id", "left_semi").filter("confidence < 1").withColumn("form", claim_form(F.col("claim")))
    said = reread.select("session_id", F.trim("subject").alias("subject"), F.trim("key").alias("key"), claim_form(F.col("claim")).alias("new_form"))
    new = said.select("session_id", "subject", "new_form").distinct()
    gone = old.join(new.withColumnRenamed("new_form", "form").hint("shuffle_merge"), ["session_id", "subject", "form"], "left_anti")
    contained = gone.join(new.hint("shuffle_merge"), ["session_id", "subject"]).filter(equivalent(F.col("form"), F.col("new_form"))).select("subject", "seq").distinct()
    missing = gone.join(contained.hint("shuffle_merge"), ["subject", "seq"], "left_anti").drop("form")
    slots = said.select("session_id", "subject", "key", F.lit(False).alias("withdrawn")).distinct()
    return missing.join(slots.hint("shuffle_merge"), ["session_id", "subject", "key"], "left").withColumn("withdrawn", F.coalesce("withdrawn", F.lit(True)))


def apply_retractions(requests: DataFrame, facts: DataFrame, sessions: DataFrame, claims: DataFrame) -> DataFrame:
    """requests: session_id, subject, key, reason. sessions: session_id, date. claims: session_id, subject, key. The current fact of each named slot is
    withdrawn, if it is below confidence 1 and no newer session made it; withdrawn is false where the session's own claims fill the slot."""
    asked = requests.select("session_id", F.trim("subject").alias("subject"), F.trim("key").alias("key"), "reason").filter("subject <> '' AND key <> ''")
    held = current(facts).filter("confidence < 1").select("subject", "key", "subject_kind", "claim", "confidence", "created_at", F.col("session_id").alias("made_by"))
    dates = sessions.select("session_id", "date")
    j = asked.join(held.hint("shuffle_merge"), ["subject", "key"]).join(dates.hint("shuffle_merge"), "session_id", "left")
    j = j.join(dates.select(F.col("session_id").alias("made_by"), F.col("date").alias("made_on")).hint("shuffle_merge"), "made_by", "left").filter("NOT coalesce(made_on > date, false)")
    slots = claims.select("session_id", F.trim("subject").alias("subject"), F.trim("key").alias("key"), F.lit(False).alias("withdrawn")).distinct()
    out = j.join(slots.hint("shuffle_merge"), ["session_id", "subject", "key"], "left")
    return out.select("session_id", "subject", "key", "claim", "confidence", "made_by", F.coalesce("withdrawn", F.lit(True)).alias("withdrawn"), F.coalesce(F.nullif(F.trim("reason"), F.lit("")), F.concat(F.lit("سحبته جلسة "), "session_id")).alias("reason"))


def orphans(facts: DataFrame, claims: DataFrame) -> DataFrame:
    """Live facts against the claims of their session: no-note, not-claimed or reworded (its note fills the slot with a claim that is not
    equivalent); others are left out."""
    sessions = claims.select("session_id").distinct().withColumn("has_note", F.lit(True))
    slots = claims.groupBy("session_id", "subject", "key").agg(F.collect_set("claim").alias("said"))
    j = live(facts).join(sessions.hint("shuffle_merge"), "session_id", "left").join(slots.hint("shuffle_merge"), ["session_id", "subject", "key"], "left")
    same = F.exists("said", lambda c: equivalent(claim_form(c), claim_form(F.col("claim"))))
    why = F.when(F.col("has_note").isNull(), "no-note").when(F.col("said").isNull(), "not-claimed").when(~same, "reworded")
    return j.withColumn("why", why).filter("why IS NOT NULL").select("subject", "key", "claim", "session_id", "why")


def recent(sessions: DataFrame, k: int, by: str = "project", at: str = "started_at", tie: str = "session_id") -> DataFrame:
    """The k newest sessions of each project."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(at), F.desc(tie)))
    return sessions.withColumn("rank", rank).filter(F.col("rank") <= k)


def subject_view(facts: DataFrame, past: int = 15) -> DataFrame:
    """Live facts, and of each subject the newest `past` that were superseded, with the words that replaced them, or withdrawn."""
    after = facts.select("subject", F.col("seq").alias("superseded_by"), F.col("claim").alias("replaced_by"), F.col("retracted_at").isNotNull().alias("later_withdrawn"))
    old = facts.filter("superseded_at IS NOT NULL OR retracted_at IS NOT NULL").join(after.hint("shuffle_merge"), ["subject", "superseded_by"], "left")
    old = old.withColumns({"state": F.when(F.col("superseded_at").isNotNull(), "superseded").otherwise("retracted"), "ended": F.coalesce("superseded_at", "retracted_at")})
    rank = F.row_number().over(Window.partitionBy("subject").orderBy(F.desc("ended"), F.desc("seq")))
    old = old.withColumn("rank", rank).filter(F.col("rank") <= past).select("subject", "key", "claim", "state", "replaced_by", "later_withdrawn")
    now = live(facts).select("subject", "key", "claim", F.lit("live").alias("state"), F.lit(None).cast("string").alias("replaced_by"), F.lit(None).cast("boolean").alias("later_withdrawn"))
    return now.unionByName(old)


def subject_lines(facts: DataFrame) -> DataFrame:
    """subject, section (1 live, 2 superseded, 3 withdrawn), text: the lines of each subject's document, one row a line however many a subject has."""
    day = lambda c: F.substring(c, 1, 10)
    after = facts.select("subject", F.col("seq").alias("superseded_by"), F.concat(F.lit(" → "), "claim", F.when(F.col("retracted_at").isNotNull(), " (سُحب لاحقاً)").otherwise("")).alias("arrow"))
    j = facts.join(after.hint("shuffle_merge"), ["subject", "superseded_by"], "left")
    what = F.concat(F.lit("**"), "key", F.lit("** — "), "claim")
    section = F.when(F.col("retracted_at").isNotNull(), 3).when(F.col("superseded_at").isNotNull(), 2).otherwise(1)
    text = (
        F.when(section == 1, F.concat(F.lit("- "), what, F.lit("  <sub>"), day("created_at"), F.lit(" · "), "session_id", F.lit("</sub>")))
        .when(section == 2, F.concat(F.lit("- ~~"), what, F.lit("~~"), F.coalesce("arrow", F.lit("")), F.lit("  <sub>حتى "), day("superseded_at"), F.lit("</sub>")))
        .otherwise(F.concat(F.lit("- ~~"), what, F.lit("~~  <sub>سُحب "), day("retracted_at"), F.lit(" · "), "session_id", F.lit("</sub>")))
    )
    return j.select("subject", section.alias("section"), text.alias("text"))


#: Letters of the shorter name by which it meets longer ones.
GRAM = 4


def near_names(subjects: DataFrame, names: DataFrame) -> DataFrame:
    """For each name (name) that is no subject: the subjects that hold it or that it holds, case aside. The shorter of two names begins somewhere within the
    longer: its first GRAM letters (all, if fewer) meet the pieces of that length of the longer one, and what meets is compared. Empty names are near nothing."""
    held = subjects.select("subject").distinct().filter("subject <> ''").withColumn("low", F.lower("subject"))
    wanted = names.select("name").distinct().filter("name <> ''").join(held.select(F.col("subject").alias("name")).hint("shuffle_merge"), "name", "left_anti").withColumn("low", F.lower("name"))
    held, wanted = written(held), written(wanted)
    first = lambda df, c: df.select(c, F.col("low").alias(f"low_{c}"), F.left("low", F.lit(GRAM)).alias("gram"))
    sizes = F.sequence(F.lit(1), F.lit(GRAM))
    starts = F.transform(F.sequence(F.lit(1), F.length("low")), lambda i: F.transform(sizes, lambda n: F.substr("low", i, n)))
    pieces = lambda df, c: df.select(c, F.col("low").alias(f"low_{c}"), F.explode(F.array_distinct(F.flatten(starts))).alias("gram"))
    within = first(wanted, "name").join(pieces(held, "subject").hint("shuffle_merge"), "gram").filter("contains(low_subject, low_name)")
    around = first(held, "subject").join(pieces(wanted, "name").hint("shuffle_merge"), "gram").filter("contains(low_name, low_subject)")
    return within.select("name", "subject").unionByName(around.select("name", "subject")).distinct()


def pending_view(pending: DataFrame, limit: int = 100) -> DataFrame:
    """The newest waiting entries."""
    return pending.orderBy(F.desc("created_at"), F.desc("session_id")).limit(limit)


def inbox(pending: DataFrame, sessions: DataFrame, files: DataFrame) -> DataFrame:
    """What waits for a decision, what waits for an answer, and what waits in vain: section, provider, entries. sessions: session_id, agent, status,
    source_file; files: path."""
    there = files.select(F.col("path").alias("source_file"), F.lit(True).alias("there")).distinct()
    waits = sessions.filter("status = 'pending-extraction'").join(there.hint("shuffle_merge"), "source_file", "left")
    by_agent = waits.groupBy(F.when(F.col("there"), "waiting").otherwise("gone").alias("section"), F.col("agent").alias("provider")).agg(F.count(F.lit(1)).alias("entries"))
    return pending.groupBy(F.lit("pending").alias("section"), F.regexp_replace("reason", ":.*", "").alias("provider")).agg(F.count(F.lit(1)).alias("entries")).unionByName(by_agent)


def usage(rows: DataFrame) -> DataFrame:
    """rows: provider, tokens, cost. Calls, tokens and cost by provider; a provider of which no call has a price has no cost, not a cost of
    nothing, and unpriced counts the calls without one."""
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").cast("long").alias("tokens"), F.round(F.sum("cost"), 4).alias("cost"), F.count_if(F.col("cost").isNull()).alias("unpriced"))


def rereads(readings: DataFrame, now: str | None = None, days: int = 7, over: int = 3) -> DataFrame:
    """readings: note, at, kind. Notes that scans read more than `over` times in the last `days`, up to now or the newest reading."""
    last = readings.agg(F.coalesce(F.lit(now).cast("timestamp"), F.max("at")).alias("now"))
    recent_ = readings.filter("kind = 'scan'").crossJoin(F.broadcast(last)).filter(F.col("at") > F.col("now") - F.expr(f"INTERVAL {days} DAYS"))  # one row
    return recent_.groupBy("note").agg(F.count(F.lit(1)).alias("readings")).filter(F.col("readings") > over)
