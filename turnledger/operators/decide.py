"""What people decide and what follows: queue verdicts, withdrawals by hand, restores, moves, and memory derived anew.

claims: session_id, date, ord, subject, subject_kind, key, claim, confidence. withdrawals: the same with created_at, retracted_at, reason.
A slot is a subject and a key, trimmed. Tables go in and tables come out; nothing is changed in place."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import claim_form, composed, equivalent
from ..sources.scratch import written
from . import reconcile

CLAIM = ("session_id", "date", "ord", "subject", "subject_kind", "key", "claim", "confidence")
GONE = (*CLAIM, "created_at", "retracted_at", "reason")


class Notes(NamedTuple):
    claims: DataFrame
    withdrawals: DataFrame


def _slot(df: DataFrame) -> DataFrame:
    """With _s and _k, the trimmed slot."""
    return df.withColumns({"_s": F.trim("subject"), "_k": F.trim("key")})


def in_slot(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """Rows (subject, key) whose slot some claim fills."""
    return _slot(rows).join(_slot(claims).select("_s", "_k").distinct().hint("shuffle_merge"), ["_s", "_k"], "left_semi").drop("_s", "_k")


def decide(pending: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """verdicts: session_id, subject, key, claim, verdict (accepted or rejected), at; the latest of an entry counts. The queue with status, and
    what was accepted as claims of confidence 1 at the verdict's own date."""
    key = ["session_id", "subject", "key", "claim"]
    last = verdicts.groupBy(*key).agg(F.max_by(F.struct("verdict", "at"), "at").alias("v"))
    queue = pending.join(last.hint("shuffle_merge"), key, "left").withColumn("status", F.coalesce("v.verdict", F.lit("waiting")))
    accepts = queue.filter("status = 'accepted'").select("session_id", F.col("v.at").alias("date"), F.lit(0).cast("long").alias("ord"), "subject", "subject_kind", "key", "claim", F.lit(1.0).alias("confidence"))
    return queue.drop("v"), accepts


def retract(notes: Notes, slots: DataFrame, facts: DataFrame) -> tuple[Notes, DataFrame]:
    """slots: subject, key, at, reason. The first claim of the slot in every note that makes one is withdrawn there. The second table tells each
    slot's outcome: withdrawn, no-reason, only-table (live, but no note claims it) or nothing."""
    asked = _slot(slots).groupBy("_s", "_k").agg(F.max(F.struct("at", "reason")).alias("w"))
    claims = written(_slot(notes.claims))
    known = claims.select("_s", "_k").distinct().withColumn("claimed", F.lit(True))
    held = _slot(reconcile.live(facts)).select("_s", "_k").distinct().withColumn("held", F.lit(True))
    judged = asked.join(known.hint("shuffle_merge"), ["_s", "_k"], "left").join(held.hint("shuffle_merge"), ["_s", "_k"], "left")
    outcome = F.when(F.trim(F.coalesce("w.reason", F.lit(""))) == "", "no-reason").when(F.col("claimed"), "withdrawn").when(F.col("held"), "only-table").otherwise("nothing")
    judged = written(judged.select("_s", "_k", "w", outcome.alias("outcome")))
    goes = judged.filter("outcome = 'withdrawn'").select("_s", "_k", "w")
    marked = written(claims.join(goes.hint("shuffle_merge"), ["_s", "_k"], "left").withColumn("nth", F.when(F.col("w").isNotNull(), F.row_number().over(Window.partitionBy("session_id", "_s", "_k").orderBy("ord")))))
    gone = marked.filter("nth = 1").select(*CLAIM, F.col("date").alias("created_at"), F.col("w.at").alias("retracted_at"), F.col("w.reason").alias("reason"))
    left = marked.filter("nth IS NULL OR nth > 1").select(*CLAIM)
    return Notes(left, notes.withdrawals.select(*GONE).unionByName(gone)), judged.select(F.col("_s").alias("subject"), F.col("_k").alias("key"), "outcome")


def restore(notes: Notes, requests: DataFrame, moves: DataFrame) -> tuple[Notes, DataFrame]:
    """requests: subject, key, session_id (null: the one note that withdrew the slot), confirm. moves: session_id, subject, key, to_subject, to_key. The
    latest withdrawn wording of the slot goes back among its note's claims, at confidence 1 if confirmed. Outcomes: restored, ambiguous
    (several notes; candidates tells how many), moved (to tells where), nothing."""
    asked = _slot(requests).select("_s", "_k", F.col("session_id").alias("named"), "confirm").distinct()
    gone = _slot(notes.withdrawals).withColumn("nth", F.row_number().over(Window.partitionBy("session_id", F.trim("subject"), F.trim("key")).orderBy(F.desc("retracted_at"), F.desc("ord"))))
    gone = written(gone)
    claimed = _slot(notes.claims).select("session_id", "_s", "_k").distinct()
    holding = gone.filter("nth = 1").join(claimed.hint("shuffle_merge"), ["session_id", "_s", "_k"], "left_anti")
    found = asked.join(holding.hint("shuffle_merge"), ["_s", "_k"], "left").filter("named IS NULL OR session_id IS NULL OR session_id = named")
    sent = _slot(moves).groupBy("session_id", "_s", "_k").agg(F.min(F.concat_ws(".", "to_subject", "to_key")).alias("to"))
    found = written(found.join(sent.hint("shuffle_merge"), ["session_id", "_s", "_k"], "left"))
    every = asked.join(found.groupBy("_s", "_k").agg(F.count("session_id").alias("candidates"), F.min("to").alias("to")).hint("shuffle_merge"), ["_s", "_k"], "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
    outcome = F.when(F.col("candidates") == 0, "nothing").when(F.col("candidates") > 1, "ambiguous").when(F.col("to").isNotNull(), "moved").otherwise("restored")
    every = written(every.withColumn("outcome", outcome))
    back = every.filter("outcome = 'restored'").select("_s", "_k")
    rows = found.join(back.hint("shuffle_merge"), ["_s", "_k"], "left_semi")
    claims = notes.claims.select(*CLAIM).unionByName(rows.select(*CLAIM[:-1], F.when(F.col("confirm"), 1.0).otherwise(F.col("confidence")).alias("confidence")))
    left = gone.join(rows.select("session_id", "_s", "_k", "nth").hint("shuffle_merge"), ["session_id", "_s", "_k", "nth"], "left_anti").select(*GONE)
    return Notes(claims, left), every.select(F.col("_s").alias("subject"), F.col("_k").alias("key"), "outcome", "candidates", "to")


def check_plan(plan: DataFrame, notes: Notes, facts: DataFrame) -> DataFrame:
    """plan: ord, subject, key, to_subject, to_key. Why it may not be applied: ord, refusal. One refusal refuses the whole plan. Refused are a
    slot that moves to itself, a source that repeats or is a target, one that no note claims, and a target that memory has known, unless
    all it has ever held there is the moving sessions' own withdrawn wording."""
    p = written(_slot(plan).withColumns({"ts": F.trim("to_subject"), "tk": F.trim("to_key")}).select("ord", "_s", "_k", "ts", "tk"))
    claims = written(_slot(notes.claims).select("session_id", "_s", "_k").distinct())
    gone = written(_slot(notes.withdrawals).select("session_id", "_s", "_k").distinct())
    held = _slot(facts).select("session_id", "_s", "_k", (F.col("superseded_at").isNull() & F.col("retracted_at").isNull()).alias("alive"))
    same = p.filter("_s = ts AND _k = tk").select("ord", F.lit("same-slot").alias("refusal"))
    repeats = p.withColumn("nth", F.row_number().over(Window.partitionBy("_s", "_k").orderBy("ord"))).filter("nth > 1").select("ord", F.lit("source-repeats").alias("refusal"))
    chained = p.join(p.select(F.col("ts").alias("_s"), F.col("tk").alias("_k")).distinct().hint("shuffle_merge"), ["_s", "_k"], "left_semi").select("ord", F.lit("source-is-target").alias("refusal"))
    unknown = p.join(claims.select("_s", "_k").distinct().hint("shuffle_merge"), ["_s", "_k"], "left_anti").select("ord", F.lit("no-note").alias("refusal"))
    # what every session has said of a target slot: alive or claimed is in the way, withdrawn only from a session that does not move there
    at = {"_s": "ts", "_k": "tk"}
    movers = p.join(claims.hint("shuffle_merge"), ["_s", "_k"]).select("ts", "tk", "session_id", F.lit(True).alias("mover")).distinct()
    said = claims.select("session_id", "_s", "_k", F.lit(True).alias("alive")).unionByName(gone.select("session_id", "_s", "_k", F.lit(False).alias("alive"))).unionByName(held)
    said = said.withColumnsRenamed(at).groupBy("ts", "tk", "session_id").agg(F.max("alive").alias("alive")).join(movers.hint("shuffle_merge"), ["ts", "tk", "session_id"], "left")
    taken = said.filter("alive OR mover IS NULL").select("ts", "tk").distinct()
    known = p.join(taken.hint("shuffle_merge"), ["ts", "tk"], "left_semi").select("ord", F.lit("target-known").alias("refusal"))
    out = same
    for part in (repeats, chained, unknown, known):
        out = out.unionByName(part)
    return out


def move(notes: Notes, plan: DataFrame, at: str, reason: str) -> tuple[Notes, DataFrame]:
    """The notes with the plan applied (see check_plan, which comes first): claims filed at the target, a withdrawal that records where each went, and the
    ledger (session_id, subject, key, to_subject, to_key, at, reason) that a re-read follows."""
    p = _slot(plan).select("_s", "_k", F.trim("to_subject").alias("to_subject"), F.trim("to_key").alias("to_key"), "kind")
    j = written(_slot(notes.claims).join(p.hint("shuffle_merge"), ["_s", "_k"], "left"))
    hit = F.col("to_subject").isNotNull()
    claims = j.select("session_id", "date", "ord", F.when(hit, F.col("to_subject")).otherwise(F.col("subject")).alias("subject"), F.when(hit, F.col("kind")).otherwise(F.col("subject_kind")).alias("subject_kind"), F.when(hit, F.col("to_key")).otherwise(F.col("key")).alias("key"), "claim", "confidence")
    moved = j.filter(hit)
    why = F.concat(F.lit("نُقل إلى "), "to_subject", F.lit("."), "to_key", F.lit(f" — {reason}"))
    gone = moved.select(*CLAIM, F.col("date").alias("created_at"), F.lit(at).alias("retracted_at"), why.alias("reason"))
    ledger = moved.select("session_id", F.col("_s").alias("subject"), F.col("_k").alias("key"), "to_subject", "to_key", F.lit(at).alias("at"), F.lit(reason).alias("reason")).distinct()
    return Notes(claims, notes.withdrawals.select(*GONE).unionByName(gone)), ledger


def derived(notes: Notes, accepts: DataFrame | None = None) -> reconcile.Folded:
    """Everything from the notes and the verdicts alone."""
    w = notes.withdrawals.select(*(c for c in GONE if c != "reason"))
    return reconcile.replay(reconcile.events(notes.claims, w, accepts))


def move_preview(before: Notes, after: Notes, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Live facts and subjects before and after, and the source subjects that no claim speaks of any more."""
    counts = [reconcile.live(derived(n).facts).agg(F.lit(name).alias("state"), F.count(F.lit(1)).alias("facts"), F.count_distinct("subject").alias("subjects")) for name, n in (("before", before), ("after", after))]
    still = after.claims.select(F.trim("subject").alias("subject")).distinct()
    return counts[0].unionByName(counts[1]), plan.select(F.trim("subject").alias("subject")).distinct().join(still.hint("shuffle_merge"), "subject", "left_anti")


#: What makes a replayed row and one of the table the same row; of several such rows the first pairs with the first.
SAME_ROW = ("subject", "session_id", "key", "claim", "confidence")
_ENDS = ("superseded_by", "superseded_at", "retracted_at", "created_at")


def _nth(df: DataFrame) -> DataFrame:
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*SAME_ROW).orderBy("seq")))


def lay_onto(replayed: DataFrame, existing: DataFrame, at: str) -> DataFrame:
    """The table (facts, whose seq names a row of its subject for good) with the replay of the same subjects laid onto it. No row ever disappears.

    Rows that pair keep their seq and take their history from the replay; replayed rows without a partner get the next free seq of their subject. A live row that the replay
    does not have any more is superseded by an equivalent live wording of its own session and key, the first, else withdrawn at `at`. Rows that were accepted (confidence 1) and withdrawn by hand are
    never touched; a replayed row that is the like, withdrawn too, is taken for that row, so that laying twice changes nothing. Adds was_superseded and was_retracted, how a row stood before, and is_new."""
    shielded = (F.col("confidence") >= 1) & F.col("retracted_at").isNotNull()
    table = written(existing.select("subject", *(c for c in existing.columns if c != "subject")).withColumn("shielded", shielded))
    old = _nth(table.filter("NOT shielded"))
    safe_ids = _nth(table.filter("shielded")).select(*SAME_ROW, "nth", F.col("seq").alias("safe"))
    like = _nth(replayed.filter(shielded)).join(safe_ids.hint("shuffle_merge"), [*SAME_ROW, "nth"], "left").drop("nth")
    like = written(replayed.filter(~shielded).withColumn("safe", F.lit(None).cast("long")).unionByName(like))
    new = _nth(like.filter("safe IS NULL"))
    held = old.select(*SAME_ROW, "nth", F.col("seq").alias("id"), F.struct("superseded_at", "retracted_at").alias("was"))
    last = table.groupBy("subject").agg(F.max("seq").alias("last"))
    met = new.join(held.hint("shuffle_merge"), [*SAME_ROW, "nth"], "left").join(last.hint("shuffle_merge"), "subject", "left")
    fresh = F.sum(F.when(F.col("id").isNull(), 1).otherwise(0)).over(Window.partitionBy("subject").orderBy("seq"))
    met = written(met.withColumns({"is_new": F.col("id").isNull(), "id": F.coalesce("id", F.coalesce("last", F.lit(0)) + fresh)}))
    # what supersedes a row is named by its place in the replay; the table knows it by its own number
    ids = met.select("subject", "seq", "id").unionByName(like.filter("safe IS NOT NULL").select("subject", "seq", F.col("safe").alias("id")))
    ids = ids.select("subject", F.col("seq").alias("superseded_by"), F.col("id").alias("successor"))
    now = met.join(ids.hint("shuffle_merge"), ["subject", "superseded_by"], "left")
    base = ["subject", "key", "subject_kind", "claim", "confidence", "session_id"]
    out = now.select(*base, F.col("id").alias("seq"), F.col("successor").alias("superseded_by"), "superseded_at", "retracted_at", "created_at", F.col("was.superseded_at").alias("was_superseded"), F.col("was.retracted_at").alias("was_retracted"), "is_new")
    kept = met.select("subject", F.col("id").alias("seq")).filter("NOT is_new")
    left = written(old.drop("nth").join(kept.hint("shuffle_merge"), ["subject", "seq"], "left_anti"))
    alive = F.col("superseded_at").isNull() & F.col("retracted_at").isNull()
    wording = met.filter(alive).select("subject", "session_id", "key", F.struct(F.col("seq").alias("place"), F.col("id").alias("id"), F.col("created_at").alias("at")).alias("heir"), F.col("claim").alias("form"))
    wording = composed(wording, "form").withColumn("form", claim_form(F.col("form")))
    near = composed(left.filter(alive).select("subject", "session_id", "key", "seq", F.col("claim").alias("old_form")), "old_form").withColumn("old_form", claim_form(F.col("old_form")))
    near = near.join(wording.hint("shuffle_merge"), ["subject", "session_id", "key"])
    heirs = near.filter(equivalent(F.col("form"), F.col("old_form"))).groupBy("subject", "seq").agg(F.min("heir").alias("heir"))
    rest = left.join(heirs.hint("shuffle_merge"), ["subject", "seq"], "left")
    was = [F.col("superseded_at").alias("was_superseded"), F.col("retracted_at").alias("was_retracted"), F.lit(False).alias("is_new")]
    gone = alive & F.col("heir").isNull()
    rest = rest.select(*base, "seq", F.coalesce("superseded_by", F.when(alive, F.col("heir.id"))).alias("superseded_by"), F.coalesce("superseded_at", F.when(alive, F.col("heir.at"))).alias("superseded_at"),
        F.coalesce("retracted_at", F.when(gone, F.lit(at))).alias("retracted_at"), "created_at", *was)
    safe = table.filter("shielded").select(*base, "seq", *_ENDS, *was)
    return out.unionByName(rest).unionByName(safe)


def changes_of(laid: DataFrame) -> DataFrame:
    """What lay_onto did, one row a change: inserted, superseded, retracted or restored, with the row's subject, seq, session_id, key, claim and confidence."""
    ended, was_ended = F.col("superseded_at").isNotNull(), F.col("was_superseded").isNotNull()
    gone, was_gone = F.col("retracted_at").isNotNull(), F.col("was_retracted").isNotNull()
    kinds = {"inserted": F.col("is_new"), "superseded": ended & ~was_ended, "retracted": gone & ~was_gone, "restored": ~F.col("is_new") & ((was_ended & ~ended) | (was_gone & ~gone))}
    found = F.filter(F.array(*(F.when(c, F.lit(k)) for k, c in kinds.items())), lambda c: c.isNotNull())
    return laid.withColumn("change", F.explode(found)).select("subject", "seq", "session_id", "key", "claim", "confidence", "change")


def rebase(existing: DataFrame, notes: Notes, touched: DataFrame, at: str, accepts: DataFrame | None = None) -> DataFrame:
    """Facts, where the touched subjects (subject) are derived anew from all their notes and laid onto what is there; the rest stay as they are. As a
    subject depends on its own claims alone, what is live then equals deriving all, in whatever order sessions arrived; it costs what the touched subjects' notes cost."""
    which = touched.select(F.trim("subject").alias("_s")).distinct().hint("shuffle_merge")
    ours = lambda df: df.withColumn("_s", F.trim("subject")).join(which, "_s", "left_semi").drop("_s")
    new = derived(Notes(ours(notes.claims), ours(notes.withdrawals)), None if accepts is None else ours(accepts)).facts
    kept = existing.withColumn("_s", F.trim("subject")).join(which, "_s", "left_anti").drop("_s")
    return kept.unionByName(lay_onto(new, ours(existing), at).select(*existing.columns))


_QUEUE = ("session_id", "subject", "key", "subject_kind", "claim", "confidence", "reason", "created_at", "status")


def _first_free(raised: list[tuple[str, str]], queue: list[tuple[str, str]]) -> dict[int, int]:
    """raised and queue: claims and their forms, in order. Which entry each raised claim meets: verbatim first, then equivalent, each time the first free entry."""
    paired: dict[int, int] = {}
    for same in (lambda a, b: a[0] == b[0], lambda a, b: reconcile.same_claim(a[1], b[1])):
        for i, r in enumerate(raised):
            if i not in paired:
                free = (j for j, q in enumerate(queue) if j not in paired.values() and same(r, q))
                if (hit := next(free, None)) is not None:
                    paired[i] = hit
    return paired


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slot, entries of the queue before raised ones, each in order. A slot is one session's word on one key, and held as a whole."""

    def close(rows: list[dict]) -> Iterator[dict]:
        queue, raised = [r for r in rows if not r["raised"]], [r for r in rows if r["raised"]]
        met = _first_free([(r["claim"], r["form"]) for r in raised], [(q["claim"], q["form"]) for q in queue])
        still = set(met.values())
        for j, q in enumerate(queue):
            was = q["status"]
            yield q | {"status": "waiting" if j in still and was == "obsolete" else "obsolete" if j not in still and was == "waiting" else was}
        yield from (r | {"status": "waiting"} for i, r in enumerate(raised) if i not in met)

    held: list[dict] = []
    schema = pa.schema([(c, pa.float64() if c == "confidence" else pa.string()) for c in _QUEUE])
    for batch in batches:
        out: list[dict] = []
        for r in batch.to_pylist():
            if held and any(r[c] != held[0][c] for c in _QUEUE[:3]):
                out += close(held)
                held = []
            held.append(r)
        if out:
            yield pa.RecordBatch.from_pylist([{c: r[c] for c in _QUEUE} for r in out], schema=schema)
    if held:
        yield pa.RecordBatch.from_pylist([{c: r[c] for c in _QUEUE} for r in close(held)], schema=schema)


def settle_queue(raised: DataFrame, queue: DataFrame) -> DataFrame:
    """raised: what a replay queues now; queue: what is there, with status. Both: session_id, subject, subject_kind, key, claim, confidence, reason, created_at. A verdict
    stays with its claim however it is worded now: in each slot raised claims and entries pair off one to one, in order of date and claim, verbatim ones first, then equivalent
    ones. What is raised no more is obsolete, what was obsolete and is raised again waits, and what meets no entry is a new one."""
    base = [c for c in _QUEUE if c not in ("status", "confidence")]
    worded = lambda df: composed(df.withColumn("_said", F.col("claim")), "_said")
    as_rows = lambda df, status, is_raised: worded(df).select(*(F.col(c).cast("string").alias(c) for c in base), F.col("confidence").cast("double").alias("confidence"), status.cast("string").alias("status"), claim_form(F.col("_said")).alias("form"), F.lit(is_raised).alias("raised"))
    rows = as_rows(queue, F.col("status"), False).unionByName(as_rows(raised, F.lit(None), True))
    slot = ["subject", "session_id", "key"]
    schema = ", ".join(f"{c} {'double' if c == 'confidence' else 'string'}" for c in _QUEUE)
    return rows.repartition(*slot).sortWithinPartitions(*slot, "raised", "created_at", "claim").mapInArrow(_settled, schema)
