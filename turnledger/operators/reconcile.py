"""The fold of claims into a history of single-valued slots.

Events of a subject are read in session-date order: withdrawals of a note, its claims, then accepted queue
entries. One task streams over its subjects and holds the live facts of the one at hand, so memory follows the
number of slots, not the length of a history.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise
from ..sources.scratch import written

FLOOR, MARGIN = 0.75, 0.1

EVENT_COLUMNS = ("subject", "date", "session_id", "rank", "ord", "subject_kind", "key", "claim", "confidence", "created_at", "reason")
_OUT = "row string, subject string, seq long, key string, subject_kind string, claim string, confidence double, session_id string, created_at string, superseded_by long, superseded_at string, retracted_at string, outcome string, reason string, ord long"
_NAMES = [x.split()[0] for x in _OUT.split(", ")]
_ARROW = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "double": pa.float64()}[t]) for n, t in (x.split() for x in _OUT.split(", "))])

WITHDRAW, CLAIM, ACCEPT = 0, 1, 2


class Folded(NamedTuple):
    facts: DataFrame
    pending: DataFrame
    outcomes: DataFrame


def same_claim(a: str, b: str) -> bool:
    return a == b or (len(a) > 12 and len(b) > 12 and (a in b or b in a))


def may_override(confidence: float, held: float, floor: float, margin: float = MARGIN) -> bool:
    return confidence >= floor and confidence >= held - margin


class Subject:
    """Live facts of one subject, and what its current note withdrew."""

    def __init__(self, name: str, floor: float, margin: float):
        self.name, self.floor, self.margin = name, floor, margin
        self.seq, self.live, self.withdrawn, self.note = 0, {}, {}, None

    def row(self, kind: str, e: dict, **more) -> dict:
        return {
            "row": kind, "subject": self.name, "key": e["key"], "subject_kind": e["subject_kind"], "claim": e["claim"], "confidence": e["confidence"], "session_id": e["session_id"], "ord": e["ord"], **more,
        }

    def insert(self, e: dict, at: str) -> dict:
        self.seq += 1
        return self.row("fact", e, seq=self.seq, created_at=at) | {"form": e["form"]}

    def end_note(self) -> Iterator[dict]:
        for rows in self.withdrawn.values():
            yield from rows
        self.withdrawn = {}

    def apply(self, e: dict) -> Iterator[dict]:
        if self.note != (e["date"], e["session_id"]):
            yield from self.end_note()
            self.note = (e["date"], e["session_id"])
        e["form"] = " ".join(normalise(e["claim"]).split())
        held = self.live.get(e["key"])
        if e["rank"] == WITHDRAW:
            when = e["created_at"] or e["date"]
            if held and same_claim(held["form"], e["form"]):
                gone = self.live.pop(e["key"]) | {"retracted_at": e["reason"]}
            else:
                gone = self.insert(e, when) | {"retracted_at": e["reason"]}
                if held and may_override(e["confidence"], held["confidence"], self.floor, self.margin):
                    yield self.live.pop(e["key"]) | {"superseded_by": gone["seq"], "superseded_at": when}
            self.withdrawn.setdefault(e["key"], []).append(gone)
            yield self.row("outcome", e, outcome="withdrawn")
            return
        floor = 0.0 if e["rank"] == ACCEPT else self.floor
        reason = None
        if not held:
            if any(same_claim(f["form"], e["form"]) for f in self.live.values()):
                outcome = "unchanged"
            elif e["confidence"] < floor:
                outcome, reason = "queued", "below-confidence-floor"
            else:
                outcome = "added"
        elif same_claim(held["form"], e["form"]):
            outcome = "unchanged"
        elif may_override(e["confidence"], held["confidence"], floor, self.margin):
            outcome = "superseded"
        else:
            outcome, reason = "queued", "conflicts-with:" + held["claim"][:120]
        if outcome in ("added", "superseded"):
            new = self.insert(e, e["date"])
            if held:
                yield held | {"superseded_by": new["seq"], "superseded_at": e["date"]}
            # what this note withdrew from the slot was replaced: each wording points at the next, the last here
            replaced = self.withdrawn.pop(e["key"], [])
            for old, later in zip(replaced, [*replaced[1:], new], strict=False):
                yield old | {"retracted_at": None, "superseded_by": later["seq"], "superseded_at": new["created_at"]}
            self.live[e["key"]] = new
        elif outcome == "queued":
            yield self.row("pending", e, created_at=e["date"], reason=reason)
        yield self.row("outcome", e, outcome=outcome, reason=reason, created_at=e["date"])

    def close(self) -> Iterator[dict]:
        yield from self.end_note()
        yield from self.live.values()


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    """The batch's rows; texts are taken out of Arrow a column at once."""
    columns = [c.to_numpy(zero_copy_only=False).tolist() if pa.types.is_string(c.type) else c.to_pylist() for c in batch.columns]
    names = batch.schema.names
    for row in zip(*columns, strict=True):
        yield dict(zip(names, row, strict=True))


def _fold(floor: float, margin: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        subject: Subject | None = None
        out: list[dict] = []
        for batch in batches:
            for e in _dicts(batch):
                if subject is None or e["subject"] != subject.name:
                    if subject:
                        out += subject.close()
                    subject = Subject(e["subject"], floor, margin)
                out += subject.apply(e)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_ARROW)
                out = []
        if subject:
            yield pa.RecordBatch.from_pylist(list(subject.close()), schema=_ARROW)

    return run


def replay(events: DataFrame, floor: float = FLOOR, margin: float = MARGIN) -> Folded:
    """events: EVENT_COLUMNS, with rank 0 for withdrawals (reason: the withdrawal's date), 1 for claims, 2 for
    accepted entries. Rows without a subject, key or claim are passed over. facts carry seq, the position in
    their subject's replay; live means neither superseded_at nor retracted_at."""
    clean = events.select(
        F.trim("subject").alias("subject"), F.coalesce(F.col("date").cast("string"), F.lit("")).alias("date"), F.col("session_id").cast("string").alias("session_id"),
        F.col("rank").cast("int").alias("rank"), F.col("ord").cast("long").alias("ord"), "subject_kind", F.trim("key").alias("key"), "claim",
        F.col("confidence").cast("double").alias("confidence"), "created_at", "reason",
    ).filter("subject <> '' AND key <> '' AND trim(claim) <> ''")
    order = ["subject", "date", "session_id", "rank", "ord"]
    # written once: facts, queue and outcomes are three readings of one fold
    rows = written(clean.repartition("subject").sortWithinPartitions(*order).mapInArrow(_fold(floor, margin), _OUT))
    fact = ["subject", "seq", "key", "subject_kind", "claim", "confidence", "session_id", "created_at", "superseded_by", "superseded_at", "retracted_at"]
    return Folded(
        rows.filter("row = 'fact'").select(*fact),
        rows.filter("row = 'pending'").select("subject", "subject_kind", "key", "claim", "confidence", "reason", "session_id", "created_at"),
        rows.filter("row = 'outcome'").select("subject", "key", "session_id", "ord", "claim", "confidence", "outcome", "reason"),
    )


def events(claims: DataFrame, withdrawals: DataFrame | None = None, accepts: DataFrame | None = None) -> DataFrame:
    """One event table of claims (date, session_id, ord, subject, subject_kind, key, claim, confidence),
    withdrawals (the same with created_at and retracted_at) and accepted queue entries (the same as claims)."""
    base = ["subject", "date", "session_id", "ord", "subject_kind", "key", "claim", "confidence"]
    nothing = F.lit(None).cast("string")
    out = claims.select(*base, F.lit(CLAIM).alias("rank"), nothing.alias("created_at"), nothing.alias("reason"))
    if withdrawals is not None:
        out = out.unionByName(withdrawals.select(*base, F.lit(WITHDRAW).alias("rank"), "created_at", F.col("retracted_at").alias("reason")))
    if accepts is not None:
        out = out.unionByName(accepts.select(*base[:-1], F.lit(1.0).alias("confidence"), F.lit(ACCEPT).alias("rank"), nothing.alias("created_at"), nothing.alias("reason")))
    return out


def live(facts: DataFrame) -> DataFrame:
    return facts.filter("superseded_at IS NULL AND retracted_at IS NULL")


def current(facts: DataFrame) -> DataFrame:
    """The last live fact of each slot."""
    row = F.struct("seq", *[c for c in facts.columns if c != "seq"])
    return live(facts).groupBy("subject", "key").agg(F.max_by(row, "seq").alias("f")).select("f.*")


def history(facts: DataFrame) -> DataFrame:
    """Every row of every slot with its state and the date it ended."""
    state = F.when(F.col("retracted_at").isNotNull(), "retracted").when(F.col("superseded_at").isNotNull(), "superseded").otherwise("live")
    return facts.withColumns({"state": state, "until": F.coalesce("retracted_at", "superseded_at")})


def facts_as_of(facts: DataFrame, probes: DataFrame) -> DataFrame:
    """probes: subject, date and what else they carry, the pair (subject, date) being a probe's key. Facts that were live strictly
    before the date.

    Facts and probes of a slot are read in one sorted stream: what a probe meets is the last fact opened before it. Withdrawn
    facts, which need not stand in a slot's sequence, are few and meet their subject's probes."""
    when = probes.select("subject", "date").distinct()
    sequence = facts.filter("retracted_at IS NULL")
    slots = sequence.select("subject", "key").distinct()
    asked = when.join(slots.hint("shuffle_merge"), "subject").select("subject", "key", F.col("date").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("seq"))
    opened = sequence.select("subject", "key", F.col("created_at").alias("at"), F.lit(1).alias("kind"), "seq")
    # at equal dates the probe comes first: a fact of the same date is not yet known
    order = Window.partitionBy("subject", "key").orderBy("at", "kind", "seq")
    met = asked.unionByName(opened).withColumn("last", F.last("seq", ignorenulls=True).over(order)).filter("kind = 0 AND last IS NOT NULL")
    chain = met.select("subject", F.col("at").alias("date"), F.col("last").alias("seq")).join(sequence.hint("shuffle_merge"), ["subject", "seq"]).filter("superseded_at IS NULL OR superseded_at >= date")
    gone = facts.filter("retracted_at IS NOT NULL").join(when.hint("shuffle_merge"), "subject").filter("created_at < date AND least(superseded_at, retracted_at) >= date")
    live_then = chain.unionByName(gone)
    return probes.join(live_then.hint("shuffle_merge"), ["subject", "date"])
