"""A replay laid onto a table, and the queue's pairing, against plain Python."""

import random

import pytest

from turnledger.operators import decide
from turnledger.operators import reconcile as fold

FACT = "subject string, seq long, key string, subject_kind string, claim string, confidence double, session_id string, created_at string, superseded_by long, superseded_at string, retracted_at string"
CLAIM = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double"
GONE = CLAIM + ", created_at string, retracted_at string, reason string"
ROW = ("subject", "seq", "key", "claim", "confidence", "session_id", "created_at", "superseded_by", "superseded_at", "retracted_at")


def plain(replayed, existing, at):
    """Rows as dicts, one after another."""
    out = [dict(r) for r in existing]
    for subject in {r["subject"] for r in [*replayed, *existing]}:
        new = sorted((r for r in replayed if r["subject"] == subject), key=lambda r: r["seq"])
        old = sorted((r for r in out if r["subject"] == subject and not (r["confidence"] >= 1 and r["retracted_at"])), key=lambda r: r["seq"])
        free, ids = list(old), {}
        safe = sorted((r for r in out if r["subject"] == subject and r["confidence"] >= 1 and r["retracted_at"]), key=lambda r: r["seq"])
        for s in list(new):
            hit = next((e for e in safe if s["confidence"] >= 1 and s["retracted_at"] and all(e[c] == s[c] for c in ("session_id", "key", "claim", "confidence"))), None)
            if hit is not None:
                safe.remove(hit)
                ids[s["seq"]] = hit
                new.remove(s)
        last = max((r["seq"] for r in out if r["subject"] == subject), default=0)
        for s in new:
            hit = next((e for e in free if all(e[c] == s[c] for c in ("session_id", "key", "claim", "confidence"))), None)
            if hit is None:
                last += 1
                hit = dict(s, seq=last)
                out.append(hit)
            else:
                free.remove(hit)
            ids[s["seq"]] = hit
        for s in new:
            ids[s["seq"]].update(superseded_at=s["superseded_at"], retracted_at=s["retracted_at"], created_at=s["created_at"], superseded_by=ids[s["superseded_by"]]["seq"] if s["superseded_by"] else None)
        for e in free:
            if not e["superseded_at"] and not e["retracted_at"]:
                heir = next((s for s in new if not s["superseded_at"] and not s["retracted_at"] and s["session_id"] == e["session_id"] and s["key"] == e["key"] and fold.same_claim(s["claim"], e["claim"])), None)
                e.update({"superseded_by": ids[heir["seq"]]["seq"], "superseded_at": heir["created_at"]} if heir else {"retracted_at": at})
    return sorted(tuple(str(r[c]) for c in ROW) for r in out)


def said(r, n):
    words = ["claim of some length", "claim of some length and more", "claim of some length and more still", "short", "another claim altogether"]
    return [(f"s{r.randrange(6)}", f"d{r.randrange(4)}", i, f"x{r.randrange(2)}", "term", f"k{r.randrange(2)}", r.choice(words), r.choice([0.6, 0.8, 0.9, 1.0])) for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_lay_onto(spark, seed):
    r = random.Random(seed)
    before, after = said(r, 14), said(r, 14)
    after += r.sample(before, 8)  # some claims stay, some are lost, some are worded anew
    gone = [(*c[:7], 0.9, c[1], c[1], "r") for c in r.sample(before, 3)]
    old = decide.derived(decide.Notes(spark.createDataFrame(before, CLAIM), spark.createDataFrame(gone, GONE))).facts
    hand = spark.createDataFrame([("x0", 900, "k0", "term", "claim of some length", 1.0, "s0", "d0", None, None, "d9"), ("x7", 1, "k0", "term", "alone here", 0.9, "s0", "d0", None, None, None)], FACT)
    old = old.unionByName(hand)
    new = decide.derived(decide.Notes(spark.createDataFrame(after, CLAIM), spark.createDataFrame(gone[:1], GONE))).facts
    laid = decide.lay_onto(new, old, "d9")
    rows = [x.asDict() for x in laid.collect()]
    held, replayed = ([x.asDict() for x in df.collect()] for df in (old, new))
    assert sorted(tuple(str(x[c]) for c in ROW) for x in rows) == plain(replayed, held, "d9")
    was = {(x["subject"], x["seq"]): x for x in held}
    assert set(was) <= {(x["subject"], x["seq"]) for x in rows}  # no row disappears
    want = set()
    for x in rows:
        b = was.get((x["subject"], x["seq"]))
        if b is None:
            want.add((x["subject"], x["seq"], "inserted"))
        b = b or {"superseded_at": None, "retracted_at": None}
        for c, kind in (("superseded_at", "superseded"), ("retracted_at", "retracted")):
            if x[c] and not b[c]:
                want.add((x["subject"], x["seq"], kind))
            if b[c] and not x[c]:
                want.add((x["subject"], x["seq"], "restored"))
    assert {(c.subject, c.seq, c.change) for c in decide.changes_of(laid).collect()} == want
    again = decide.lay_onto(new, laid.select(*old.columns), "d10")  # laid twice, nothing changes
    assert sorted(tuple(str(x[c]) for c in ROW) for x in (y.asDict() for y in again.collect())) == plain(replayed, held, "d9")


def greedy(raised, queue):
    """Statuses after pairing: (claim, created_at, status) of all entries."""
    taken, met = set(), set()
    for same in (lambda a, b: a == b, fold.same_claim):
        for i, (claim, _) in enumerate(raised):
            if i in met:
                continue
            for j, (other, _, _) in enumerate(queue):
                if j not in taken and same(claim, other):
                    taken.add(j)
                    met.add(i)
                    break
    turned = lambda j, s: ("waiting" if s == "obsolete" else s) if j in taken else "obsolete" if s == "waiting" else s
    return [(c, d, turned(j, s)) for j, (c, d, s) in enumerate(queue)] + [(c, d, "waiting") for i, (c, d) in enumerate(raised) if i not in met]


def test_queue_pairs_one_to_one(spark):
    r = random.Random(9)
    words = ["the budget is ten", "the budget is ten million", "the budget is ten million euros", "the budget", "no"]
    raised, queue, want = [], [], []
    for slot in range(60):
        new = sorted(((r.choice(words), f"d{r.randrange(3)}") for _ in range(r.randrange(7))), key=lambda x: x[::-1])
        old = sorted(((r.choice(words), f"d{r.randrange(3)}", r.choice(["accepted", "rejected", "waiting", "obsolete"])) for _ in range(r.randrange(7))), key=lambda x: (x[1], x[0]))
        place = (f"s{slot}", "x", "k", "term")
        raised += [(*place, c, 0.7, "why", d) for c, d in new]
        queue += [(*place, c, 0.7, "why", d, s) for c, d, s in old]
        # entries of one date and claim may stand in either order: their statuses are compared as a bag
        want += [(f"s{slot}", *x) for x in greedy(new, old)]
    schema = "session_id string, subject string, key string, subject_kind string, claim string, confidence double, reason string, created_at string"
    out = decide.settle_queue(spark.createDataFrame(raised, schema), spark.createDataFrame(queue, schema + ", status string"))
    got = [(x.session_id, x.claim, x.created_at, x.status) for x in out.collect()]
    same = {s: [x[1:] for x in want if x[0] == s] for s in {x[0] for x in want}}
    for s, rows in same.items():
        mine = [x[1:] for x in got if x[0] == s]
        ambiguous = len({(c, d) for c, d, _ in rows}) < len(rows)
        assert len(mine) == len(rows) and (ambiguous or sorted(mine) == sorted(rows))
    two = decide.settle_queue(
        spark.createDataFrame([("s", "x", "k", "term", "the budget is ten million now", 0.7, "w", "d1"), ("s", "x", "k", "term", "the budget is ten million today", 0.7, "w", "d1")], schema),
        spark.createDataFrame([("s", "x", "k", "term", "the budget is ten", 0.7, "w", "d0", "accepted"), ("s", "x", "k", "term", "the budget is ten million", 0.7, "w", "d0", "rejected")], schema + ", status string"),
    )
    assert sorted((x.claim, x.status) for x in two.collect()) == [("the budget is ten", "accepted"), ("the budget is ten million", "rejected")]
