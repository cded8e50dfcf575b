import random

import pytest

from turnledger.operators import facts as ops
from turnledger.operators import reconcile as fold

CLAIM = "date string, session_id string, ord long, subject string, subject_kind string, key string, claim string, confidence double"


def claims(spark, rows):
    return spark.createDataFrame([(d, s, o, "acme", "project", k, c, f) for d, s, o, k, c, f in rows], CLAIM)


@pytest.mark.parametrize(
    ("held", "new", "same", "outcome"),
    [(None, 0.9, False, "added"), (None, 0.4, False, "queued"), (0.9, 0.9, False, "superseded"), (0.9, 0.75, False, "queued"), (0.95, 0.85, False, "superseded"), (1.0, 0.85, False, "queued"), (1.0, 0.95, False, "superseded"), (0.9, 0.1, True, "unchanged")],
)
def test_truth_table(spark, held, new, same, outcome):
    rows = [("d1", "s1", 0, "k.a", "the first wording", held)] if held else []
    rows.append(("d2", "s2", 0, "k.a", "The First  wording" if same else "quite another", new))
    got = {r.session_id: r.outcome for r in fold.replay(fold.events(claims(spark, rows))).outcomes.collect()}
    assert got["s2"] == outcome


def test_twin_under_another_key_is_unchanged(spark):
    rows = [("d1", "s1", 0, "k.a", "runs on port 8080 at home", 0.9), ("d2", "s2", 0, "k.b", "RUNS on port 8080", 0.9)]
    out = fold.replay(fold.events(claims(spark, rows)))
    assert {r.outcome for r in out.outcomes.collect()} == {"added", "unchanged"} and out.facts.count() == 1


def test_arrival_order_does_not_matter(spark):
    random.seed(1)
    rows = [(f"d{random.randrange(9)}", f"s{i}", 0, f"k{random.randrange(4)}", f"c{random.randrange(6)}", random.choice([0.6, 0.8, 0.9, 1.0])) for i in range(60)]
    table = lambda r: sorted(map(str, fold.replay(fold.events(claims(spark, r))).facts.collect()))
    first = table(rows)
    random.shuffle(rows)
    assert table(rows) == first


def test_withdrawn_and_replaced(spark):
    said = claims(spark, [("d1", "s1", 0, "a", "old words here", 0.9), ("d2", "s2", 0, "a", "new words now", 0.8)])
    gone = spark.createDataFrame([("d2", "s2", 0, "acme", "project", "a", "old words here", 0.9, "d1", "d2"), ("d2", "s2", 1, "acme", "project", "a", "middle wording", 0.9, "d1", "d2"), ("d3", "s3", 0, "acme", "project", "b", "never mind", 0.9, "d3", "d4")], CLAIM + ", created_at string, retracted_at string")
    rows = {r.claim: r for r in fold.replay(fold.events(said, gone)).facts.collect()}
    assert rows["old words here"].superseded_by == rows["middle wording"].seq and rows["middle wording"].superseded_by == rows["new words now"].seq
    assert rows["old words here"].retracted_at is None and rows["never mind"].retracted_at == "d4"
    assert rows["new words now"].superseded_at is None


def test_accept_has_no_floor(spark):
    weak = claims(spark, [("d1", "s1", 0, "a", "a weak claim", 0.4)])
    out = fold.replay(fold.events(weak, accepts=claims(spark, [("d2", "s9", 0, "a", "a weak claim", 0.4)])))
    assert [r.confidence for r in out.facts.collect()] == [1.0] and out.pending.count() == 1


def test_keys_that_are_the_same(spark):
    known = spark.createDataFrame([("x", "bundle-write", 1), ("x", "gates", 2), ("x", "entries.top", 3)], "subject string, key string, first_seen long")
    said = spark.createDataFrame([("x", k) for k in ("bundle_write", "gate", "bundle-scale", "Entry.top", "bundle-writes")], "subject string, key string")
    got = {r.key: r.canonical_key for r in ops.canonicalise(said, known).collect()}
    assert got == {"bundle_write": "bundle-write", "gate": "gates", "bundle-scale": "bundle-scale", "Entry.top": "entries.top", "bundle-writes": "bundle-write"}
