"""What near dedup leaves, against brute force, with repeated and null ids."""

import hashlib
import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from turnledger.llm import ngram_join


def text(tag, edit=None):
    out = [f"{tag}{j}" for j in range(60)]
    if edit is not None:
        out[edit] = "edited"
    return " ".join(out)


ROWS = [
    (1, text("a")), (2, text("a", 59)), (2, text("b")),  # an id with a near copy and a text of its own
    (None, text("a", 0)), (None, text("c")), (None, "just a few words"),  # the same with null ids
    (5, text("d")), (5, text("d", 59)), (6, text("d", 0)),  # the smallest id repeats
    (None, text("e")), (None, text("e", 59)), (None, text("e", 0)),  # all ids null
    (7, text("f")), (7, text("f")), (8, text("f", 59)), (9, ""), (9, None), (None, None), (1, "just a few words more"),
]


def survivors(rows, k, percent):
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set())
    comp = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    groups = {}
    for row, c, s in zip(rows, comp, sets, strict=True):
        groups.setdefault((c, bool(s)), []).append(row)
    return [r for (_, words), g in groups.items() for r in ([min(g, key=order)] if words else g)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_key", "_sha", "comp", "digest", "kept", "copies")}).repartition(3)
    as_key = lambda r: (str(r[0]), str(r[1]))
    for rows in (docs, docs.distinct()):
        out = ngram_join.one_of_each(rows, 5, 80)
        assert out.columns == docs.columns or sorted(out.columns) == sorted(docs.columns)
        assert sorted(map(as_key, out.select("doc_id", "text").collect())) == sorted(map(as_key, survivors(ROWS, 5, 80)))
    assert ngram_join.one_of_each(docs.filter("false")).count() == 0


@pytest.mark.parametrize("percent,few", [(80, None), (90, 0)])
def test_tiles_of_many_blocks(spark, monkeypatch, percent, few):
    """Sets of many sizes that share their rarest shingles and are close without linking, so that the last round tries all pairs of a tile."""
    monkeypatch.setattr(ngram_join, "TILE", 4)
    if few is not None:
        monkeypatch.setattr(ngram_join, "FEW_SETS", few)
    r, rows = random.Random(percent), []
    base = [f"w{j}" for j in range(90)]
    for i in range(130):
        own = [w if r.random() > r.choice([0.02, 0.03, 0.05]) else f"x{i}_{j}" for j, w in enumerate(base[: r.choice([25, 30, 38, 47, 60, 75, 90])])]
        rows.append((i, " ".join(own)))
    seen, open_pairs = [], ngram_join._open_pairs
    monkeypatch.setattr(ngram_join, "_open_pairs", lambda *a, **k: seen.append(k["all_pairs"]) or open_pairs(*a, **k))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in ngram_join.near_components(docs, 3, percent).collect()}
    sets = [{tuple(w[j : j + 3]) for j in range(len(w) - 2)} for w in (t.split() for _, t in rows)]
    comp = list(range(len(rows)))
    links = [(a, b) for a in comp for b in range(a) if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    for _ in rows:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert got == dict(enumerate(comp)) and len(set(comp)) > 10


def test_signatures_bound_the_difference():
    r = np.random.default_rng(4)
    for _ in range(200):
        n, percent = int(r.integers(1, 3000)), int(r.choice([80, 90]))
        a = np.unique(r.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * r.uniform(0.7, 1))], r.integers(0, 1 << 63, int(n * r.uniform(0, 0.3))).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        x, y = sorted((ngram_join.parity_bits(a, percent), ngram_join.parity_bits(b, percent)), key=len)
        assert ngram_join.bits_apart(x, y) <= differ
        # within reach in size, the longer signature has at most twice the bits
        for m in range(n, n * 100 // percent + 1, max(1, n // 7)):
            assert ngram_join.signature_bits(m, percent) <= 2 * ngram_join.signature_bits(n, percent)
