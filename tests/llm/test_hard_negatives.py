"""Hard negatives against a plain scan: ties, copies, nulls, ragged and huge vectors, many blocks and pivots; cover trees on their own."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnledger.llm import hard_negatives as hard

SCHEMA = "vec_id long, label int, vector array<float>, anchor boolean"


def plain(rows, positives=5, negatives=5, low=80, high=100):
    """The result by scoring every row against every anchor."""
    clean = []
    for vec_id, label, vector, anchor in rows:
        if label is not None and vector is not None and all(x is not None and math.isfinite(x) for x in vector):
            clean.append((vec_id, label, [max(-hard.LARGEST, min(hard.LARGEST, math.floor(256 * float(np.float32(x))))) for x in vector], anchor))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    out = []
    for i, (aid, alabel, a, anchor) in enumerate(clean):
        if not anchor:
            continue
        scored = [(sum(x * y for x, y in zip(a, v, strict=False)), vec_id, label == alabel) for j, (vec_id, label, v, _) in enumerate(clean) if j != i]
        for ps, pid, _ in sorted((x for x in scored if x[2]), key=order)[:positives]:
            inside = sorted((x for x in scored if not x[2] and low * ps <= 100 * x[0] <= high * ps), key=order)
            out += [(aid, pid, n + 1, nid, ps, ns) for n, (ns, nid, _) in enumerate(inside[:negatives])]
    return sorted(out, key=str)


def test_cover_tree_finds_all(monkeypatch):
    monkeypatch.setattr(hard, "LEAF", 3)
    monkeypatch.setattr(hard, "FAN_OUT", 4)
    r = np.random.default_rng(5)
    for case in range(60):
        n, width = int(r.integers(1, 120)), int(r.integers(1, 6))
        values = r.integers(-4, 5, (n, width)) * (1 if case % 3 else 40) + (0 if case % 2 else 30)
        values[r.random(n) < 0.3] = values[0]
        labels, ids = r.integers(0, 3, n).tolist(), r.integers(0, n, n).tolist()
        sphere2 = int((values**2).sum(axis=1).max())
        block = hard.build(list(range(n)), ids, labels, [hard.packed(v) for v in values], sphere2)
        assert sorted(block.rows) == list(range(n))
        for q in range(min(n, 8)):
            query = hard.Query(block, q, labels[q], hard.packed(values[q]))
            scores = values @ values[q]
            for same in (True, False):
                lo = int(r.integers(-50, 50)) if case % 4 else hard.LOWEST
                hi = lo + int(r.integers(0, 500)) if case % 5 else hard.HIGHEST
                want = sorted((-int(scores[i]), ids[i]) for i in range(n) if i != q and (labels[i] == labels[q]) == same and lo <= scores[i] <= hi)[:4]
                assert [(-s, i) for s, i, _ in query.best(same, lo, hi, 4)] == want


def test_bounds_hold():
    r = np.random.default_rng(2)
    values = r.integers(-300, 300, (200, 5)).astype(float)
    norms2 = (values**2).sum(axis=1)
    angle = hard.angles(values, norms2, 7, norms2.max())
    for q in values[:20]:
        low, high = hard.bounds(np.array([values[7] @ q]), np.array([angle.max()]), float(np.linalg.norm(q)), math.sqrt(norms2.max()))
        assert low[0] <= (values @ q).min() and (values @ q).max() <= high[0]


def random_rows(seed, n):
    r = random.Random(seed)
    centers = [[r.gauss(0, 1) for _ in range(6)] for _ in range(5)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        vector = [x + r.gauss(0, 0.3) for x in c]
        if i % 9 == 0 and rows:
            vector = rows[r.randrange(len(rows))][2]  # a copy
        rows.append((i, r.choice([0, 0, 0, 1, 2, 7]), vector, i % 10 == 0))
    bad = [(1, 0, None, True), (2, None, [1.0] * 6, True), (3, 0, [1.0, None] * 3, True), (4, 0, [float("nan")] * 6, True), (5, 1, [float("inf")] * 6, False)]
    odd = [(0, 0, [0.5, 0.25], True), (6, 1, [], False), (None, 1, [1.0] * 9, True), (7, 2, [3e38, 1.0], False), (8, 50, [0.0] * 6, True), (20, rows[20][1], rows[20][2], True)]
    return rows + bad + odd


@pytest.mark.parametrize("blocks", [False, True])
def test_against_a_scan(spark, monkeypatch, blocks):
    rows = random_rows(3, 400)
    if blocks:
        monkeypatch.setattr(hard, "LEAST_BLOCK", 16)
        monkeypatch.setattr(hard, "ROUTED_BLOCKS", 5)
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("row", "block", "req", "v", "m")}).repartition(3)
    got = sorted((tuple(x) for x in hard.hard_negatives(df).collect()), key=str)
    assert got == plain(rows)


def test_other_settings_and_nothing(spark):
    rows = random_rows(8, 120)
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted((tuple(x) for x in hard.hard_negatives(df, 2, 3, 55, 95).collect()), key=str) == plain(rows, 2, 3, 55, 95)
    out = hard.hard_negatives(df.filter("false"))
    assert out.count() == 0 and out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard.hard_negatives(df.withColumn("label", F.lit(1))).count() == 0


def test_query_moves_labels(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, i % 10, [r.gauss(0, 1) for _ in range(4)]) for i in range(350)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    want = plain([(i, (k + 1) % 10 if i % 7 == 0 else k, v, i % 100 == 0) for i, k, v in rows])
    assert sorted((tuple(x) for x in hard.op13_hard_negatives(spark, str(tmp_path)).collect()), key=str) == want


@pytest.mark.parametrize("scale", [1, 40, 1 << 20, 1 << 26])
def test_many_anchors_at_once(monkeypatch, scale):
    """Many anchors, several windows each, in one block: exact with every type of number, and nodes are looked at for all anchors together."""
    calls = []
    bounds = hard.bounds
    monkeypatch.setattr(hard, "bounds", lambda *a: calls.append(1) or bounds(*a))
    r = np.random.default_rng(scale)
    n, need = 1500, 4
    values = np.floor(r.normal(size=(n, 6)) * scale * 3 / 4).clip(-hard.LARGEST, hard.LARGEST).astype(np.int64)
    values[r.random(n) < 0.1] = values[0]
    labels, ids = r.choice([0, 0, 0, 1, 2, 3], n), r.integers(0, n, n)
    sphere2 = int((values**2).sum(axis=1).max())
    block = hard.build(list(range(n)), ids.tolist(), labels.tolist(), [hard.packed(v) for v in values], sphere2)
    anchors, which = np.arange(200), np.repeat(np.arange(200), 3)
    hi = np.sort(r.integers(0, sphere2, 600) // 4)
    for same in (True, False):
        got = hard.best(block, anchors, labels[anchors], [hard.packed(v) for v in values[anchors]], which, same, hi * 8 // 10, hi, need)
        want = []
        for q, a in enumerate(which):
            score = values @ values[a]
            inside = [(-int(score[i]), int(ids[i])) for i in range(n) if i != a and (labels[i] == labels[a]) == same and hi[q] * 8 // 10 <= score[i] <= hi[q]]
            want += [(q, -s, i) for s, i in sorted(inside)[:need]]
        assert list(zip(*(x.tolist() for x in got[:3]), strict=True)) == want
    assert len(calls) < 100
