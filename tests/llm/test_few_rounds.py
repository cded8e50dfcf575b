"""Components of links, by tasks alone and with rounds over them, and how many rounds near copies take."""

import random

import numpy as np
import pytest

from turnledger.llm import ngram_join


def smallest(links):
    comp = {x: x for ab in links for x in ab}
    while True:
        new = dict(comp)
        for a, b in links:
            new[a] = new[b] = min(new[a], new[b])
        if new == comp:
            return comp
        comp = new


@pytest.mark.parametrize("at_once", [3, ngram_join.LINKS_AT_ONCE])
def test_components(spark, monkeypatch, at_once):
    """A long path, a star and random links. Few links are joined without a shuffle: one table is written."""
    monkeypatch.setattr(ngram_join, "LINKS_AT_ONCE", at_once)
    written, stored = [], ngram_join.stored
    monkeypatch.setattr(ngram_join, "stored", lambda df: written.append(df) or stored(df))
    r = random.Random(at_once)
    path = list(range(1000, 1060))
    r.shuffle(path)
    links = [*zip(path, path[1:]), *((2000, 2001 + i) for i in range(40)), *((r.randrange(100), r.randrange(100, 200)) for _ in range(70))]
    links = [(min(x), max(x)) for x in links]
    r.shuffle(links)
    got = ngram_join.components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()
    assert len(got) == len({x.set for x in got}) and {x.set: x.comp for x in got} == smallest(links)
    assert (len(written) == 1) == (at_once > len(links))
    assert ngram_join.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_smallest_joined():
    r = np.random.default_rng(8)
    for _ in range(100):
        a, b = r.integers(-(1 << 62), 1 << 62, 60)[r.integers(0, 60, (2, int(r.integers(1, 90))))]
        ids, label = ngram_join.smallest_joined(a, b)
        assert dict(zip(ids.tolist(), label.tolist(), strict=True)) == smallest(list(zip(a.tolist(), b.tolist(), strict=True)))


@pytest.mark.parametrize("few", [0, 1 << 20])
def test_rounds(spark, monkeypatch, few):
    """Sets of a common core and six own words link if they share three of these. By signatures most open pairs look as close as links, so that
    trees of close pairs merge a little in each round; the rounds stay few."""
    monkeypatch.setattr(ngram_join, "FEW_SETS", few)
    r = random.Random(1)
    rows = [[f"core{j}" for j in range(60)] + [f"own{j}" for j in r.sample(range(60), 6)] for _ in range(400)]
    rounds, open_pairs = [], ngram_join._open_pairs
    monkeypatch.setattr(ngram_join, "_open_pairs", lambda *a, **k: rounds.append(k["all_pairs"]) or open_pairs(*a, **k))
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], "doc_id long, text string").repartition(3)
    got = {x.doc_id: x.component_id for x in ngram_join.near_components(docs, 1, 90).collect()}
    sets = [set(t) for t in rows]
    links = [(a, b) for a in range(400) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    assert got == {i: i for i in range(400)} | smallest(links)
    assert len(rounds) == 2, rounds
