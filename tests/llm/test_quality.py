"""What reaches the driver, and scores against a plain fit on a small table."""

import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from turnledger.llm import quality

WORDS = "the of and to in is for on with as by at from river stone early morning quiet people walked along under bridge house market".split()


def texts(n, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        good = r.random() < 0.6
        if good:
            text = "\n".join(" ".join(r.choice(WORDS) for _ in range(r.randint(6, 14))).capitalize() + "." for _ in range(r.randint(2, 6)))
        else:
            text = "".join(r.choice("BUY!!! NOW$$$ |#@ 99 ") for _ in range(r.randint(20, 200)))
        rows.append((i, text))
        if good and r.random() < 0.5:
            labels.append((i, 1))
        elif not good and r.random() < 0.3:
            labels.append((i, 0))
    return rows, labels


def test_few_rows_reach_the_driver(spark):
    rows, labels = texts(300)
    some = quality.measured(spark.createDataFrame(rows, "doc_id long, text string")).withColumn("positive", F.col("doc_id") % 3 == 0).cache()
    cuts = quality.cut_points(some)
    one = quality._moments(some.coalesce(1), cuts)
    parts = quality._partial_moments(some.repartition(60), cuts)
    assert parts.count() == 2 * quality.SLICES
    many = quality._moments(some.repartition(60), cuts)
    assert all((one[k] == many[k]).all() for k in one)
    table = np.array([[r[m] for m in quality.MEASURES] for r in some.collect()])
    x = quality.design(table, cuts)
    assert (x.T @ x == one[False]).all()
    assert all((m == 0).all() for m in quality._moments(some.filter("false"), cuts).values())


def plain_measures(text):
    """The same measures by other means."""
    data, words = text.encode(), re.findall(rb"[^ \t-\r]+", text.encode())
    n, count, bodies = max(1, len(data)), max(1, len(words)), [x for x in data.split(b"\n") if x]
    share = lambda pattern: len(re.findall(pattern, data)) / n
    return [
        np.log1p(len(data)), share(rb"[A-Z]"), share(rb"[0-9]"), share(rb"[^0-9A-Za-z\x80-\xff \t-\r.,;:'\"()?-]") if data else 0, share(rb"!"), share(rb"\|"), data.count(b".") / count, share(rb"[\x80-\xff]"),
        len(data) / count, len(set(words)) / count**0.8, sum(a == b for a, b in zip(words, words[1:], strict=False)) / count, sum(bool(re.search(rb"[!#$%&*|@~^=<>_\\/]$", w)) for w in words) / count,
        count / max(1, len(bodies)), len(set(bodies)) / max(1, len(bodies)),
    ]


def test_scores_against_a_plain_fit(spark, monkeypatch):
    """Scores are what plain measures and plain sums over them give, with the prior that was read off."""
    rows, labels = texts(400)
    rows += [(1000, ""), (1001, None), (1002, "word " * 300_000)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    cuts = quality.cut_points(quality.measured(docs).filter("NOT held_out"))
    minimise, priors = quality.minimise, []
    monkeypatch.setattr(quality, "minimise", lambda p, u, prior: priors.append(prior) or minimise(p, u, prior))
    got = {r.doc_id: r for r in quality.quality_scores(docs, marks).collect()}
    assert len(priors) > 1 and abs(priors[-1] - 0.6) < 0.15
    x = quality.design(np.array([plain_measures(t or "") for _, t in rows]), cuts)
    good = {i for i, k in labels if k == 1}
    teaches = np.array([zlib.crc32(str(i).encode()) % 3 != 1 for i, _ in rows])
    positive = np.array([i in good for i, _ in rows]) & teaches
    weights = minimise(x[positive].T @ x[positive] / positive.sum(), x[teaches].T @ x[teaches] / teaches.sum(), priors[-1])
    want = 1 / (1 + np.exp(-2 * np.clip(x @ weights, -15, 15)))
    for (i, _), s, t in zip(rows, want, teaches, strict=True):
        assert abs(got[i].score - s) < 1e-9 and got[i].predicted == (s >= 0.5) and got[i].held_out == (not t)
    held = [(i, t) for (i, t), use in zip(rows, teaches, strict=True) if not use and i < 1000]
    right = sum(got[i].predicted == (not re.search("BUY|[$#|@]", t)) for i, t in held)
    assert right >= 0.95 * len(held)
