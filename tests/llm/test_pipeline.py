"""run() of the pipeline against its stages in plain Python, with repeated and null ids."""

import base64
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_quality import plain_measures, texts

from turnledger.llm import quality


def text(tag, edit=None):
    out = [f"{tag}{j}" for j in range(60)]
    if edit is not None:
        out[edit] = "edited"
    return " ".join(out)


PASSAGE = " ".join(f"bench{j}" for j in range(12))
ROWS = [
    (1, text("a")), (2, text("a", 59)), (2, text("b")), (3, text("c")), (4, text("c").replace(" ", "\n")), (None, text("c")), (None, text("d")), (5, text("d", 0)),
    (6, text("e") + " " + PASSAGE), (7, None), (8, ""), (None, text("f")), (None, text("f", 0)), (9, "few words"), (9, text("g")),
]


def order(row):
    return row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).hexdigest()


def exact(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[ \t-\r]+", " ", r[1] or ""), []).append(r)
    return [min(g, key=order) for g in groups.values()]


def near(rows):
    sets, comp = [], list(range(len(rows)))
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    for _ in rows:
        for a in range(len(rows)):
            for b in range(a):
                if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    comp[a] = comp[b] = min(comp[a], comp[b])
    groups = {}
    for row, c, s in zip(rows, comp, sets, strict=True):
        groups.setdefault(c if s else ("none", len(groups)), []).append(row)
    return [min(g, key=order) for g in groups.values()]


def expected(rows):
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    left = [(i, t) for i, t in near(exact(rows)) if "bench0" not in (t or "")]
    return sorted((str(i), len(enc.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in left)


def ran(spark, folder):
    import corpus_pipeline

    return sorted((str(r.doc_id), r.n_tokens, r.decoded_sha256) for r in corpus_pipeline.run(spark, str(folder)).collect())


def test_run(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    rows = [*ROWS, (20, "long " * 100_000 + text("h"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("_key", "_sha", "_bytes", "h", "n", "comp", "kept")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    # without a positive label every document scores 0.5 and stays
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert ran(spark, tmp_path) == expected(rows)


def test_quality_decides(spark, tmp_path):
    """With labels: what plain measures score below a half goes before copies are looked for."""
    pytest.importorskip("public_tokenizers")
    pytest.importorskip("tiktoken")
    rows, labels = texts(240)
    rows += [(i + 1000, t) for i, t in rows[::5]] + [(3000, rows[0][1] + " " + PASSAGE), (3001, None)]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    marks.write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    cuts, weights = quality.fit(quality.measured(docs), marks)
    margins = quality.design(np.array([plain_measures(t or "") for _, t in rows]), cuts) @ weights
    good = [r for r, m in zip(rows, margins, strict=True) if m >= 0]
    assert 100 < len(good) < 240
    assert ran(spark, tmp_path) == expected(good)


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string"), ("labels", "doc_id long, quality int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert ran(spark, tmp_path) == []
