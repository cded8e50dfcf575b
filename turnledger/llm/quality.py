"""Quality classifier by positive-unlabelled learning.

Texts become a few whole-text measures, cut at corpus quantiles into indicator features. The scorer is linear
in them with squared loss, so the non-negative unbiased risk

    prior * E_pos[(1 - g)^2 / 4] + max(0, E_unl[(1 + g)^2 / 4] - prior * E_pos[(1 + g)^2 / 4])

needs nothing of the corpus but the second moments of the features over the trusted positives and over the
unlabelled texts. Both are sums over all training rows, gathered in one pass; the minimiser itself is a small
linear-algebra problem.

The class prior is estimated from positives and unlabelled texts alone: above any score lie at least prior times the share of the
positives there among the unlabelled, so the least ratio of the two shares bounds the prior from above. Labelled
negatives are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BATCH_ROWS, small_batches, stored, text_bytes

MEASURES = ("log_bytes", "upper", "digit", "symbol", "bang", "pipe", "stop", "non_ascii", "word_length", "distinct_words", "repeats", "symbol_ends", "line_words", "distinct_lines")
#: Cut points for each measure: approximate quantiles over all rows.
QUANTILES = (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.5, 0.7, 0.8, 0.85, 0.9, 0.95, 0.98)
#: Ridge on the weights, in units of the mean squared feature.
RIDGE = 1e-3
#: Where the search for the class prior starts, its rounds, and the bins of scores that it reads.
FIRST_PRIOR, PRIOR_ROUNDS, BINS = 0.5, 3, 512
#: The least share of the positives above a score at which the prior is read off.
LEAST_POSITIVE_SHARE = 0.5

_UPPER, _DIGIT = bytes(range(0x41, 0x5B)), bytes(range(0x30, 0x3A))
_PLAIN = bytes(range(0x30, 0x3A)) + bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)) + b" \t\r\n\x0b\x0c.,;:'\"-()?"
_ASCII = bytes(range(0x80))
_END = frozenset(b"!#$%&*|@~^=<>_\\/")


def measures(text: bytes) -> list[float]:
    """Shares of the whole text; an empty text measures zero throughout."""
    n = max(1, len(text))
    words = text.split()
    count = max(1, len(words))
    lines = text.split(b"\n")
    bodies = [x for x in lines if x]
    return [
        float(np.log1p(len(text))),
        (len(text) - len(text.translate(None, _UPPER))) / n,
        (len(text) - len(text.translate(None, _DIGIT))) / n,
        len(text.translate(None, _PLAIN)) / n,
        text.count(b"!") / n,
        text.count(b"|") / n,
        text.count(b".") / count,
        len(text.translate(None, _ASCII)) / n,
        len(text) / count,
        len(set(words)) / count**0.8,
        sum(map(eq, words, words[1:])) / count,
        sum(w[-1] in _END for w in words) / count,
        count / max(1, len(bodies)),
        len(set(bodies)) / max(1, len(bodies)),
    ]


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out and the measures of each row's whole text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = np.array([measures(t.as_py() or b"") for t in batch.column(2)]).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, pa.float64()) for c in table.T)], ["doc_id", "held_out", *MEASURES])

    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), text_bytes(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, " + ", ".join(f"{m} double" for m in MEASURES))


def cut_points(rows: DataFrame) -> list[np.ndarray]:
    found = rows.approxQuantile(list(MEASURES), list(QUANTILES), 0.001)
    return [np.unique(c) for c in found]


def design(table: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """A constant, then for each measure the indicators of lying above its cut points."""
    return np.hstack([np.ones((len(table), 1)), *((table[:, [k]] > c[None, :]).astype(float) for k, c in enumerate(cuts))])


#: In how many pieces a matrix of moments is summed over tasks.
SLICES = 8
_SUMS = "positive boolean, slice long, sums binary"


def _partial_moments(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Sums of x x^T over the positives and over all rows, in SLICES pieces each: a task hands over its own sums, and pieces of one place are added up
    before anything reaches the driver. The sums are of zeros and ones, so their order does not matter."""
    held = rows.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            positive = np.array(batch.column(0).to_pylist(), bool)
            x = design(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]), held.value)
            for part, rows_ in ((True, x[positive]), (False, x)):
                total[part] = total.get(part, 0) + rows_.T @ rows_
        for part, m in total.items():
            yield _pieces({(part, k): piece for k, piece in enumerate(np.array_split(m, SLICES))})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        for batch in batches:
            for part, k, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[part, k] = held.get((part, k), 0) + np.frombuffer(sums)
        if held:
            yield _pieces(held)

    parts = rows.select("positive", *MEASURES).mapInArrow(run, _SUMS)
    return parts.repartition(2 * SLICES, "positive", "slice").mapInArrow(add, _SUMS)


def _pieces(sums: dict[tuple, np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array([part for part, _ in sums], pa.bool_()), pa.array([k for _, k in sums], pa.int64()), pa.array([m.tobytes() for m in sums.values()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["positive", "slice", "sums"])


def _moments(rows: DataFrame, cuts: list[np.ndarray]) -> dict[bool, np.ndarray]:
    """The two matrices of moments; 2 * SLICES rows reach the driver, however many tasks there are."""
    size = 1 + sum(map(len, cuts))
    out = {True: np.zeros((size, size)), False: np.zeros((size, size))}
    with small_batches(rows.sparkSession):  # a row has some 150 indicators in Python
        pieces = _partial_moments(rows, cuts).collect()
    for r in pieces:
        np.array_split(out[r["positive"]], SLICES)[r["slice"]][:] = np.frombuffer(r["sums"]).reshape(-1, size)
    return out


def _inverse(a: np.ndarray) -> np.ndarray:
    """Of a small positive definite matrix, by elimination: no threaded linear algebra on the driver."""
    m = np.hstack([a, np.eye(len(a))])
    for k in range(len(a)):
        m[k] /= m[k, k]
        other = m[:, k].copy()
        other[k] = 0
        m -= other[:, None] * m[k]
    return m[:, len(a) :]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    return (a * x).sum(axis=-1)


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float, ridge: float = RIDGE, steps: int = 200) -> np.ndarray:
    """Weights of least non-negative risk, from the two moment matrices (means; the constant comes first).

    Starts at the unbiased minimiser. While the unlabelled risk less the positives' share of it is negative,
    steps go against that part, as the non-negative estimator prescribes."""
    size = len(unlabelled)
    bump = ridge * max(1e-12, np.trace(unlabelled) / size) * np.eye(size)
    solve = _inverse(unlabelled + bump)
    bp, bu = positive[0], unlabelled[0]
    w = _times(solve, 2 * prior * bp - bu)
    best, least = w, np.inf
    for _ in range(steps):
        pw, uw = _times(positive, w), _times(unlabelled, w)
        wp, wu, squares_p, squares_u = _times(bp, w), _times(bu, w), _times(pw, w), _times(uw, w)
        rest = (1 + 2 * wu + squares_u) / 4 - prior * (1 + 2 * wp + squares_p) / 4
        risk = prior * (1 - 2 * wp + squares_p) / 4 + max(0.0, rest)
        if risk < least - 1e-12:
            best, least = w, risk
        if rest >= 0:
            slope = (-4 * prior * bp + 2 * bu + 2 * (uw + _times(bump, w))) / 4
        else:
            slope = -(2 * bu + 2 * uw - prior * (2 * bp + 2 * pw)) / 4
        if np.abs(slope).max() < 1e-9:
            break
        w = w - 0.2 * _times(solve, slope)
    return best


def squash(margin: np.ndarray) -> np.ndarray:
    """A margin as a score from 0 to 1 that keeps its order; 0.5 is a margin of 0."""
    return 1 / (1 + np.exp(-2 * np.clip(margin, -15, 15)))


def estimate_prior(train: DataFrame, cuts: list[np.ndarray], weights: np.ndarray) -> float:
    """Least ratio of unlabelled to positive shares above a score, each one standard error to the safe side, of scores that half
    of the positives reach. train must not have taught the weights. Reads BINS pairs of counts, whatever the corpus."""
    held = train.sparkSession.sparkContext.broadcast((cuts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), np.int64)
        for batch in batches:
            positive = np.array(batch.column(0).to_pylist(), bool)
            x = design(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]), held.value[0])
            bins = np.minimum((squash(x @ held.value[1]) * BINS).astype(int), BINS - 1)
            total[0] += np.bincount(bins[positive], minlength=BINS)
            total[1] += np.bincount(bins, minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS)), pa.array(total[0]), pa.array(total[1])], ["bin", "positives", "rows"])

    counts = train.select("positive", *MEASURES).mapInArrow(run, "bin long, positives long, rows long").groupBy("bin").agg(F.sum("positives").alias("p"), F.sum("rows").alias("u"))
    with small_batches(train.sparkSession):
        counts = counts.collect()
    table = np.zeros((2, BINS))
    for r in counts:
        table[:, r["bin"]] = r["p"], r["u"]
    (n_positive, n), (above_p, above_u) = table.sum(axis=1), (np.cumsum(t[::-1])[::-1] for t in table)
    if not n_positive:
        return FIRST_PRIOR
    p, u = above_p / n_positive, above_u / n
    enough = p >= LEAST_POSITIVE_SHARE
    low, high = p - np.sqrt(p * (1 - p) / n_positive), u + np.sqrt(u * (1 - u) / n)
    return float(np.clip((high[enough] / np.maximum(low[enough], 1e-9)).min(), 0.01, 0.99))


def fit(rows: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id") -> tuple[list[np.ndarray], np.ndarray]:
    """Cut points and weights. A document is a trusted positive if one of its labels is 1; all training rows are the
    unlabelled ones; only rows that are not held out teach. The class prior is read off half of them, by scores that the other
    half taught, in rounds; then all of them teach."""
    known = labels.filter(F.col(id_col).isNotNull() & (F.col(label_col) == 1)).select(F.col(id_col).cast("long").alias("doc_id"), F.lit(True).alias("positive")).distinct()
    train = stored(rows.filter("NOT held_out").join(known.hint("shuffle_merge"), "doc_id", "left").withColumn("positive", F.coalesce("positive", F.lit(False))))
    n, n_positive = train.agg(F.count(F.lit(1)), F.sum(F.col("positive").cast("long"))).first()
    cuts = cut_points(train) if n else [np.zeros(0)] * len(MEASURES)
    if not n_positive:
        return cuts, np.zeros(1 + sum(map(len, cuts)))
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    part, sums = _moments(train.filter(half), cuts), _moments(train, cuts)
    prior = FIRST_PRIOR
    for _ in range(PRIOR_ROUNDS if part[True][0, 0] else 0):
        weights = minimise(part[True] / part[True][0, 0], part[False] / part[False][0, 0], prior)
        found = estimate_prior(train.filter(~half), cuts, weights)
        if abs(found - prior) < 0.01:
            break
        prior = found
    return cuts, minimise(sums[True] / n_positive, sums[False] / n, prior)


def score_rows(rows: DataFrame, cuts: list[np.ndarray], weights: np.ndarray) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast((cuts, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = design(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns[2:]]), held.value[0])
            score = squash(x @ held.value[1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return rows.select("doc_id", "held_out", *MEASURES).mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document row: doc_id, held_out, score, predicted.

    Null and empty texts are scored like any other, very long ones whole. Without a positive label every score is 0.5. Repeated
    rows give rows each; ids are whole numbers; rows with a null id count as not held out; an empty table gives no rows; other columns are not read."""
    rows = stored(measured(docs))
    return score_rows(rows, *fit(rows, labels))


def good_documents(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows, all columns, that are predicted 1, repeated rows each; null and empty texts are judged like any other. Without a
    positive label every row stays. Only texts go to Python, and only one boolean a row comes back."""
    cuts, weights = fit(stored(measured(docs)), labels)
    held = docs.sparkSession.sparkContext.broadcast((cuts, weights))

    def judge(texts: pa.Array) -> pa.Array:
        good = []
        for k in range(0, len(texts), BATCH_ROWS):
            table = np.array([measures(t.as_py() or b"") for t in texts.slice(k, BATCH_ROWS)]).reshape(-1, len(MEASURES))
            score = squash(design(table, held.value[0]) @ held.value[1])
            good += (score >= 0.5).tolist()
        return pa.array(good, pa.bool_())

    return docs.filter(F.arrow_udf(judge, "boolean")(text_bytes(text_col)))


def op5_quality(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
