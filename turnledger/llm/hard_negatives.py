"""Hard negatives by exact inner-product search in cover trees.

1. Vectors become whole numbers. Each is thought of with one more component, so that all have the largest norm; on that sphere the nearest are those of
   largest inner product, and an angle from a tree's node to a query bounds the products of all that the node covers from both sides.
2. Rows are dealt into blocks: by label, within a large label by the nearest of a few pivots (as many of one farthest-first order as
   the label's size asks for), and by hash where a cell is still too large; small cells share blocks. A block has a hundredth of the rows, between two bounds:
   anchors sent to all blocks then move as many rows as there are candidates.
3. A search asks for the best `need` rows of a window of scores, of the anchor's label or of all others. It first goes to the block whose
   bound is highest, then, with the score found there as a floor, to every block that the window can reach. In a block many anchors descend the
   cover tree together; nodes out of an anchor's windows are passed over, the rows of a leaf are scored for all anchors left by one product of matrices
   whose numbers are exact.
4. Positives come from a first search without a window, negatives from a second one with a window for each positive score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, skew_join, stored, with_row_id

#: Components are floor(SCALE * x), held within so many; sums of 2,048 products then fit 64 bits.
SCALE, LARGEST = 256, 1 << 26
#: Rows of a block: a hundredth of all, within these.
LEAST_BLOCK, MOST_BLOCK, BLOCK_SHARE = 2_048, 131_072, 100
#: Pivots come from a sample of so many rows, which bounds the driver's work; every row is dealt to one of them.
MOST_PIVOTS, PIVOT_SAMPLE = 256, 20_000
#: Children of a node, and rows without a node below; labels of fewer rows share a tree.
FAN_OUT, LEAF = 64, 512
#: Pairs of anchor and row that are scored at once, and rows that are met first, while a floor may be low.
PAIRS, FIRST = 1 << 20, 64
#: Bounds are loosened by so much of the largest product, which is far above what rounding does to them.
SLACK = 1e-6
#: Rows closer than this to a node's center are not told apart, and no tree goes deeper than this.
SAME_ANGLE, DEEPEST = 1e-6, 40
#: Blocks whose bounds are sent to the tasks at once.
ROUTED_BLOCKS = 50_000
#: Tasks that search blocks: two a block, so many at most.
MOST_TASKS = 2_000
LOWEST, HIGHEST = -(1 << 62), 1 << 62


class Block(NamedTuple):
    """The cover trees of a block's labels; rows are ordered so that those below a node are a range."""

    rows: np.ndarray  # row ids
    ids: np.ndarray  # vec ids, the largest long for null
    labels: np.ndarray
    values: np.ndarray  # components, of the smallest type that rounds no product
    center: np.ndarray  # of each node: the vector that it stands for, as doubles
    angle: np.ndarray  # of each node: the widest angle from its center to a row below
    span: np.ndarray  # of each node: its range of rows
    children: list[np.ndarray]
    roots: list[tuple[int | None, int]]  # label, none for those that share a tree, and node
    sphere: float


def packed(v: np.ndarray) -> bytes:
    kind = next(t for t in (np.int8, np.int16, np.int32) if not len(v) or (v.min() >= np.iinfo(t).min and v.max() <= np.iinfo(t).max))
    return bytes([np.dtype(kind).itemsize]) + v.astype(kind).tobytes()


def packed_rows(v: np.ndarray) -> list[bytes]:
    """packed() of each row."""
    least, most = v.min(axis=1, initial=0), v.max(axis=1, initial=0)
    out: list[bytes] = [b""] * len(v)
    left = np.ones(len(v), bool)
    for kind in (np.int8, np.int16, np.int32):
        at = np.flatnonzero(left & (least >= np.iinfo(kind).min) & (most <= np.iinfo(kind).max))
        left[at] = False
        size = np.dtype(kind).itemsize
        data, step = v[at].astype(kind).tobytes(), size * v.shape[1]
        for n, i in enumerate(at.tolist()):
            out[i] = bytes([size]) + data[n * step : (n + 1) * step]
    return out


def unpacked_rows(data: list[bytes], width: int | None = None) -> np.ndarray:
    """The vectors as rows of whole numbers, filled with zeros or cut to the width, which is that of the longest if not given."""
    kind = np.array([d[0] for d in data], np.int64)
    wide = (np.array([len(d) for d in data], np.int64) - 1) // np.maximum(kind, 1)
    width = int(wide.max(initial=0)) if width is None else width
    out = np.zeros((len(data), width), np.int64)
    for k, w in set(zip(kind.tolist(), wide.tolist(), strict=True)):
        at = np.flatnonzero((kind == k) & (wide == w))
        part = np.frombuffer(b"".join([data[i][1:] for i in at.tolist()]), f"<i{k}").reshape(len(at), w)
        out[at, : min(w, width)] = part[:, :width]
    return out


def whole_numbers(vectors: pa.ListArray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Which rows have a vector without null or infinite components; these, packed, as floor(SCALE * x) of each component; their squared lengths."""
    offsets, values = vectors.offsets.to_numpy(), vectors.values.to_numpy(zero_copy_only=False)  # null components are NaN
    wide = np.diff(offsets)
    keep = vectors.is_valid().to_numpy(zero_copy_only=False)
    data, n2 = [b""] * len(wide), np.zeros(len(wide), np.int64)
    for w in np.unique(wide[keep]).tolist():
        at = np.flatnonzero(keep & (wide == w))
        part = values[offsets[at][:, None] + np.arange(w)]
        fine = np.isfinite(part).all(axis=1)
        keep[at[~fine]] = False
        v = np.clip(np.floor(SCALE * part[fine].astype(np.float64)), -LARGEST, LARGEST).astype(np.int64)
        n2[at[fine]] = np.einsum("ij,ij->i", v, v)
        for i, one in zip(at[fine].tolist(), packed_rows(v), strict=True):
            data[i] = one
    return keep, [data[i] for i in np.flatnonzero(keep)], n2[keep]


def angles(values: np.ndarray, norms2: np.ndarray, center: int, sphere2: float) -> np.ndarray:
    """On the sphere of the augmented vectors: the angle of each row to the one at `center`."""
    if sphere2 == 0:
        return np.zeros(len(values))
    up = np.sqrt(np.maximum(sphere2 - norms2, 0.0))
    return np.arccos(np.clip((values @ values[center] + up * up[center]) / sphere2, -1.0, 1.0))


def cover(values: np.ndarray, norms2: np.ndarray, sphere2: float, members: np.ndarray, nodes: list, parent: int | None, depth: int = 0) -> int:
    """Adds the nodes of one cover tree, as (center, angle, members, children), and returns the root's number. The centers of a level are taken farthest
    first, until half of the node's angle covers all or there are as many as two to LEAF rows, FAN_OUT at most; each row goes to its nearest center."""
    number = len(nodes)
    node = [int(members[0]) if parent is None else parent, 0.0, members, []]
    nodes.append(node)
    own = values[members], norms2[members]
    first = int(np.flatnonzero(members == node[0])[0])
    near = angles(*own, first, sphere2)
    node[1] = float(near.max())
    if len(members) <= LEAF or node[1] <= SAME_ANGLE or depth == DEEPEST:
        return number
    nearest, centers = np.zeros(len(members), np.int64), [first]
    most = min(FAN_OUT, -(-2 * len(members) // LEAF))
    while len(centers) < most and near.max() > node[1] / 2:
        centers.append(int(near.argmax()))
        d = angles(*own, centers[-1], sphere2)
        closer = d < near
        near, nearest = np.where(closer, d, near), np.where(closer, len(centers) - 1, nearest)
    if len(centers) > 1:
        for n, c in enumerate(centers):
            node[3].append(cover(values, norms2, sphere2, members[nearest == n], nodes, int(members[c]), depth + 1))
    return number


def build(rows: list[int], ids: list[int | None], labels: list[int], vectors: list[bytes], sphere2: int) -> Block:
    """The cover trees of a block, one a label; labels of fewer than LEAF rows share one."""
    whole = unpacked_rows(vectors)
    values = whole.astype(np.float64)
    norms2 = np.einsum("ij,ij->i", values, values)
    label = np.asarray(labels, np.int64)
    nodes: list = []
    known, which, count = np.unique(label, return_inverse=True, return_counts=True)
    roots = [(int(known[n]), cover(values, norms2, float(sphere2), np.flatnonzero(which == n), nodes, None)) for n in np.flatnonzero(count >= LEAF)]
    few = np.flatnonzero(count[which] < LEAF)
    if len(few):
        roots.append((None, cover(values, norms2, float(sphere2), few, nodes, None)))
    order: list[np.ndarray] = []
    span = np.zeros((len(nodes), 2), np.int64)

    def lay(number: int, at: int) -> int:
        span[number, 0] = at
        if nodes[number][3]:
            for child in nodes[number][3]:
                at = lay(child, at)
        else:
            order.append(nodes[number][2])
            at += len(nodes[number][2])
        span[number, 1] = at
        return at

    at = 0
    for _, root in roots:
        at = lay(root, at)
    place = np.concatenate(order)
    # sums of products of two vectors, and parts of them, stay below the largest squared length
    kind = np.float32 if sphere2 < 2**24 else np.float64 if sphere2 < 2**53 else np.int64
    ids = np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64) if isinstance(ids, list) else ids
    return Block(
        np.asarray(rows, np.int64)[place], ids[place], label[place], whole[place].astype(kind), values[[n[0] for n in nodes]],
        np.array([n[1] for n in nodes]), span, [np.array(n[3], np.int64) for n in nodes], roots, math.sqrt(sphere2),
    )


def bounds(product: np.ndarray, angle: np.ndarray, length: float | np.ndarray, sphere: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest product of a query of this length with what lies within an angle of centers that have these products with it."""
    scale = np.asarray(length * sphere, np.float64)
    turn = np.arccos(np.clip(product / np.where(scale == 0, 1.0, scale), -1.0, 1.0))
    return scale * (np.cos(np.minimum(turn + angle, math.pi)) - SLACK), scale * (np.cos(np.maximum(turn - angle, 0.0)) + SLACK)


def best(block: Block, row: np.ndarray, label: np.ndarray, vectors: list[bytes], which: np.ndarray, same: bool, lo: np.ndarray, hi: np.ndarray, need: int) -> tuple[np.ndarray, ...]:
    """row, label, vectors: of each anchor. which, lo, hi: of each request, its anchor (in order, none without a request) and its window. For each request the best `need` rows of the
    anchor's label, or of others, with lo <= score <= hi: request, score, vec id, row, better ones first; ties go to the smaller id."""
    every = unpacked_rows(vectors).astype(np.float64)
    length = np.sqrt(np.einsum("ij,ij->i", every, every))
    whole = unpacked_rows(vectors, block.values.shape[1])
    v, own = whole.astype(np.float64), whole.astype(block.values.dtype)
    first = np.flatnonzero(np.diff(which, prepend=-1))
    asks = np.diff(first, append=len(which))
    floor, most = lo.copy(), np.maximum.reduceat(hi, first)
    held, score, place = np.zeros(len(which), np.int64), np.zeros((len(which), need), np.int64), np.zeros((len(which), need), np.int64)

    def kept(q: np.ndarray, s: np.ndarray, p: np.ndarray) -> None:
        """Hits of requests beside what these have: the best stay and raise the floor."""
        touched = np.unique(q)
        there = np.arange(need) < held[touched][:, None]
        q, s, p = np.concatenate([np.repeat(touched, held[touched]), q]), np.concatenate([score[touched][there], s]), np.concatenate([place[touched][there], p])
        order = np.lexsort((block.rows[p], block.ids[p], -s, q))
        q, s, p = q[order], s[order], p[order]
        begin = np.flatnonzero(np.diff(q, prepend=-1))
        nth = np.arange(len(q)) - np.repeat(begin, np.diff(begin, append=len(q)))
        top = nth < need
        score[q[top], nth[top]], place[q[top], nth[top]] = s[top], p[top]
        held[touched] = np.minimum(np.diff(begin, append=len(q)), need)
        full = touched[held[touched] == need]
        floor[full] = np.maximum(lo[full], score[full, need - 1])

    def met(anchors: np.ndarray, at: int, end: int, mixed: bool) -> int:
        """Scores a range of rows; how many hits there were."""
        product = own[anchors] @ block.values[at:end].T
        least = np.minimum.reduceat(floor, first)[anchors]
        hit = (product >= least.astype(product.dtype)[:, None]) & (product <= most[anchors].astype(product.dtype)[:, None])
        if mixed:
            hit &= (block.labels[at:end] == label[anchors][:, None]) == same
        i, j = np.nonzero(hit)
        s, p, i = product[i, j].astype(np.int64), j + at, anchors[i]
        found = []
        for k in range(int(asks[i].max(initial=0))):
            r = first[i] + np.minimum(k, asks[i] - 1)
            ok = (k < asks[i]) & (s >= floor[r]) & (s <= hi[r]) & (block.rows[p] != row[i])
            found.append((r[ok], s[ok], p[ok]))
        if any(len(x[0]) for x in found):
            kept(*map(np.concatenate, zip(*found, strict=True)))
        return len(s)

    def down(number: int, anchors: np.ndarray, mixed: bool, step: int) -> int:
        """Meets the rows below a node; how many of them may be scored at once, as floors are by then."""
        low, high = bounds(v[anchors] @ block.center[number], block.angle[number], length[anchors], block.sphere)
        anchors = anchors[(high >= np.minimum.reduceat(floor, first)[anchors]) & (low <= most[anchors])]
        if not len(anchors):
            return step
        for child in block.children[number]:
            step = down(int(child), anchors, mixed, step)
        at, end = block.span[number] if not len(block.children[number]) else (0, 0)
        while at < end:
            upto = min(end, at + max(FIRST, min(step, PAIRS // len(anchors))))
            hits = met(anchors, at, upto, mixed)
            step = PAIRS if hits <= 2 * need * asks[anchors].sum() else min(PAIRS, 4 * step)
            at = upto
        return step

    step = FIRST
    for name, root in block.roots:
        anchors = np.arange(len(row)) if name is None else np.flatnonzero((label == name) == same)
        if len(anchors):
            step = down(root, anchors, name is None, step)
    there = np.arange(need) < held[:, None]
    p = place[there]
    return np.repeat(np.arange(len(which)), held), score[there], block.ids[p], block.rows[p]


class Query:
    """One anchor in one block."""

    def __init__(self, block: Block, row: int, label: int, vector: bytes):
        self.block, self.row, self.label, self.vector = block, row, label, vector

    def best(self, same: bool, lo: int, hi: int, need: int) -> list[tuple[int, int, int]]:
        """(score, vec id, row) of the best `need` rows with lo <= score <= hi, better ones first; ties go to the smaller id."""
        one = lambda x: np.array([x], np.int64)
        _, *hits = best(self.block, one(self.row), one(self.label), [self.vector], one(0), same, one(lo), one(hi), need)
        return list(zip(*(h.tolist() for h in hits), strict=True))


_VECTORS = "row long, vec_id long, label long, anchor boolean, v binary, n2 long"
_ROWS = "block long, kind int, row long, vec_id long, label long, v binary, same boolean, req long, lo long, hi long"
_HITS = "anchor long, same boolean, req long, score long, vec_id long, row long"
_SUMMARY = "block long, label long, mixed boolean, v binary, angle double"


def clean_vectors(rows: DataFrame) -> DataFrame:
    """rows: vec_id, label, vector, anchor. row, vec_id, label, anchor, v (packed whole numbers), n2 of the rows that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, data, n2 = whole_numbers(batch.column(4))
            left = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*left.columns[:4], pa.array(data, pa.binary()), pa.array(n2, pa.int64())], ["row", "vec_id", "label", "anchor", "v", "n2"])

    some = rows.filter("label IS NOT NULL AND vector IS NOT NULL").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.coalesce("anchor", F.lit(False)).alias("anchor"), F.col("vector").cast("array<double>").alias("vector"))
    return stored(with_row_id(some, "row").select("row", "vec_id", "label", "anchor", "vector").mapInArrow(run, _VECTORS))


def pivots(vectors: DataFrame, many: int, sphere2: int) -> np.ndarray:
    """`many` rows of a sample of PIVOT_SAMPLE, farthest first: however many of them are taken from the front, they lie apart."""
    sample = [bytes(r["v"]) for r in vectors.select("v", F.xxhash64("row").alias("h")).orderBy("h").limit(PIVOT_SAMPLE).collect()]
    values = unpacked_rows(sample).astype(np.float64)
    norms2 = np.einsum("ij,ij->i", values, values)
    chosen = [0]
    near = angles(values, norms2, 0, float(sphere2))
    while len(chosen) < min(many, len(values)):
        chosen.append(int(near.argmax()))
        near = np.minimum(near, angles(values, norms2, chosen[-1], float(sphere2)))
    return values[chosen]


def in_blocks(vectors: DataFrame, n: int, sphere2: int) -> DataFrame:
    """block, row, vec_id, label, v of every row."""
    size = max(LEAST_BLOCK, min(MOST_BLOCK, n // BLOCK_SHARE))
    cells = F.least(F.ceil(F.col("m") / size), F.lit(MOST_PIVOTS)).cast("int")
    labels = stored(vectors.groupBy("label").agg(F.count(F.lit(1)).alias("m")).withColumn("cells", cells))
    many = labels.agg(F.max("cells").alias("n")).first()["n"]
    dealt = skew_join(vectors.select("row", "vec_id", "label", "v", "n2"), labels, ["label"], "m")
    held = vectors.sparkSession.sparkContext.broadcast(pivots(vectors, many, sphere2) if many > 1 else np.zeros((1, 1)))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = held.value
        up = np.sqrt(np.maximum(sphere2 - np.einsum("ij,ij->i", p, p), 0.0))
        for batch in batches:
            v = unpacked_rows(batch.column(3).to_pylist(), p.shape[1]).astype(np.float64)
            near = v @ p.T + np.sqrt(np.maximum(float(sphere2) - batch.column(4).to_numpy(), 0.0))[:, None] * up
            near[np.arange(len(p)) >= batch.column(5).to_numpy()[:, None]] = -np.inf
            out = near.argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(out, pa.int32())], ["row", "vec_id", "label", "v", "cell"])

    dealt = stored(dealt.select("row", "vec_id", "label", "v", "n2", "cells").mapInArrow(nearest, "row long, vec_id long, label long, v binary, cell int"))
    sizes = stored(dealt.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("m")))
    small = F.col("m") < size / 2
    bins = max(1, -(-(sizes.filter(small).agg(F.sum("m").alias("m")).first()["m"] or 0) // size))
    whole = sizes.withColumns({"parts": F.when(small, 0).otherwise(F.greatest(F.lit(1), F.round(F.col("m") / size))).cast("int")})
    own = F.xxhash64(F.lit("cell"), "label", "cell", F.pmod(F.xxhash64("row"), F.greatest("parts", F.lit(1))))
    shared = F.xxhash64(F.lit("bin"), F.pmod(F.xxhash64("label", "cell"), F.lit(bins)))
    placed = skew_join(dealt, whole, ["label", "cell"], "m")
    return stored(placed.select(F.when(F.col("parts") > 0, own).otherwise(shared).alias("block"), "row", "vec_id", "label", "v"))


def _by_block(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple], Iterator[tuple] | None]]:
    """(block, its rows) of rows sorted by block."""
    held: list[tuple] = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and r[0] != held[0][0]:
                yield held[0][0], held
                held = []
            held.append(r)
    if held:
        yield held[0][0], held


def summaries(blocks: DataFrame, sphere2: int) -> DataFrame:
    """block, label, mixed (it has several labels), v (one row), angle (the widest from that row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _by_block(batches):
            values = unpacked_rows([r[2] for r in rows]).astype(np.float64)
            angle = float(angles(values, np.einsum("ij,ij->i", values, values), 0, float(sphere2)).max())
            mixed = any(r[1] != rows[0][1] for r in rows)
            columns = [pa.array([block], pa.int64()), pa.array([rows[0][1]], pa.int64()), pa.array([mixed]), pa.array([rows[0][2]], pa.binary()), pa.array([angle])]
            yield pa.RecordBatch.from_arrays(columns, ["block", "label", "mixed", "v", "angle"])

    dealt = blocks.repartition("block").sortWithinPartitions("block", "row")
    return stored(dealt.select("block", "label", "v").mapInArrow(run, _SUMMARY))


def routed(requests: DataFrame, summary: DataFrame, sphere2: int, first: bool) -> DataFrame:
    """requests: row, label, v, same, req, lo, hi and, unless first, visited. A request for each block that it has to see: the one of highest bound if first, else all
    that its window can reach but the visited one. Bounds of blocks go to the tasks in parts of ROUTED_BLOCKS."""
    spark = requests.sparkSession
    parts = max(1, -(-summary.count() // ROUTED_BLOCKS))
    sphere = math.sqrt(sphere2)
    names = ["row", "label", "v", "same", "req", "lo", "hi"]

    def to(part: int) -> DataFrame:
        known = summary.filter(F.pmod(F.xxhash64("block"), F.lit(parts)) == part).collect()
        values = unpacked_rows([bytes(r["v"]) for r in known]).astype(np.float64)
        held = spark.sparkContext.broadcast((np.array([r["block"] for r in known], np.int64), np.array([r["label"] for r in known], np.int64), np.array([r["mixed"] for r in known], bool), values, np.array([r["angle"] for r in known])))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            blocks, labels, mixed, values, angle = held.value
            for batch in batches:
                step = max(1, PAIRS // max(1, len(blocks)))
                for part in (batch.slice(at, step) for at in range(0, batch.num_rows, step)):
                    label, same, lo, hi = (part.column(i).to_numpy(zero_copy_only=False)[:, None] for i in (1, 3, 5, 6))
                    v = unpacked_rows(part.column(2).to_pylist()).astype(np.float64)
                    length = np.sqrt(np.einsum("ij,ij->i", v, v))[:, None]
                    width = min(v.shape[1], values.shape[1])
                    low, high = bounds(v[:, :width] @ values[:, :width].T, angle, length, sphere)
                    ok = (mixed | ((labels == label) == same)) & (high >= lo) & (low <= hi)
                    if first:
                        top = np.where(ok, np.minimum(high, hi), -np.inf).argmax(axis=1) if len(blocks) else 0
                        ok &= np.arange(len(blocks)) == np.reshape(top, (-1, 1))
                    else:
                        seen = pc.fill_null(part.column(7), 0).to_numpy()[:, None]
                        ok &= (blocks != seen) | part.column(7).is_null().to_numpy(zero_copy_only=False)[:, None]
                    which, to_ = np.nonzero(ok)
                    yield pa.RecordBatch.from_arrays([pa.array(blocks[to_], pa.int64()), *(c.take(pa.array(which, pa.int64())) for c in part.columns[:7])], ["block", *names])

        columns = requests.select(*names, *([] if first else ["visited"]))
        return columns.mapInArrow(run, "block long, row long, label long, v binary, same boolean, req long, lo long, hi long")

    out = to(0)
    for part in range(1, 1 if first else parts):
        out = out.unionByName(to(part))
    return out


def visited(blocks: DataFrame, requests: DataFrame, sphere2: int, need: int, tasks: int) -> DataFrame:
    """What each request (block, row, label, v, same, req, lo, hi) finds in its block: the best `need` rows, one row each. A task builds the cover trees of a block and
    then reads its requests as a stream. The work lies in pairs and not in bytes, so blocks go to `tasks` tasks whatever their size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, block = None, None
        parts: list[pa.RecordBatch] = []
        for batch in batches:
            b, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(kind) != 0)) + 1
            for begin, end in pairwise([0, *cuts.tolist(), len(b)] if len(b) else []):
                if b[begin] != at:
                    at, parts, block = b[begin], [], None
                part = batch.slice(begin, end - begin)
                if kind[begin] == 0:
                    parts.append(part)
                    continue
                if block is None:
                    if not parts:
                        continue
                    own, parts = pa.Table.from_batches(parts).combine_chunks(), []
                    ids = pc.fill_null(own.column("vec_id"), np.iinfo(np.int64).max).to_numpy()
                    block = build(own.column("row").to_numpy(), ids, own.column("label").to_numpy(), own.column("v").to_pylist(), sphere2)
                asked = pa.Table.from_batches([part])
                for same in (True, False):
                    some = asked.filter(pc.equal(asked.column("same"), same))
                    if not some.num_rows:
                        continue
                    row, req, lo, hi = (some.column(c).to_numpy() for c in ("row", "req", "lo", "hi"))
                    first = np.concatenate([[0], np.flatnonzero(np.diff(row)) + 1])
                    which = np.repeat(np.arange(len(first)), np.diff(first, append=len(row)))
                    q, *hits = best(block, row[first], some.column("label").to_numpy()[first], some.column("v").take(pa.array(first)).to_pylist(), which, same, lo, hi, need)
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in ((row[q], pa.int64()), (np.full(len(q), same), pa.bool_()), *((x, pa.int64()) for x in (req[q], *hits)))], ["anchor", "same", "req", "score", "vec_id", "row"])

    nothing = F.lit(None)
    own = blocks.select("block", F.lit(0).alias("kind"), "row", "vec_id", "label", "v", *(nothing.cast(t).alias(c) for c, t in (("same", "boolean"), ("req", "long"), ("lo", "long"), ("hi", "long"))))
    asked = requests.select("block", F.lit(1).alias("kind"), "row", nothing.cast("long").alias("vec_id"), "label", "v", "same", "req", "lo", "hi")
    dealt = own.unionByName(asked).repartition(tasks, "block").sortWithinPartitions("block", "kind", "row", "req")
    return stored(dealt.mapInArrow(run, _HITS))


def searched(blocks: DataFrame, summary: DataFrame, requests: DataFrame, sphere2: int, need: int) -> DataFrame:
    """The best `need` rows of each request over all blocks, by score, then vec_id: anchor, req, score, vec_id, row, nth."""
    tasks = min(MOST_TASKS, 2 * summary.count())
    head = stored(routed(requests, summary, sphere2, first=True))
    found = visited(blocks, head, sphere2, need, tasks)
    floor = found.groupBy(F.col("anchor").alias("row"), "req").agg(F.count(F.lit(1)).alias("hits"), F.min("score").alias("least"))
    seen = head.select("row", "req", F.col("block").alias("visited")).join(floor.hint("shuffle_merge"), ["row", "req"], "left")
    rest = requests.join(seen.hint("shuffle_merge"), ["row", "req"], "left")
    rest = rest.withColumn("lo", F.when(F.col("hits") >= need, F.greatest("lo", "least")).otherwise(F.col("lo")))
    more = visited(blocks, routed(rest, summary, sphere2, first=False), sphere2, need, tasks)
    nth = F.row_number().over(Window.partitionBy("anchor", "req").orderBy(F.desc("score"), "vec_id", "row"))
    return found.unionByName(more).withColumn("nth", nth).filter(F.col("nth") <= need).select("anchor", "req", "score", "vec_id", "row", "nth")


def hard_negatives(rows: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """rows: vec_id, label, vector, anchor (true where negatives are sought). anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    A row's score is the inner product of whole numbers with the anchor's. An anchor's positives are its first other rows of the same label, a positive's negatives the first rows of
    other labels whose score lies between `low` and `high` percent of the positive's; higher scores come first, ties by smaller vec_id, null ids last. Rows with a
    null label, a null vector, or a component that is null or not finite take no part. Vectors of unequal length are as if filled with zeros. Rows that repeat an id
    are rows of their own, so a repeated anchor gives its results again. An empty table, and an anchor or positive without a match, give no rows; other
    columns are not read. Components beyond LARGEST count as LARGEST."""
    spark = rows.sparkSession
    vectors = clean_vectors(rows)
    n, sphere2 = vectors.agg(F.count(F.lit(1)), F.max("n2")).first()
    if not n:
        return spark.range(0).select(*(F.lit(0).cast(t).alias(c) for c, t in (("anchor_id", "long"), ("positive_id", "long"), ("rank", "int"), ("negative_id", "long"), ("positive_score", "long"), ("negative_score", "long"))))
    blocks = in_blocks(vectors, n, sphere2)
    summary = summaries(blocks, sphere2)
    anchors = stored(vectors.filter("anchor").select("row", "vec_id", "label", "v"))
    ask = anchors.select("row", "label", "v", F.lit(True).alias("same"), F.lit(0).cast("long").alias("req"), F.lit(LOWEST).alias("lo"), F.lit(HIGHEST).alias("hi"))
    best = stored(searched(blocks, summary, ask, sphere2, positives).select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    share = lambda p, up: F.expr(f"(positive_score div 100) * {p} + cast({'ceil' if up else 'floor'}(positive_score % 100 * {p} / 100.0) as bigint)")
    windows = best.select(F.col("anchor").alias("row"), "positive_score").distinct().select("row", F.col("positive_score").alias("req"), share(low, True).alias("lo"), share(high, False).alias("hi")).filter("lo <= hi")
    ask = windows.join(anchors.select("row", "label", "v").hint("shuffle_merge"), "row").withColumn("same", F.lit(False))
    found = searched(blocks, summary, stored(ask), sphere2, negatives).select("anchor", F.col("req").alias("positive_score"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"), F.col("nth").alias("rank"))
    known = lambda c: F.nullif(F.col(c), F.lit(2**63 - 1)).alias(c)
    named = best.join(found.hint("shuffle_merge"), ["anchor", "positive_score"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")).hint("shuffle_merge"), "anchor")
    return named.select("anchor_id", known("positive_id"), F.col("rank").cast("int").alias("rank"), known("negative_id"), "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; labels of those divisible by 7 are moved on by one first."""
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return hard_negatives(read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), F.col("embedding").alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor")))


OP13_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS c FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.r AS ar, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, a.r = b.r AS own, CAST(list_inner_product(a.c, b.c) AS BIGINT) AS score FROM v a, v b WHERE a.vec_id % 100 = 0
), p AS (
  SELECT ar, anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) AS nth FROM s WHERE same AND NOT own QUALIFY nth <= 5
), n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.nth ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.ar = p.ar AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score QUALIFY rank <= 5
)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
