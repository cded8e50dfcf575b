"""N-gram Jaccard self-join over whole texts, reported as components of the link graph.

1. Equal shingle sets become one. A set's necessary prefix is its first n - ceil(t n) + 1 shingles in one global
   order (shingles that counts over all documents find frequent come last, else by hash): linked sets share a prefix shingle.
2. Sets that share a prefix shingle lie in one tile, sorted by size and cut into bands that a link can span.
   Each is tried against the smallest of its band; links found this way join most copies of a text.
3. Only pairs of different components are still open. In each tile their bitmap signatures (parity bits, in proportion to the set's size)
   bound the overlap from above; pairs that pass are verified by intersecting the sorted shingle arrays. A tile with more
   such pairs than sets first offers each set's closest partner and a tree of close pairs over its components; what links is merged, and the open pairs are
   sought anew, with PAIRS_GROW times as many pairs a set allowed in each round. Once a round merges nothing, or a set may have as many pairs as a block has sets, all that are left are verified.

Every link between different texts is either verified or already implied by others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, skew_join, small_batches, spaced_words, stored, text_bytes, with_row_id
from .exact_dedup import filter_bits, holds, row_key, seen_filter, without_rows

#: Counters of the shingle counts, by the upper bits of a shingle's hash. They steer the order, never the result.
COUNTERS_LOG2 = 20
#: A shingle is frequent if its counter stands out of the median counter by so many standard deviations of a Poisson count.
FREQUENT_SIGMAS = 6
#: Bytes of text whose shingles are counted at once.
COUNT_BYTES = 1 << 20
#: The tile of a frequent shingle is dealt over a task for every SALT_SETS sets of the corpus, LEAST_SALTS at least.
SALT_SETS, LEAST_SALTS = 100_000, 16
#: The fewest bits of a signature.
LEAST_BITS = 128
#: Sets of one block of a tile, and 64-bit words of signatures that are compared at once.
TILE, PAIR_WORDS = 1_024, 1 << 20
#: Tiles up to this size are compared without arrays.
FEW_SETS = 24
#: A block may have one open pair a set in the first round, and so many times as many in each that follows.
PAIRS_GROW = 16
#: Links that a task joins at once, 16 bytes each.
LINKS_AT_ONCE = 100_000
CACHE_WORDS = 100_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Ids(dict):
    """64-bit ids of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_ids = _Ids()


def shingle_hashes(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; fewer words are one shingle, none are none."""
    words = spaced_words(text)
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(_ids.__getitem__, words), np.uint64, len(words))
    return np.unique(_shingled(w, min(k, len(w))))


def _shingled(w: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all runs of `size` words."""
    out = np.full(len(w) - size + 1, size, np.uint64)
    for j in range(size):
        out = (out ^ w[j : len(w) - size + 1 + j]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def signature_bits(n: int, percent: int) -> int:
    """How many bits the signature of n shingles has: a power of two, so many that two strangers are expected to differ in twice as many as a link allows."""
    return max(LEAST_BITS, 1 << max(0, -(-8 * (100 - percent) * n // (100 + percent)) - 1).bit_length())


def parity_bits(shingles: np.ndarray, percent: int) -> bytes:
    """Each shingle flips one of signature_bits bits. Two signatures differ in no more bits than the sets in shingles, and a longer
    one folds to the length of a shorter one."""
    bits = signature_bits(len(shingles), percent)
    at = (shingles * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)
    return np.packbits((np.bincount((at & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(signature: np.ndarray, words: int) -> np.ndarray:
    """Signatures (last axis: 64-bit words) folded to so many words."""
    while signature.shape[-1] > words:
        half = signature.shape[-1] // 2
        signature = signature[..., :half] ^ signature[..., half:]
    return signature


def bits_apart(x: bytes, y: bytes) -> int:
    """In how many bits two signatures differ, the longer folded to the shorter."""
    while len(x) < len(y):
        half = len(y) // 2
        y = (int.from_bytes(y[:half]) ^ int.from_bytes(y[half:])).to_bytes(half)
    return (int.from_bytes(x) ^ int.from_bytes(y)).bit_count()


def frequent(shingles: np.ndarray, counters: np.ndarray) -> np.ndarray:
    return counters[(shingles >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64)]


def prefix(shingles: np.ndarray, counters: np.ndarray, percent: int) -> np.ndarray:
    """The necessary prefix in the order (frequent or not, hash)."""
    n = len(shingles)
    length = n - -(-percent * n // 100) + 1
    late = frequent(shingles, counters)
    return np.concatenate([shingles[~late], shingles[late]])[:length]


def frequent_counters(docs: DataFrame, k: int, text_col: str) -> np.ndarray:
    """For each counter, whether its shingles count as frequent. Every shingle of every document is counted, as often as it
    occurs; a task hands over one array of counters, cut into slices, and the sums reach the driver: 8 MB whatever the corpus."""
    slices = 16
    size = (1 << COUNTERS_LOG2) // slices

    def counted(texts: list[bytes]) -> np.ndarray:
        """Counts of all k-word shingles of some texts, hashed at one go; no shingle crosses from one text to the next."""
        split = [w for w in map(spaced_words, texts) if w]
        w = np.fromiter(map(_ids.__getitem__, chain.from_iterable(split)), np.uint64, sum(map(len, split)))
        if len(w) < k:
            return np.zeros(1 << COUNTERS_LOG2, np.int64)
        ends = np.cumsum([len(x) for x in split])
        starts = np.concatenate([np.arange(max(a, b - k + 1), b) for a, b in zip(ends - [len(x) for x in split], ends, strict=True)])
        whole = np.ones(len(w), bool)
        whole[starts] = False
        hashes = _shingled(w, k)[whole[: len(w) - k + 1]]
        return np.bincount((hashes >> np.uint64(64 - COUNTERS_LOG2)).astype(np.int64), minlength=1 << COUNTERS_LOG2)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, weight = np.zeros(1 << COUNTERS_LOG2, np.int64), [], 0
        for batch in batches:
            for t in batch.column(0):
                held.append(t.as_py() or b"")
                weight += len(held[-1])
                if weight >= COUNT_BYTES:
                    total += counted(held)
                    held, weight = [], 0
        total += counted(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(slices), pa.int64()), pa.array([_packed(total[i * size : (i + 1) * size]) for i in range(slices)], pa.binary())], ["slice", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[i] = held[i] + _unpacked(sums) if i in held else _unpacked(sums)
        for i, sums in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([sums.tobytes()], pa.binary())], ["slice", "sums"])

    parts = docs.select(text_bytes(text_col).alias("text")).mapInArrow(count, "slice long, sums binary").repartition(slices, "slice")
    counters = np.zeros(1 << COUNTERS_LOG2, np.int64)
    with small_batches(docs.sparkSession):
        for r in parts.mapInArrow(add, "slice long, sums binary").collect():
            counters[r["slice"] * size : (r["slice"] + 1) * size] = np.frombuffer(r["sums"], np.int64)
    middle = float(np.median(counters))
    return counters > middle + FREQUENT_SIGMAS * max(1.0, middle) ** 0.5


def _packed(sums: np.ndarray) -> bytes:
    """The narrowest of 1, 2, 4 and 8 bytes a counter."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if sums.max() <= np.iinfo(t).max)
    return bytes([np.dtype(kind).itemsize]) + sums.astype(kind).tobytes()


def _unpacked(sums: bytes) -> np.ndarray:
    return np.frombuffer(sums, f"<u{sums[0]}", offset=1).astype(np.int64)


_FEATURES = "row_id long, doc_id long, n long, d1 long, d2 long, bits binary, prefix array<long>"


def features(docs: DataFrame, k: int, percent: int, hot, id_col: str, text_col: str, digests: bool = False) -> DataFrame:
    """One row per input row; with digests also the text's SHA-256 as digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, d1, d2, bits, heads = [], [], [], [], []
            for t in batch.column(2):
                s = shingle_hashes(t.as_py(), k)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                n.append(len(s))
                d1.append(digest[0])
                d2.append(digest[1])
                bits.append(parity_bits(s, percent))
                heads.append(prefix(s, hot.value, percent).view(np.int64) if len(s) else [])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(bits, pa.binary()), pa.array(heads, pa.list_(pa.int64())), *batch.columns[3:]],
                ["row_id", "doc_id", "n", "d1", "d2", "bits", "prefix", *batch.schema.names[3:]],
            )

    rows = with_row_id(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text")))
    digest = [F.sha2("text", 256).alias("digest")] if digests else []
    return rows.select("row_id", "doc_id", "text", *digest).mapInArrow(run, _FEATURES + ", digest string" * digests)


def _stars(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """rows: shingle, salt, set, n. Every row of a tile of two or more, with the smallest set of its band.
    Tiles are read in order and never held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile = pending = rep = None
        rep_n = 0
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            if not batch.num_rows:
                continue
            # tiles of one row, which are most, are passed over unless they may go on in another batch
            new = np.r_[True, np.logical_or(*(np.diff(batch.column(i).to_numpy()) != 0 for i in (0, 1))), True]
            single = new[:-1] & new[1:]
            single[[0, -1]] = False
            shingle, salt, one, size = (c.to_pylist() for c in batch.filter(pa.array(~single)).columns)
            for s, x, u, n in zip(shingle, salt, one, size, strict=True):
                if (s, x) != tile:
                    tile, pending, rep, rep_n = (s, x), (s, x, u, n, u), u, n
                    continue
                if pending:
                    for c, v in zip(out, pending, strict=True):
                        c.append(v)
                    pending = None
                if 100 * rep_n < percent * n:
                    rep, rep_n = u, n
                for c, v in zip(out, (s, x, u, n, rep), strict=True):
                    c.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["shingle", "salt", "set", "n", "rep"])

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "n", "set")
    return dealt.select("shingle", "salt", "set", "n").mapInArrow(run, "shingle long, salt long, set long, n long, rep long")


def _arrays(docs: DataFrame, needed: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """set, shingles of the needed sets (set, doc_id, d1, d2). Texts are read again; a Bloom filter over the ids
    lets all but the needed ones pass by without being cut into shingles."""
    hashed = F.xxhash64(F.col(id_col).cast("long"))
    needed = stored(needed.withColumn("h", F.xxhash64("doc_id")))
    held = docs.sparkSession.sparkContext.broadcast(seen_filter(needed.select("h"), filter_bits(needed.count())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [])
            if batch.num_rows:
                may = holds(held.value, batch.column(0).to_numpy())
                for t in batch.column(1).filter(pa.array(may)):
                    s = shingle_hashes(t.as_py(), k)
                    if len(s):
                        digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                        for c, v in zip(out, (digest[0], digest[1], s.view(np.int64)), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.list_(pa.int64()))], ["d1", "d2", "shingles"])

    texts = docs.select(hashed.alias("h"), text_bytes(text_col).alias("text"))
    found = texts.mapInArrow(run, "d1 long, d2 long, shingles array<long>").dropDuplicates(["d1", "d2"])
    return stored(found.join(needed.select("set", "d1", "d2").hint("shuffle_merge"), ["d1", "d2"]).select("set", "shingles"))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, screened: bool = False) -> DataFrame:
    """The pairs (a, b) that are links. Signatures first, unless the stored pairs have been screened by them, then shingle arrays."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y, total in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                words = min(len(x), len(y))
                ok.append(int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) * (100 + percent) <= (100 - percent) * total)
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = x.values.to_numpy(), y.values.to_numpy()
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    def side(df: DataFrame, key: str, *cols: str) -> DataFrame:
        return df.select(F.col("set").alias(key), *(F.col(c).alias(f"{c}_{key}") for c in cols)).hint("shuffle_merge")

    close = pairs
    if not screened:
        wide = pairs.join(side(sets, "a", "bits", "n"), "a").join(side(sets, "b", "bits", "n"), "b")
        close = stored(wide.select("a", "b", "bits_a", "bits_b", (F.col("n_a") + F.col("n_b")).alias("total")).mapInArrow(near, "a long, b long"))
    ends = close.select(F.col("a").alias("set")).unionByName(close.select(F.col("b").alias("set"))).distinct()
    arrays = _arrays(docs, ends.join(sets.select("set", "doc_id", "d1", "d2").hint("shuffle_merge"), "set"), k, id_col, text_col)
    full = close.join(side(arrays, "a", "shingles"), "a").join(side(arrays, "b", "shingles"), "b")
    with small_batches(docs.sparkSession, 500):
        return stored(full.select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long"))


def smallest_joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sets that the links (a, b) name, and for each the smallest that it can reach by them."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(ids))
    while True:
        x, y = label[at[: len(a)]], label[at[len(a) :]]
        if (x == y).all():
            return ids, ids[label]
        # of two labels side by side the larger one takes the smaller, and all follow their labels to the end
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """(set, comp) for the sets that have a link: comp is the smallest set reachable. First each task joins its own links,
    LINKS_AT_ONCE at a time, into stars around their smallest sets; where all links are no more than that, this is all. Else rounds follow over the stars: each takes the
    smallest label next to a set and then that label's own; they end when nothing changes. The hub of a star of links, and
    the label of a giant component, are hot keys of plain joins, which adaptive execution splits."""
    most = LINKS_AT_ONCE

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if held and (batch is None or sum(x.num_rows for x in held) + batch.num_rows > most):
                found = smallest_joined(*(np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1)))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in found], ["set", "comp"])
                held = []
            if batch is not None and batch.num_rows:
                held.append(batch)

    tasks = max(1, -(-links.count() // most))
    stars = stored(links.select("a", "b").coalesce(tasks).mapInArrow(join, "set long, comp long"))
    if tasks == 1:
        return stars
    links = stars.filter("set <> comp").select(F.col("set").alias("a"), F.col("comp").alias("b"))
    both = stored(links.select(F.col("a").alias("set"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("set"), F.col("a").alias("other"))).distinct())
    labels = stored(both.groupBy("set").agg(F.least(F.col("set"), F.min("other")).alias("comp")))
    while True:
        told = both.join(labels.select(F.col("set").alias("other"), "comp").hint("shuffle_merge"), "other").select("set", "comp", F.lit(None).cast("long").alias("was"))
        near = stored(told.unionByName(labels.withColumn("was", F.col("comp"))).groupBy("set").agg(F.min("comp").alias("comp"), F.max("was").alias("was")))
        up = near.select(F.col("set").alias("comp"), F.col("comp").alias("top"))
        after = stored(near.join(up.hint("shuffle_merge"), "comp").select("set", F.col("top").alias("comp"), "was"))
        if after.filter("comp <> was").isEmpty():
            return after.drop("was")
        labels = after.drop("was")


def _size_blocks(rows: DataFrame, percent: int) -> DataFrame:
    """rows: shingle, set, comp, n, major of large tiles. Adds own, the row's block, and others, the blocks that it has to meet.

    Sets of a tile fall into bands of sizes: a link joins sets of one band or of neighbouring ones. Each band is dealt into blocks of about TILE sets, those of the tile's largest
    component apart from the rest; two blocks of the largest component never meet."""
    # a little wider than the reach of a link, so that rounding never puts a band between two linked sets
    width = max(0.01, math.log(100 / percent) * (1 + 1e-9))
    band = F.floor(F.log(F.col("n")) / width).cast("long")
    rows = rows.withColumns({"band": band, "is_major": F.col("comp").eqNullSafe(F.col("major"))})
    blocks = lambda c: F.ceil(F.count_if(c) / TILE).cast("long")
    sizes = rows.groupBy("shingle", "band").agg(blocks(F.col("is_major")).alias("majors"), blocks(~F.col("is_major")).alias("minors"))
    held = F.struct("band", "majors", "minors")
    by_band = Window.partitionBy("shingle").orderBy("band")
    sizes = stored(sizes.select("shingle", "band", "majors", "minors", F.lag(held).over(by_band).alias("below"), F.lead(held).over(by_band).alias("above")))
    rows = rows.join(sizes.hint("shuffle_merge"), ["shingle", "band"])
    code = lambda band, kind, part: F.shiftleft(band * 2 + kind, 32) + part
    none = F.array().cast("array<bigint>")

    def numbered(band, kind: int, parts):
        return F.when(parts > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(parts, F.lit(1)) - 1), lambda x: code(band, kind, x))).otherwise(none)

    def of(band, majors, minors):
        return F.concat(numbered(band, 0, minors), F.when(F.col("is_major"), none).otherwise(numbered(band, 1, majors)))

    near = [F.when(F.col(c)["band"] == F.col("band") + d, of(F.col(c)["band"], F.col(c)["majors"], F.col(c)["minors"])).otherwise(none) for c, d in (("below", -1), ("above", 1))]
    part = F.pmod(F.xxhash64("set"), F.greatest(F.when(F.col("is_major"), F.col("majors")).otherwise(F.col("minors")), F.lit(1)))
    own = code(F.col("band"), F.col("is_major").cast("long"), part)
    return rows.select("shingle", "set", "comp", "n", own.alias("own"), F.concat(of(F.col("band"), F.col("majors"), F.col("minors")), *near).alias("others"))


def spanning(a: np.ndarray, b: np.ndarray, share: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which pairs (a, b), by rising share, join all components (labels of the sets) that the pairs can join, and none twice: each round takes the first pair of every
    component and merges what it joins."""
    _, label = np.unique(labels, return_inverse=True)
    rank = np.empty(len(a), np.int64)
    rank[np.lexsort((b, a, share))] = np.arange(len(a))
    left, chosen = np.arange(len(a)), []
    while True:
        left = left[label[a[left]] != label[b[left]]]
        if not len(left):
            return np.array(sorted(chosen), np.int64)
        best = np.full(label.max() + 1, len(a), np.int64)
        for side in (a, b):
            np.minimum.at(best, label[side[left]], rank[left])
        by_rank = left[np.isin(rank[left], best)]
        parent = np.arange(len(best))

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for i in by_rank[np.argsort(rank[by_rank])].tolist():
            x, y = top(label[a[i]]), top(label[b[i]])
            if x != y:
                parent[max(x, y)] = min(x, y)
                chosen.append(i)
        label = np.array([top(x) for x in range(len(parent))])[label]


def _open_pairs(members: DataFrame, sets: DataFrame, comp: DataFrame, percent: int, all_pairs: bool, each: int) -> DataFrame:
    """shingle, a, b, cut: pairs of different components in one tile whose sizes and signatures allow a link.

    A tile of more than TILE sets is dealt into blocks, see _size_blocks. Unless all_pairs is set, a block with more pairs than `each` for every set gives each set's closest larger
    partner and the closest pairs that join its components, two pairs a set at most, and marks these rows as cut; all pairs of the other blocks are there."""
    labelled = stored(
        members.select("shingle", "set", "n").distinct()
        .join(comp.hint("shuffle_merge"), "set", "left")
        .withColumn("comp", F.coalesce("comp", "set"))
    )
    by_comp = labelled.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("m"))
    tiles = by_comp.groupBy("shingle").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("m")).filter("m > top.m")
    mixed = stored(tiles.select("shingle", F.when(F.col("m") > TILE, F.col("top.comp")).alias("major"), "m"))
    rows = skew_join(labelled, mixed, ["shingle"], "m")
    # in a tile of one block a set without a neighbour in size within reach has no partner, and its signature stays where it is
    by_size = Window.partitionBy("shingle").orderBy("n", "set")
    near = F.coalesce(percent * F.col("n") <= 100 * F.lag("n").over(by_size), F.lit(False)) | F.coalesce(percent * F.lead("n").over(by_size) <= 100 * F.col("n"), F.lit(False))
    zero = F.lit(0).cast("long")
    dealt = rows.filter("major IS NULL").withColumn("near", near).filter("near").select("shingle", "set", "comp", "n", zero.alias("own"), F.array(zero).alias("others"))
    if not mixed.filter("major IS NOT NULL").isEmpty():
        dealt = dealt.unionByName(_size_blocks(rows.filter("major IS NOT NULL"), percent))
    rows = dealt.join(sets.select("set", "bits").hint("shuffle_merge"), "set").withColumn("other", F.explode("others"))
    rows = rows.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "comp", "n", "bits")

    def compare_few(rows_: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        """The same without arrays, which cost more than they save in a tile of a few sets."""
        same_block, every, closest, shares = rows_[0][1] == rows_[0][2], [], [], []
        by_id = sorted(rows_, key=lambda r: r[4])
        ids, labels = np.array([r[4] for r in by_id], np.int64), np.array([r[5] for r in by_id], np.int64)
        for i, (shingle, _, _, own, one, comp_, n, bits) in enumerate(rows_):
            near = []
            for q in rows_[i + 1 :]:
                if percent * q[6] > 100 * n:
                    break
                if q[5] != comp_ and (same_block or q[3] != own):
                    apart = bits_apart(bits, q[7])
                    if apart * (100 + percent) <= (100 - percent) * (n + q[6]):
                        near.append((apart / (n + q[6]), q[6], q[4]))
            if near:
                every += [(one, x) for *_, x in near]
                closest.append((one, min(near)[2]))
                shares += [(share, one, x) for share, _, x in near]
        cut = len(every) > each * len(rows_) and not all_pairs
        if cut:
            sides = np.array([x[1:] for x in shares], np.int64)
            tree = spanning(*np.searchsorted(ids, sides.T), np.array([x[0] for x in shares]), labels)
            closest = sorted({*closest, *map(tuple, sides[tree].tolist())})
        if every:
            yield rows_[0][0], *np.array(closest if cut else every, np.int64).T, cut

    def compare(rows_: list[tuple]) -> Iterator[tuple[int, np.ndarray, np.ndarray, bool]]:
        shingle, m = rows_[0][0], len(rows_)
        rows_.sort(key=lambda r: (r[6], r[4]))
        if m <= FEW_SETS:
            yield from compare_few(rows_)
            return
        own, one, comp_, n = (np.array([r[c] for r in rows_], np.int64) for c in (3, 4, 5, 6))
        width = np.array([len(r[7]) // 8 for r in rows_])  # grows with n, by a step of two at most within reach
        same_block = rows_[0][1] == rows_[0][2]
        partners = np.maximum(np.searchsorted(n, 100 * n // percent, "right") - np.arange(m) - 1, 0)
        total, every, closest = 0, [], []
        for level in map(int, np.unique(width)):
            r, stop, reach = (int(np.searchsorted(width, w, side)) for w, side in ((level, "left"), (level, "right"), (2 * level, "right")))
            base, bits = r, np.stack([folded(np.frombuffer(x[7], np.uint64), level) for x in rows_[r:reach]])
            while r < stop:
                # as many rows as have PAIR_WORDS words of signatures to compare with
                take = max(1, int(np.searchsorted(np.cumsum(partners[r:stop]) * level, PAIR_WORDS, "right")))
                count = partners[r : r + take]
                a = np.repeat(np.arange(r, r + take), count)
                b = np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count) + a + 1
                r += take
                ok = comp_[a] != comp_[b]
                if not same_block:
                    ok &= own[a] != own[b]
                a, b = a[ok], b[ok]
                apart = np.bitwise_count(bits[a - base] ^ bits[b - base]).sum(axis=1).astype(np.int64)
                near = apart * (100 + percent) <= (100 - percent) * (n[a] + n[b])
                a, b, apart = a[near], b[near], apart[near]
                if not len(a):
                    continue
                total += len(a)
                if all_pairs:
                    yield shingle, one[a], one[b], False
                    continue
                order = np.lexsort((b, apart / (n[a] + n[b]), a))
                first = order[np.r_[True, a[order][1:] != a[order][:-1]]]
                closest.append((a[first], b[first]))
                every.append((a, b, apart / (n[a] + n[b])))
                if total > each * m:  # what a spanning tree of a part leaves out no spanning tree of the whole needs
                    a, b, share = (np.concatenate(c) for c in zip(*every, strict=True))
                    tree = spanning(a, b, share, comp_)
                    every = [(a[tree], b[tree], share[tree])]
        if every:
            a, b, _ = (np.concatenate(c) for c in zip(*every, strict=True))
            if total > each * m:
                a, b = np.unique(np.stack([np.concatenate(c) for c in zip((a, b), *closest, strict=True)]), axis=1)
            yield shingle, one[a], one[b], total > each * m

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and row[:3] != held[0][:3]:
                    yield from map(_pairs, compare(held))
                    held = []
                held.append(row)
        if held:
            yield from map(_pairs, compare(held))

    dealt = rows.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return stored(dealt.mapInArrow(run, "shingle long, a long, b long, cut boolean"))


def _pairs(found: tuple[int, np.ndarray, np.ndarray, bool]) -> pa.RecordBatch:
    shingle, x, y, cut = found
    columns = np.full(len(x), shingle, np.int64), np.minimum(x, y), np.maximum(x, y), np.full(len(x), cut)
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "a", "b", "cut"])


def _placed(docs: DataFrame, k: int, percent: int, id_col: str, text_col: str, digests: bool = False) -> tuple[DataFrame, DataFrame]:
    """row_id, doc_id, n, comp (and digest) of the rows with words, comp being one number a component; all rows' features."""
    spark = docs.sparkSession
    hot = spark.sparkContext.broadcast(frequent_counters(docs, k, text_col))
    rows = stored(features(docs, k, percent, hot, id_col, text_col, digests))
    first = F.min(F.struct("row_id", "doc_id", "n", "bits", "prefix"))
    sets = stored(rows.filter("n > 0").groupBy("d1", "d2").agg(first.alias("f")).select("d1", "d2", F.col("f.row_id").alias("set"), "f.doc_id", "f.n", "f.bits", "f.prefix"))
    heads = sets.select("set", "n", F.explode("prefix").alias("shingle"))
    salts = max(LEAST_SALTS, sets.count() // SALT_SETS)

    def salted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile of a frequent shingle is dealt over several tasks."""
        for batch in batches:
            s, u = batch.column(2).to_numpy().view(np.uint64), batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.where(frequent(s, hot.value), u % salts + 1, 0))], ["set", "n", "shingle", "salt"])

    heads = heads.mapInArrow(salted, "set long, n long, shingle long, salt long")
    part = stored(_stars(heads, ["shingle", "salt"], percent))
    # a salted tile of one is a tile all the same; its rows and the smallest of each band meet once more
    tops = heads.filter("salt > 0").groupBy("shingle", "salt", F.floor(F.log2(F.col("n") + 0.5) * 4)).agg(F.min(F.struct("n", "set")).alias("f"))
    over = stored(_stars(tops.select("shingle", F.lit(0).cast("long").alias("salt"), "f.set", "f.n"), ["shingle"], percent))
    members = part.select("shingle", "set", "n", "rep").unionByName(over.select("shingle", "set", "n", "rep"))
    stars = stored(members.filter("set <> rep").select(F.least("set", "rep").alias("a"), F.greatest("set", "rep").alias("b")).distinct())
    comp = components(_verified(stars, sets, docs, k, percent, id_col, text_col))
    cut, merged, each = True, True, 1
    while cut:
        found = _open_pairs(members, sets, comp, percent, all_pairs=not merged or each >= TILE, each=each)
        cut, each = not found.filter("cut").isEmpty(), each * PAIRS_GROW
        more = _verified(stored(found.select("a", "b").distinct()), sets, docs, k, percent, id_col, text_col, screened=True)
        merged = not more.isEmpty()
        if cut:  # the pairs of all other tiles have been tried
            again = found.filter("cut").select("shingle").distinct()
            members = stored(members.select("shingle", "set", "n").join(again.hint("shuffle_merge"), "shingle"))
        if merged:
            known = comp.filter("set <> comp").select(F.col("set").alias("a"), F.col("comp").alias("b"))
            comp = components(known.unionByName(more))
    of_set = sets.select("d1", "d2", "set").join(comp.hint("shuffle_merge"), "set", "left").select("d1", "d2", F.coalesce("comp", "set").alias("comp"))
    digest = ["digest"] * digests
    placed = rows.filter("n > 0").select("row_id", "doc_id", "n", "d1", "d2", *digest).join(of_set.hint("shuffle_merge"), ["d1", "d2"])
    return stored(placed.select("row_id", "doc_id", "n", "comp", *digest)), rows


def near_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: row_id, doc_id, n_shingles, component_id (the smallest doc_id reachable).

    Two rows link when 100 * intersection >= percent * union. Null and empty texts have no shingles and link
    with nothing; ids are whole numbers, and a null id never names a component that has another id. Very long texts count whole. Repeated rows give rows each and
    link; an empty table gives no rows; other columns are not read."""
    placed, rows = _placed(docs, k, percent, id_col, text_col)
    names = placed.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    named = placed.join(names.hint("shuffle_merge"), "comp").select("row_id", "doc_id", F.col("n").alias("n_shingles"), "component_id")
    empty = rows.filter("n = 0").select("row_id", "doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return named.unionByName(empty)


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all columns, of each component: the one of smallest id, then smallest SHA-256 of its text; a null id counts as
    the largest. Of rows that repeat id and text one stays. Rows without words stay."""
    name, sha = free_name(docs, "_key"), free_name(docs, "_sha")
    placed, _ = _placed(docs, k, percent, id_col, text_col, digests=True)
    groups = stored(placed.groupBy("comp", "doc_id", "digest").agg(F.count(F.lit(1)).alias("copies")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    firsts = groups.groupBy("comp").agg(first.alias("first"))
    kept = (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))).alias("kept")
    judged = groups.join(firsts.hint("shuffle_merge"), "comp").select(row_key("doc_id").alias(name), F.col("digest").alias(sha), kept, "copies")
    judged = stored(judged.filter("NOT kept OR copies > 1").drop("copies"))
    return without_rows(docs.withColumns({name: row_key(id_col), sha: F.sha2(text_bytes(text_col), 256)}), judged, name, sha)


def op10_ngram_join(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return near_components(read(spark, sf_dir, "documents")).drop("row_id")
