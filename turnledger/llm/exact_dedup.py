"""Exact duplicates by two passes over a Bloom filter.

Pass 1 sets, for every text hash, its bits in a "seen" filter; a hash whose bits were all set already
goes to the "again" filter. Pass 2 probes "again": only rows that it holds are shuffled and grouped by
their full digest, all others pass straight through as groups of one. A false positive costs a shuffled
row and nothing else, so results are exact for any filter size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, stored, with_row_id

#: Bits per slice: the unit in which tasks hand over their filters.
SLICE_BITS = 1 << 19
#: The most bits of a filter: 2**28 bits are 32 MiB. Beyond some 30 million rows more unique rows
#: shuffle, which ends at the cost of a plain groupBy.
MAX_BITS = 1 << 28
PROBES = 3
#: Groups above both of these get their key salted when they meet their totals.
HOT_ROWS, HOT_SHARE = 10_000, 0.002
SALTS = 64


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """A power of two, about 16 bits a row, between one slice and max_bits."""
    return max(SLICE_BITS, min(max_bits, 1 << max(1, 16 * rows - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """PROBES bit positions for each 64-bit hash, by double hashing."""
    h = hashes.view(np.uint64)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(17)) | np.uint64(1)
    return np.stack([(h + np.uint64(i) * step) & np.uint64(bits - 1) for i in range(PROBES)])


def _holds(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=0)


def _set(bitmap: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(bitmap, (at >> np.uint64(3)).ravel(), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8).ravel())


def _partial(bits: int):
    """One task's pair of filters, cut into slices; slices without a bit are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, again = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
        some = False
        for batch in batches:
            if not batch.num_rows:
                continue
            some = True
            hashes, counts = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64), return_counts=True)
            at = positions(hashes, bits)
            _set(again, at[:, (counts > 1) | _holds(seen, at)])
            _set(seen, at)
        if not some:
            return
        size = SLICE_BITS // 8
        for k in range(bits // SLICE_BITS):
            a, b = seen[k * size : (k + 1) * size], again[k * size : (k + 1) * size]
            if a.any():
                yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "seen": [a.tobytes()], "again": [b.tobytes()]})

    return run


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joins the pairs of each slice: again = both again, or in both seen. Holds one pair a slice."""
    held: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            if k in held:
                seen, again = held[k]
                again |= b | (seen & a)
                seen |= a
            else:
                held[k] = [a.copy(), b.copy()]
    for k, (a, b) in held.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int64()), "seen": [a.tobytes()], "again": [b.tobytes()]})


_SLICES = "slice long, seen binary, again binary"


def _filter(hashes: DataFrame, bits: int, which: str) -> np.ndarray:
    """At most bits / 8 bytes on the driver."""
    parts = hashes.mapInArrow(_partial(bits), _SLICES).repartition(min(64, max(1, bits // SLICE_BITS)), "slice")
    out = np.zeros(bits // 8, np.uint8)
    size = SLICE_BITS // 8
    for row in parts.mapInArrow(_fold, _SLICES).select("slice", which).collect():
        out[row["slice"] * size : (row["slice"] + 1) * size] = np.frombuffer(row[which], np.uint8)
    return out


def seen_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The Bloom filter of a one-column frame of longs."""
    return _filter(hashes, bits, "seen")


def repeated_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter of those longs that come more than once. Bits shared between different hashes may mark
    one that does not; one that does is always marked, as each of its bits was set twice."""
    return _filter(hashes, bits, "again")


def holds(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """May each 64-bit hash be in the filter?"""
    return _holds(bitmap, positions(hashes, len(bitmap) * 8))


def probe(df: DataFrame, hash_col: str, bitmap: np.ndarray, flag: str = "maybe") -> DataFrame:
    """Adds a boolean column: may the hash be in the filter? Null hashes are not. Only the hashes go to Python."""
    held = df.sparkSession.sparkContext.broadcast(bitmap)

    def check(hashes: pa.Array) -> pa.Array:
        found = holds(held.value, hashes.fill_null(0).to_numpy(zero_copy_only=False)) if len(hashes) else np.zeros(0, bool)
        return pa.array(found, pa.bool_())

    return df.withColumn(flag, F.arrow_udf(check, "boolean")(hash_col))


def normal_text(text_col: str) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text_col).cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """One row per input row: its id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes one space; null counts as
    empty. The row with the smallest id stays; of rows that repeat an id, one stays; a null id counts as
    the largest. Other columns are not carried. An empty table gives no rows. Very long texts are hashed where
    they lie and never shuffled."""
    rows = stored(with_row_id(docs.select(F.col(id_col).alias("doc_id"), F.sha2(normal_text(text_col).cast("binary"), 256).alias("text_sha256"))))
    rows = rows.withColumn("h", F.conv(F.substring("text_sha256", 1, 15), 16, 10).cast("long"))
    n = rows.count()
    again = repeated_filter(rows.select("h"), filter_bits(n, max_bits))
    flagged = probe(rows, "h", again).drop("h")
    alone = flagged.filter(~F.col("maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    maybe = stored(flagged.filter("maybe").drop("maybe"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_id"))
    totals = stored(maybe.groupBy("text_sha256").agg(first.alias("first"), F.count(F.lit(1)).alias("group_size")))
    hot_from = max(HOT_ROWS, int(HOT_SHARE * n))
    hot = F.broadcast(totals.filter(F.col("group_size") >= hot_from))  # at most 1 / HOT_SHARE groups
    meet = maybe.join(hot, "text_sha256").unionByName(
        maybe.join(hot.select("text_sha256"), "text_sha256", "left_anti").join(totals.filter(F.col("group_size") < hot_from).hint("merge"), "text_sha256")
    )
    grouped = meet.select("doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256")
    return alone.unionByName(grouped)


def row_key(id_col: str) -> Column:
    """The id as a string that tells null from every id."""
    return F.coalesce(F.concat(F.lit("v"), F.col(id_col).cast("string")), F.lit("n"))


def without_rows(docs: DataFrame, judged: DataFrame, key: str, sha: str) -> DataFrame:
    """The rows, all columns but key and sha, less those judged. judged: key, sha, kept, one row each, for every (key, sha) that
    goes (kept false) or of which one of several rows stays (kept true). A Bloom filter over it lets all other rows
    pass straight through; only what it holds is shuffled."""
    n = judged.count()
    if not n:
        return docs.drop(key, sha)
    h, maybe, kept = free_name(docs, "_h"), free_name(docs, "_maybe"), free_name(docs, "_kept")
    docs = docs.withColumn(sha, F.coalesce(sha, F.lit("")))  # never null: else the inner join has each text digested once more to test that
    hashed = F.xxhash64(key, sha)
    bitmap = seen_filter(judged.select(hashed.alias(h)), filter_bits(n))
    flagged = probe(docs.withColumn(h, hashed), h, bitmap, maybe)
    met = flagged.filter(maybe).join(judged.select(key, sha, F.col("kept").alias(kept)).hint("shuffle_merge"), [key, sha], "left")
    one = met.filter(F.col(kept)).dropDuplicates([key, sha])
    every = flagged.filter(~F.col(maybe)).unionByName(met.filter(F.col(kept).isNull()).unionByName(one).drop(kept))
    return every.select(*(c for c in docs.columns if c not in (key, sha)))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input rows, all columns, without later copies of a text.

    What goes is told by id and digest of the normalised text; null ids count as one id, the largest. Of rows that repeat both one
    stays. An empty table stays empty. Rows that no copy has are not shuffled."""
    k, sha = free_name(docs, "_key"), free_name(docs, "_sha")
    groups = stored(exact_groups(docs, id_col, text_col).filter("group_size > 1").withColumnRenamed("doc_id", id_col).select(row_key(id_col).alias(k), "kept", F.col("text_sha256").alias(sha)))
    judged = stored(groups.groupBy(k, sha).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).filter("NOT kept OR copies > 1").drop("copies"))
    return without_rows(docs.withColumns({k: row_key(id_col), sha: F.sha2(normal_text(text_col).cast("binary"), 256)}), judged, k, sha)


def op9_exact_dedup(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return exact_groups(read(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH t AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY 1)
SELECT t.doc_id, g.keep_id, CAST(g.group_size AS BIGINT) AS group_size, t.doc_id = g.keep_id AS kept, t.text_sha256
FROM t JOIN g USING (text_sha256)
"""
