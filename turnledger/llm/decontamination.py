"""Benchmark decontamination as a prefix-filtered set join.

Every benchmark item is cut into windows of ten words (a shorter item is one window). The tokens of the join
are word pairs, ordered by how many documents hold them. A document can only hold a window if it holds the
window's rarest pair, so that pair is the whole necessary prefix; its place in the document fixes where the
window would start, the length and positional bounds drop starts outside the text, and what is left is
verified word by word.

The windows are dealt into blocks of a fixed size. One block at a time is broadcast, looked for and let go of; of each
block only the documents that hold one of its windows are written, so memory does not grow with the benchmark.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, stored, text_bytes, words
from .exact_dedup import filter_bits, probe, seen_filter

WINDOW = 10
#: Windows that one pass over the documents looks for (some 40 MB in a worker).
BLOCK_WINDOWS = 200_000


def pairs(text: list[bytes]) -> list[tuple[bytes, ...]]:
    """The tokens of a window: its word pairs, or the only word."""
    return list(zip(text, text[1:], strict=False)) or [tuple(text)]


def benchmark_windows(items: DataFrame, window: int = WINDOW, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct (item, words): words joined by a space. Items without words or without an id have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                w = words(text)
                found = sorted({b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}) if w else []
                for k in range(0, len(found), 10_000):
                    part = found[k : k + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.array(part, pa.binary())], ["item", "words"])

    items = items.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string").alias("item"), text_bytes(text_col).alias("words"))
    return items.mapInArrow(run, "item string, words binary").distinct()


def pair_frequencies(docs: DataFrame, wanted: set[tuple[bytes, ...]], text_col: str = "text") -> Counter:
    """Over all documents: how many hold each wanted pair. One number a wanted pair reaches the driver; texts go to Python in small batches."""
    order = sorted(wanted)
    held = docs.sparkSession.sparkContext.broadcast({p: i for i, p in enumerate(order)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, single, total = held.value, any(len(p) == 1 for p in held.value), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                w = words(text)
                total.update(index.keys() & set(zip(w, w[1:], strict=False)))
                if single:
                    total.update(index.keys() & {(x,) for x in w})
        if total:
            yield pa.RecordBatch.from_arrays([pa.array([index[p] for p in total], pa.int64()), pa.array(list(total.values()), pa.int64())], ["pair", "docs"])

    counts = docs.select(text_bytes(text_col).alias("text")).mapInArrow(run, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    with small_batches(docs.sparkSession):
        return Counter({order[r["pair"]]: r["docs"] for r in counts.collect()})


class Windows:
    """The windows of one block by their rarest pair."""

    def __init__(self, rows: list[tuple[str, bytes]], frequency: Counter):
        by_words: dict[bytes, list[str]] = {}
        for item, text in rows:
            by_words.setdefault(text, []).append(item)
        self.by_pair: dict[tuple[bytes, ...], list[tuple[int, list[bytes], list[str]]]] = {}
        for text, items in sorted(by_words.items()):
            w = text.split(b" ")
            tokens = pairs(w)
            at = min(range(len(tokens)), key=lambda i: (frequency[tokens[i]], tokens[i], i))
            self.by_pair.setdefault(tokens[at], []).append((at, w, sorted(items)))
        self.single = any(len(p) == 1 for p in self.by_pair)

    def places(self, text: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """(start, end, items) of every occurrence."""
        found, n, known = [], len(text), self.by_pair
        spots = [(i, p) for i, p in enumerate(zip(text, text[1:], strict=False)) if p in known]
        if self.single:
            spots += [(i, (w,)) for i, w in enumerate(text) if (w,) in known]
        for i, p in spots:
            for offset, w, items in known[p]:
                start = i - offset
                if start >= 0 and start + len(w) <= n and text[start : start + len(w)] == w:
                    found.append((start, start + len(w), items))
        return found


def _blocks(docs: DataFrame, items: DataFrame, window: int, text_col: str) -> Iterator:
    """A broadcast Windows for each block, one after the other: ask for the next when this one has been used. Every block holds
    at least one window."""
    spark = docs.sparkSession
    table = stored(benchmark_windows(items, window).withColumn("block", F.xxhash64("words")))
    n = max(1, -(-table.count() // BLOCK_WINDOWS))
    for k in range(n):
        rows = [(r["item"], bytes(r["words"])) for r in table.filter(F.pmod("block", F.lit(n)) == k).collect()]
        if rows:
            wanted = {p for _, text in rows for p in pairs(text.split(b" "))}
            yield n, spark.sparkContext.broadcast(Windows(rows, pair_frequencies(docs, wanted, text_col)))


_SPANS = "starts array<long>, ends array<long>, items array<string>"
_REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _reported(n_words: int, found: list[tuple[int, int, list[str]]]) -> tuple:
    """n_words, n_hit, n_items, items_sha256, contaminated."""
    hit = upto = 0
    for a, b in sorted((a, b) for a, b, _ in found):
        hit += max(0, b - max(a, upto))
        upto = max(upto, b)
    items = sorted({x for _, _, names in found for x in names})
    return n_words, hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), hit > 0


def _report(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column(1):
                w = words(t.as_py())
                rows.append(_reported(len(w), held.value.places(w) if held else []))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *batch.columns[2:]], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", *batch.schema.names[2:]])

    return run


def _found(held):
    """key, starts, ends, items of the rows (key, text) that hold a window of the block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for key, t in zip(batch.column(0), batch.column(1), strict=True):
                found = held.value.places(words(t.as_py()))
                if found:
                    row = key.as_py(), [a for a, _, _ in found], [b for _, b, _ in found], sorted({x for _, _, names in found for x in names})
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            kinds = (pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, kinds, strict=True)], ["key", "starts", "ends", "items"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The report of each text from what all blocks found in it."""
    for batch in batches:
        rows = []
        for key, starts, ends, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans = [(a, b, []) for part in zip(starts, ends, strict=True) for a, b in zip(*part, strict=True)]
            rows.append((key, *_reported(0, [*spans, (0, 0, [x for part in items for x in part])])[1:]))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["key", "n_hit", "n_items", "items_sha256", "contaminated"])


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; an empty table gives no rows. Repeated
    rows give rows each, ids are whole numbers or null. Items that repeat an id count once; items with a null id are left out. Texts are never
    shuffled, however long; other columns are not read. With more windows than one block has, what each block finds is
    written under the text's digest, and the reports meet their rows by it."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("text"))
    schema = f"doc_id long, {_REPORT}"
    keyed, parts = rows.select(F.sha2("text", 256).alias("key"), "text"), []
    for n, block in _blocks(docs, items, window, text_col):
        if n == 1:
            return rows.mapInArrow(_report(block), schema)
        parts.append(stored(keyed.mapInArrow(_found(block), f"key string, {_SPANS}")))
        block.destroy()
    if not parts:
        return rows.mapInArrow(_report(None), schema)
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    one = found.dropDuplicates(["key", "items", "starts", "ends"])  # equal texts are found alike
    each = one.groupBy("key").agg(F.collect_list("starts").alias("starts"), F.collect_list("ends").alias("ends"), F.collect_list("items").alias("items"))
    report = stored(each.mapInArrow(_merged, "key string, n_hit long, n_items long, items_sha256 string, contaminated boolean"))
    plain = stored(rows.withColumn("key", F.sha2("text", 256)).mapInArrow(_report(None), f"{schema}, key string").withColumn("h", F.xxhash64("key")))
    found_columns = ("n_hit", "n_items", "items_sha256")
    # rows without a find pass a Bloom filter by; only the others meet the reports
    held = seen_filter(report.select(F.xxhash64("key").alias("h")), filter_bits(report.count()))
    flagged = probe(plain, "h", held)
    met = flagged.filter("maybe").drop("contaminated").join(report.select("key", *(F.col(c).alias(f"r_{c}") for c in found_columns)).hint("shuffle_merge"), "key", "left").select("doc_id", "n_words", *(F.coalesce(f"r_{c}", c).alias(c) for c in found_columns))
    return met.unionByName(flagged.filter("NOT maybe").select(*met.columns)).withColumn("contaminated", F.col("n_hit") > 0)


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW, text_col: str = "text") -> DataFrame:
    """The rows, all columns, whose text holds no window of the benchmark; repeated rows stay repeated. Null and empty texts
    stay. With more windows than one block has, each block's survivors are written before the next block. Only texts go to Python, and
    only one boolean a row comes back."""

    def clean(held):
        def judge(texts: pa.Array) -> pa.Array:
            return pa.array([not held.value.places(words(t.as_py())) for t in texts], pa.bool_())

        return F.arrow_udf(judge, "boolean")(text_bytes(text_col))

    rows = docs
    for n, block in _blocks(docs, items, window, text_col):
        left = rows.filter(clean(block))
        if n == 1:
            return left
        rows = stored(left)
        block.destroy()
    return rows


def op3_decontamination(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WINDOW - 1}, 1) + 1)) AS i) WHERE len(w) > 0
),
place AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM d, (SELECT DISTINCT n FROM win) AS sizes, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
),
hit AS (SELECT r, i, p.n, item FROM place p JOIN win USING (n, s)),
covered AS (SELECT r, count(DISTINCT k) AS n_hit FROM hit, LATERAL (SELECT unnest(range(i, i + n)) AS k) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS sha FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""
