"""Reproducible shuffle into shards by a Feistel permutation with cycle walking over global row numbers.

Rows are numbered 0..N-1 in the order (id, digests); a keyed Feistel network over the smallest power of two
that holds N permutes the numbers, walking on while it leaves the range. Row i then has position p(i):
shard = p mod shards, slot = p div shards. Shard and slot of any row number can be computed without the
table, row counts differ by at most one, and slots have no gaps. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Round keys of the permutation; another list is another shuffle.
KEYS = (0x51ED270B, 0x2545F491, 0x9E3779B9, 0x7F4A7C15)
#: Steps of cycle walking in one expression. A step leaves the range with a chance below 1/2; rows that
#: are still outside after all steps take another round.
STEPS = 40


def network_bits(n: int) -> tuple[int, int]:
    """Bits of the left and the right half."""
    m = max(2, (max(1, n) - 1).bit_length())
    return m // 2, m - m // 2


def permute(number: Column, n: int, keys: tuple[int, ...] = KEYS, steps: int = STEPS) -> Column:
    """Walks at most `steps` passes; the result may still be n or more (see walked)."""
    assert len(keys) % 2 == 0
    a, b = network_bits(n)

    def one(x: Column, key_index: Column) -> Column:
        return F.when((x < n) & (key_index > 0), x).otherwise(_nested(x, a, b, keys))

    return F.aggregate(F.sequence(F.lit(0), F.lit(steps - 1)), number.cast("long"), one)


def _nested(x: Column, a: int, b: int, keys: tuple[int, ...]) -> Column:
    """The rounds as a fold over an array of (key, low bits, high bits): each round's input is bound once."""
    rounds = F.array(*[F.struct(F.lit(k).cast("long").alias("k"), F.lit(a if i % 2 == 0 else b).alias("a"), F.lit(b if i % 2 == 0 else a).alias("b")) for i, k in enumerate(keys)])
    one = F.lit(1).cast("long")

    def turn(x: Column, r: Column) -> Column:
        low = x.bitwiseAND(F.call_function("shiftleft", one, r["b"]) - 1)
        high = F.call_function("shiftright", x, r["b"])
        # below 2**31 * 2**31, so the product never overflows for up to 2**60 rows
        mixed = F.shiftright(((low + r["k"]).bitwiseAND(F.lit(0x7FFFFFFF).cast("long"))) * F.lit(0x4F6CDD1D).cast("long"), 11).bitwiseXOR(F.shiftright(low, 5))
        return F.call_function("shiftleft", low, r["a"]).bitwiseOR(high.bitwiseXOR(mixed).bitwiseAND(F.call_function("shiftleft", one, r["a"]) - 1))

    return F.aggregate(rounds, x, turn)


def permute_int(number: int, n: int, keys: tuple[int, ...] = KEYS) -> int:
    """The same permutation for one row number: where does row i go?"""
    x, (a, b) = number, network_bits(n)
    while True:
        for key in keys:
            low, high = x & ((1 << b) - 1), x >> b
            mixed = (((low + key) & 0x7FFFFFFF) * 0x4F6CDD1D >> 11) ^ (low >> 5)
            x, a, b = (low << a) | ((high ^ mixed) & ((1 << a) - 1)), b, a
        if x < n:
            return x


def numbered(rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds row_number 0..N-1 in the given order, and tells N. One range shuffle of narrow rows; the offsets
    of its partitions (one number each) are all that reaches the driver."""
    spot = F.monotonically_increasing_id()  # parts equal rows, so that no range grows hot
    ranged = stored(rows.withColumn("_tie", spot).repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie").withColumn("_at", spot))
    ranged = ranged.withColumns({"_part": F.shiftrightunsigned("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    offsets, n = [], 0
    for part, count in sorted(ranged.groupBy("_part").count().collect()):
        offsets.append((part, n))
        n += count
    table = rows.sparkSession.createDataFrame(offsets, "_part long, _from long")
    return ranged.join(F.broadcast(table), "_part").withColumn("row_number", F.col("_in") + F.col("_from")).drop("_part", "_in", "_from", "_at"), n


def sharded(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, row_number, law, shard, slot, grown_shard.

    Null text has no bytes (size 1, crc of nothing) and sorts by its digests like any other; repeated ids and
    equal rows get numbers of their own. An empty table gives no rows. Other columns are not carried. Very long texts are measured where they lie
    and never shuffled."""
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    narrow = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(raw) + 1).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.xxhash64(raw).alias("_digest"),
    )
    rows, n = numbered(narrow, ["doc_id", "text_crc32", "_digest", "size"])
    placed = rows.drop("_digest").withColumn("_p", permute(F.col("row_number"), n))
    while not placed.filter(F.col("_p") >= n).isEmpty():
        placed = placed.withColumn("_p", F.when(F.col("_p") < n, F.col("_p")).otherwise(permute(F.col("_p"), n)))
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number", F.lit("rows").alias("law"),
        (F.col("_p") % shards).cast("int").alias("shard"), F.expr(f"_p div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_feistel_shards(spark, sf_dir: str) -> DataFrame:
    from .common import read

    return sharded(read(spark, sf_dir, "documents"))
