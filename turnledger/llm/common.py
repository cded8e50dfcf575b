"""Pieces that several operators share: scratch tables, row ids, byte-level words."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Separators become spaces and A-Z become a-z; digits, a-z and every byte from 0x80 up stay.
WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Maximal runs of digits, ASCII letters (lower-cased) and non-ASCII characters; null has none."""
    return text.translate(WORD_BYTES).split() if text else []


def spaced_words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased runs between ASCII white space; null has none."""
    return text.lower().split() if text else []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path under the folder that driver and executors share (spark.checkpoint.dir).

    Where the setting is absent a temporary folder of this machine serves in local mode; a cluster needs the setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("turnledger.scratch", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="turnledger-")
        spark.conf.set("turnledger.scratch", base)
    return f"{base.rstrip('/')}/turnledger/{uuid.uuid4().hex}"


#: Rows and bytes of an Arrow batch where rows hold whole texts or long arrays. The session's own bound of bytes (64 MiB unless set
#: otherwise) holds where an operator hands out a lazy frame.
BATCH_ROWS, BATCH_BYTES = 1_000, 16 << 20
_ROWS, _BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = BATCH_ROWS):
    """No Arrow batch that is made inside has more rows or bytes: a worker's memory follows the batch. The session's settings come back afterwards."""
    old = {k: spark.conf.get(k) for k in (_ROWS, _BYTES)}
    spark.conf.set(_ROWS, min(rows, int(old[_ROWS])))
    spark.conf.set(_BYTES, BATCH_BYTES)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write the rows to the shared scratch folder and read them back: lineage ends here, the files
    outlive a lost executor, and the size that the planner sees is real."""
    path = scratch_dir(df.sparkSession)
    with small_batches(df.sparkSession):
        df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds a 64-bit id that is unique within one evaluation; store the result before using the id twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


#: A key of more rows than both of these is hot.
HOT_ROWS, HOT_SHARE = 1_000, 0.002


def skew_join(left: DataFrame, right: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """left.join(right, keys) where a few keys may fill much of left. right is stored and has one row a key; its column `weight`, which
    is dropped, tells how many rows of left have the key. Rows of hot keys meet a broadcast of at most 1 / HOT_SHARE rows and
    stay where they are."""
    n = left.count()
    few = right.filter(F.col(weight) >= max(HOT_ROWS, int(HOT_SHARE * n)))
    right = right.drop(weight)
    if n < HOT_ROWS or few.isEmpty():
        return left.join(right.hint("shuffle_merge"), keys)
    few = F.broadcast(few.drop(weight))
    return left.join(few, keys).unionByName(left.join(few.select(*keys), keys, "left_anti").join(right.hint("shuffle_merge"), keys))


def free_name(df: DataFrame, name: str) -> str:
    """The name, lengthened until no column of the frame has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_bytes(col: str = "text"):
    """The UTF-8 bytes of a text column, null kept."""
    return F.col(col).cast("string").cast("binary")
