"""Late notes as a stream: each batch replays the subjects that it touches and lays the replay onto the table.

Claims and facts lie in folders by bucket of their subject. A batch overwrites the buckets that it touches, from frames that were written elsewhere first, and
leaves the files of all others alone. Facts go before claims: a batch that was cut short between the two finds the same subjects when it comes again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decide
from ..sources.scratch import written

BUCKETS = 64
CLAIMS = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double, live boolean"
FACTS = "subject string, seq long, key string, subject_kind string, claim string, confidence double, session_id string, created_at string, superseded_by long, superseded_at string, retracted_at string"
_GONE = "session_id string, date string, ord long, subject string, subject_kind string, key string, claim string, confidence double, created_at string, retracted_at string, reason string"


def bucket() -> Column:
    return F.pmod(F.xxhash64(F.trim("subject")), F.lit(BUCKETS)).cast("int").alias("bucket")


def create(spark: SparkSession, root: str) -> None:
    """Empty tables under the folder."""
    for name, schema in (("claims", CLAIMS), ("facts", FACTS)):
        spark.createDataFrame([], schema + ", bucket int").write.partitionBy("bucket").parquet(f"{root}/{name}")


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """claims or facts, with the bucket that their files lie in."""
    return spark.read.schema({"claims": CLAIMS, "facts": FACTS}[name] + ", bucket int").parquet(f"{root}/{name}")


def _replace(rows: DataFrame, root: str, name: str) -> None:
    """Overwrites the buckets that the rows lie in, and no others."""
    ready = written(rows.withColumn("bucket", bucket()))
    ready.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{root}/{name}")


def take_batch(spark: SparkSession, root: str, claims: DataFrame, at: str) -> None:
    """claims: the whole notes of some sessions (see operators.decide). They take the place of what these sessions claimed before, whose rows stay with live = false; the subjects of both
    are replayed. What a repeated batch says is there already, so it changes nothing. At most BUCKETS numbers reach the driver."""
    base = list(decide.CLAIM)
    row = F.sha2(F.to_json(F.struct(*base), {"ignoreNullFields": "false"}), 256)
    batch = written(claims.select(*base).distinct().withColumns({"live": F.lit(True), "_row": row}))
    sessions = batch.select("session_id").distinct()
    old = table(spark, root, "claims").withColumn("_row", row)
    mine = old.join(sessions.hint("shuffle_merge"), "session_id", "left_semi")
    stale = mine.filter("live").join(batch.select("_row").hint("shuffle_merge"), "_row", "left_anti")
    touched = written(batch.select("subject").unionByName(stale.select("subject")).distinct())
    which = [r["bucket"] for r in touched.select(bucket()).distinct().collect()]
    if not which:
        return
    part = old.filter(F.col("bucket").isin(which))
    others = part.join(sessions.hint("shuffle_merge"), "session_id", "left_anti")
    before = part.join(sessions.hint("shuffle_merge"), "session_id", "left_semi").join(batch.select("_row").hint("shuffle_merge"), "_row", "left_anti").withColumn("live", F.lit(False))
    now = written(others.select(*base, "live").unionByName(before.select(*base, "live").distinct()).unionByName(batch.select(*base, "live")))
    notes = decide.Notes(now.filter("live").select(*base), spark.createDataFrame([], _GONE))
    held = table(spark, root, "facts").filter(F.col("bucket").isin(which)).drop("bucket")
    _replace(decide.rebase(held, notes, touched, at), root, "facts")
    _replace(now, root, "claims")


def start_memory(stream: DataFrame, root: str, checkpoint: str, at: Callable[[int], str], interval: str | None = None):
    """Starts the stream of notes; `at` gives a batch's date by its number. Without an interval it takes what is there and stops."""
    writer = stream.writeStream.foreachBatch(lambda claims, number: take_batch(claims.sparkSession, root, claims, at(number))).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()
