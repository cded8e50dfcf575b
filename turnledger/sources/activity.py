"""Whether a transcript ends within a turn: the last record that decides says so, and the last stamped record says when.

Silence is not an ending: a turn that waits for a tool writes nothing. What decides differs by dialect."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .contents import field, kind_of, string_at, trimmed, with_contents

# What a user's record says after which no turn of the model comes, and the marks of a turn in dialect B.
CLOSING = r"^\s*(\[Request interrupted by user|<local-command-std(out|err)>)"
OPENS, CLOSES = ("task_started",), ("task_complete", "turn_aborted")


def _busy_a() -> Column:
    """A tool that is asked for, or a prompt or result that is not answered, leaves the turn running. Null where a record decides nothing."""
    message, kind = field(F.col("v"), "message"), string_at(F.col("v"), "type")
    side = F.coalesce(F.try_variant_get("v", "$.isSidechain", "boolean"), F.lit(False))
    content = field(message, "content")
    blocks = F.coalesce(F.when(kind_of(content) == "ARRAY", F.try_variant_get(content, "$", "array<variant>")), F.array().cast("array<variant>"))
    asks = F.coalesce(string_at(message, "stop_reason") == "tool_use", F.lit(False)) | F.exists(blocks, lambda b: F.coalesce(string_at(b, "type") == "tool_use", F.lit(False)))
    words = F.when(kind_of(content) == "STRING", F.try_variant_get(content, "$", "string")).otherwise(F.array_join(F.transform(blocks, lambda b: F.coalesce(string_at(b, "text"), F.lit(""))), ""))
    busy = F.when(kind == "assistant", asks).when(kind == "user", ~F.coalesce(words, F.lit("")).rlike(CLOSING))
    return F.when(~side & (kind_of(message) == "OBJECT"), busy)


def _busy_b() -> Column:
    """What opens and closes a task decides, whichever comes last."""
    kind = string_at(field(F.col("v"), "payload"), "type")
    return F.when((string_at(F.col("v"), "type") == "event_msg") & kind.isin(*OPENS, *CLOSES), kind.isin(*OPENS))


def marks(records: DataFrame, dialect: str) -> DataFrame:
    """path, line_ord, at, busy of each record of dialects A and B, null where it is not stamped or decides nothing: what a stream keeps state of."""
    return records.select("path", "line_ord", _stamp(dialect).alias("at"), {"claude": _busy_a, "codex": _busy_b}[dialect]().alias("busy"))


def _decided(busy: Callable[[], Column]):
    return lambda records: records.select("path", F.struct("line_ord", F.lit(0).alias("pos")).alias("place"), busy().alias("busy")).filter("busy IS NOT NULL")


def _c(records: DataFrame) -> DataFrame:
    """A user's message, or one of the model with tool calls or without words, leaves the turn running; the model's last words and errors end it."""
    held = F.try_variant_get("v", "$['$set'].messages", "array<variant>")
    messages = F.coalesce(held, F.array("v"))
    rows = records.select("path", "line_ord", F.posexplode(messages).alias("pos", "m")).withColumn("type", string_at(F.col("m"), "type")).filter("type IN ('user', 'gemini', 'error')")
    place = F.struct("line_ord", "pos")
    last = rows.groupBy("path").agg(F.max(place).alias("place"))  # one message a file is looked into
    rows = rows.select("path", place.alias("place"), "type", "m").join(last.hint("shuffle_merge"), ["path", "place"])
    calls = field(F.col("m"), "toolCalls")
    rows = rows.select("path", "place", "type", (F.coalesce(kind_of(calls), F.lit("")) == "ARRAY").alias("listed"), F.size(F.try_variant_get(calls, "$", "array<variant>")).alias("calls"), field(F.col("m"), "content").alias("content"))
    rows = with_contents(rows)
    waits = (F.col("listed") & (F.col("calls") > 0)) | (F.col("text") == "")
    return rows.select("path", "place", F.when(F.col("type") == "user", True).when(F.col("type") == "gemini", waits).otherwise(False).alias("busy"))


_RULES = {"claude": _decided(_busy_a), "codex": _decided(_busy_b), "gemini": _c}


def _stamp(dialect: str) -> Column:
    stamps = [string_at(F.col("v"), "timestamp")]
    if dialect == "gemini":
        stamps += [F.try_variant_get("v", "$['$set'].lastUpdated", "string"), string_at(F.col("v"), "lastUpdated")]
    return F.try_to_timestamp(trimmed(F.coalesce(*stamps)))


def activity(records: DataFrame, dialect: str) -> DataFrame:
    """records: path, line_ord, v. path, at and busy of each file. A file without a stamped record, or whose last deciding record comes after all stamped ones, has
    no row; one without a deciding record is not busy."""
    stamped = records.select("path", "line_ord", _stamp(dialect).alias("at")).filter("at IS NOT NULL").groupBy("path").agg(F.max("line_ord").alias("stamped"), F.max_by("at", "line_ord").alias("at"))
    decided = _RULES[dialect](records).groupBy("path").agg(F.max_by("busy", "place").alias("busy"), F.max("place.line_ord").alias("decided"))
    j = stamped.join(decided.hint("shuffle_merge"), "path", "left").filter("decided IS NULL OR stamped >= decided")
    return j.select("path", "at", F.coalesce("busy", F.lit(False)).alias("busy"))
