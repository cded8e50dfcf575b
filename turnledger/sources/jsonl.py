"""Transcript files: discovery, tolerant JSON lines, and three record dialects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .contents import CALLS, SHELL, field, string_at, with_contents

# Where each dialect keeps its sessions, and what opens a turn that is not the user's own.
PATHS = {
    "claude": r"(^|/)(?!agent-)[^/]+\.jsonl$",
    "codex": r"(^|/)rollout-[^/]*\.jsonl$",
    "gemini": r"/chats/session-[^/]*\.jsonl$",
}
PREAMBLES = {"codex": r"^<(user_instructions|environment_context|turn_aborted)", "gemini": r"^(<(session_context|environment_context)|\[System:)"}
PLAN_BANNER = r"^PLEASE IMPLEMENT THIS PLAN:\s*"
UUID = r"([0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12})"


def discover(spark: SparkSession, roots: dict[str, list[str]]) -> DataFrame:
    """agent, path, size, mtime of the session files under each agent's roots, each once. Without roots there are none."""
    out = spark.createDataFrame([], "agent string, path string, size long, mtime timestamp")
    for agent, folders in roots.items():
        for folder in folders:
            found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").load(folder)
            one = found.select(F.lit(agent).alias("agent"), "path", F.col("length").alias("size"), F.col("modificationTime").alias("mtime")).filter(F.col("path").rlike(PATHS[agent]))
            out = out.unionByName(one)
    return out.distinct()


def with_order(lines: DataFrame) -> DataFrame:
    """Adds path and line_ord, an order within each file, taken before any shuffle."""
    return lines.select("value", F.col("_metadata.file_path").alias("path"), F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("line_ord"))


def read_lines(spark: SparkSession, *paths: str) -> DataFrame:
    return with_order(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(list(paths)))


def parsed(lines: DataFrame) -> DataFrame:
    """path, line_ord, v VARIANT: lines that hold a JSON object; all others are left out (see rejects)."""
    return _tried(lines).filter("v IS NOT NULL").select("path", "line_ord", "v")


def rejects(lines: DataFrame) -> DataFrame:
    return _tried(lines).filter("v IS NULL AND trim(value) <> ''").select("path", "line_ord", "value")


def _tried(lines: DataFrame) -> DataFrame:
    text = F.trim("value")
    return lines.withColumn("v", F.when(text.startswith("{"), F.try_parse_json(text)))


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def touched_files(records: DataFrame) -> DataFrame:
    """path, line_ord, files: what each record's tool calls name, at whatever depth, distinct in first-seen order, MOST_FILES of one content at most."""
    payload = F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v"))
    is_call = F.coalesce(string_at(payload, "type").isin(*CALLS), F.lit(False))
    inside = F.coalesce(F.try_variant_get("v", "$.message.content", "variant"), F.try_variant_get("v", "$['$set'].messages", "variant"), field(payload, "content"))
    rows = records.select("path", "line_ord", F.when(is_call, payload).otherwise(inside).alias("content"))
    return with_contents(rows).select("path", "line_ord", "files").filter(F.size("files") > 0)


TURN = ("session_id", "path", "line_ord", "role", "text", "ts", "tools", "cwd")


def parse_claude(records: DataFrame) -> DataFrame:
    """Turns of dialect A. A side chain is passed over, and so are records that name another session than the
    file's own (copied when a session is resumed)."""
    own = F.nullif(F.regexp_extract("path", f"{UUID}[^/]*$", 1), F.lit(""))
    rows = records.select(
        "path", "line_ord", F.coalesce(own, _get("$.sessionId")).alias("session_id"), _get("$.sessionId").alias("named"), _get("$.type").alias("role"),
        _get("$.timestamp").alias("ts"), _get("$.cwd").alias("cwd"), F.coalesce(_get("$.isSidechain", "boolean"), F.lit(False)).alias("side"), F.try_variant_get("v", "$.message.content", "variant").alias("content"),
    )
    rows = rows.filter("role IN ('user', 'assistant') AND NOT side AND (named IS NULL OR named = session_id)")
    rows = with_contents(rows)
    return rows.filter(~((F.col("role") == "user") & F.col("text").startswith("tool_result"))).filter("text <> '' OR size(tools) > 0").select(*TURN)


def parse_codex(records: DataFrame) -> DataFrame:
    """Turns of dialect B. The payload may be nested or stand at the top; settings and events are passed over, and so is what the program says in the user's
    voice. The uuid that ends the file's name is the session, else what the first header says, else the name."""
    at = F.coalesce(F.try_variant_get("v", "$.payload", "variant"), F.col("v"))
    rows = records.filter(~F.coalesce(_get("$.type"), F.lit("")).isin("compacted", "turn_context", "event_msg")).withColumn("p", at)
    of = lambda name: string_at(F.col("p"), name)
    meta = _get("$.type") == "session_meta"
    # a file has few meta records: they are gathered and meet its other records, whose payloads are never sorted
    about = rows.filter(meta).groupBy("path").agg(F.min_by(of("id"), F.when(of("id").isNotNull(), F.col("line_ord"))).alias("meta_id"), F.min_by(of("cwd"), F.when(of("cwd").isNotNull(), F.col("line_ord"))).alias("cwd"))
    rows = rows.filter(~F.coalesce(meta, F.lit(False))).join(about.hint("shuffle_hash"), "path", "left")
    named, stem = F.regexp_extract("path", f"-{UUID}\\.jsonl$", 1), F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    session = F.coalesce(F.nullif(named, F.lit("")), F.col("meta_id"), F.regexp_replace(stem, "^rollout-", ""))
    call = F.coalesce(of("type").isin(*CALLS, SHELL), F.lit(False))
    rows = rows.filter(call | (of("type") == "message"))
    rows = rows.select("path", "line_ord", session.alias("session_id"), F.when(call, "assistant").otherwise(of("role")).alias("role"), _get("$.timestamp").alias("ts"), "cwd", F.when(call, F.col("p")).otherwise(field(F.col("p"), "content")).alias("content"))
    rows = with_contents(rows.filter("role IN ('user', 'assistant')"))
    users = F.col("role") == "user"
    rows = rows.filter(~(users & F.col("text").rlike(PREAMBLES["codex"])))
    rows = rows.withColumn("text", F.when(users, F.regexp_replace("text", PLAN_BANNER, "")).otherwise(F.col("text")))
    return rows.filter("text <> '' OR size(tools) > 0").select(*TURN)


def parse_gemini(records: DataFrame) -> DataFrame:
    """Turns of dialect C, a log of changes: bare messages and every snapshot's messages together. Of messages
    with one id and time the last written value stands at the first place; what the program says in the user's voice goes; after that a
    repeated (role, text) stays once. The session is the first header's id if the name's last eight digits begin it or the name has none, else the name."""
    snapshots = records.select("path", "line_ord", F.posexplode(F.try_variant_get("v", "$['$set'].messages", "array<variant>")).alias("pos", "m"))
    bare = records.filter(_get("$.type").isNotNull() & F.try_variant_get("v", "$['$set']", "variant").isNull()).select("path", "line_ord", F.lit(0).alias("pos"), F.col("v").alias("m"))
    of = lambda name: string_at(F.col("m"), name)
    rows = bare.unionByName(snapshots).select("path", "line_ord", "pos", of("id").alias("id"), F.coalesce(of("timestamp"), F.lit("")).alias("ts"), of("type").alias("type"), field(F.col("m"), "content").alias("content"))
    rows = rows.filter("type IS NOT NULL AND content IS NOT NULL")
    rows = with_contents(rows)
    order = F.struct("line_ord", "pos")
    named = rows.filter("id IS NOT NULL").groupBy("path", "id", "ts").agg(F.min(order).alias("at"), F.max_by(F.struct("type", "text", "tools"), order).alias("x")).select("path", "ts", "at", "x.type", "x.text", "x.tools")
    rows = named.unionByName(rows.filter("id IS NULL").select("path", "ts", order.alias("at"), "type", "text", "tools"))
    rows = rows.filter("type IN ('user', 'gemini') AND (text <> '' OR size(tools) > 0)").withColumn("role", F.when(F.col("type") == "user", "user").otherwise("assistant"))
    rows = rows.filter(~((F.col("role") == "user") & F.col("text").rlike(PREAMBLES["gemini"])))
    said = rows.filter("text <> ''").groupBy("path", "role", "text").agg(F.min(F.struct("ts", "at", "tools")).alias("f"), F.flatten(F.collect_set("tools")).alias("tools"))
    said = said.select("path", "role", "text", "f.ts", "f.at", F.array_sort(F.array_distinct("tools")).alias("tools"))
    silent = rows.filter("text = ''").select("path", "role", "text", "ts", "at", "tools")
    header = _get("$.sessionId")
    about = records.select("path", "line_ord", header.alias("id")).filter("id IS NOT NULL").groupBy("path").agg(F.min_by("id", "line_ord").alias("header"))
    rows = said.unionByName(silent).join(about.hint("shuffle_hash"), "path", "left")
    stem = F.regexp_extract("path", r"([^/]*)\.jsonl$", 1)
    short = F.lower(F.regexp_extract(stem, "-([0-9a-fA-F]{8})$", 1))
    fits = F.col("header").isNotNull() & F.lower("header").startswith(short)
    return rows.select(
        F.when(fits, F.col("header")).otherwise(stem).alias("session_id"), "path", F.col("at.line_ord").alias("line_ord"), "role", "text", F.nullif("ts", F.lit("")).alias("ts"), "tools", F.lit(None).cast("string").alias("cwd"),
    )


def sessions(turns: DataFrame) -> DataFrame:
    """One row per session: first known folder, first and last time, turns."""
    return turns.groupBy("session_id").agg(
        F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("line_ord"))).alias("cwd"), F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"), F.count(F.lit(1)).alias("turns"),
    )
