"""Sessions and turns: statistics, clipping, budgeted distillation, local notes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

# The labels of a distilled session.
USER, ASSISTANT = "المستخدم", "الوكيل"
SESSION, FOLDER, UNKNOWN, START, TOOLS = "# جلسة ", "المجلد: ", "غير معروف", "البداية: ", "أدوات: "
CUT, DROPPED = "\n[…قُصّ…]\n", ("### […حُذف ", " دوراً من المنتصف…]")

# Fixed value: folders that no session picks up from.
RESUME_SKIP = r"/temp/|/tmp/|/scratchpad/|/\.claude/projects/[^/]+/memory/"

#: turns: session_id, seq, role, text


def sessions_from_turns(turns: DataFrame) -> DataFrame:
    """One row per session: turn counts by role and the span of its turns."""
    return turns.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("turns"),
        F.count_if(F.col("role") == "user").alias("user_turns"),
        F.count_if(F.col("role") == "assistant").alias("assistant_turns"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def tool_markers(turns: DataFrame) -> DataFrame:
    """Names used since the last answer, as one marker after the next assistant turn with text. turns carry
    tools ARRAY<STRING>; names that no answer follows are dropped."""
    answer = (F.col("role") == "assistant") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    before = Window.partitionBy("session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    grouped = turns.withColumn("answer", answer).withColumn("part", F.coalesce(F.sum(F.col("answer").cast("int")).over(before), F.lit(0)))
    one = grouped.groupBy("session_id", "part").agg(
        F.max(F.when(F.col("answer"), F.col("seq"))).alias("seq"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("seq", "tools"))), lambda x: F.coalesce(x["tools"], F.array().cast("array<string>"))))).alias("names"),
    )
    return one.filter("seq IS NOT NULL AND size(names) > 0").select("session_id", "seq", F.array_join("names", ",").alias("tool"))


def session_stats(turns: DataFrame) -> DataFrame:
    """Characters of the user's turns (unclipped) and blocks; with a tools column also the distinct sorted tool names."""
    tools = [F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("tools")))), ",").alias("tool_names")] if "tools" in turns.columns else []
    return turns.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "user", F.length("text"))), F.lit(0)).cast("long").alias("user_chars"),
        F.count_if(F.col("role").isin("user", "assistant")).alias("blocks"),
        *tools,
    )


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def clipped(text: Column, limit: int) -> Column:
    """At most `limit` characters: both ends of a longer text with a mark between."""
    flat = _stripped(F.regexp_replace(text, "\n{3,}", "\n\n"))
    half = (limit - 24) // 2
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.left(flat, F.lit(half)), F.lit(CUT), F.right(flat, F.lit(half))))


def clip_turns(turns: DataFrame, user: int = 6000, assistant: int = 1200) -> DataFrame:
    return turns.filter(F.col("role").isin("user", "assistant")).withColumn("text", F.when(F.col("role") == "user", clipped(F.col("text"), user)).otherwise(clipped(F.col("text"), assistant)))


def distil(turns: DataFrame, max_chars: int = 24_000, user: int = 6000, assistant: int = 1200, agent: str = "chat") -> DataFrame:
    """session_id, text, dropped: blocks are taken alternately from front and back until the next one does not
    fit. The alternation is a priority and the budget a running sum over it, so no loop is needed."""
    label = F.when(F.col("role") == "user", USER).otherwise(ASSISTANT)
    blocks = clip_turns(turns, user, assistant).select("session_id", "seq", F.concat(F.lit("### "), label, F.lit("\n"), "text").alias("block"))
    whole = Window.partitionBy("session_id")
    header = f"{SESSION}{agent}\n{FOLDER}{UNKNOWN}"
    budget = max(0, max_chars - len(header))
    blocks = blocks.withColumns({"i": F.row_number().over(whole.orderBy("seq")) - 1, "n": F.count(F.lit(1)).over(whole), "cost": F.length("block") + 2})
    blocks = blocks.withColumn("turn", F.least(2 * F.col("i"), 2 * (F.col("n") - 1 - F.col("i")) + 1))
    blocks = blocks.withColumns({"used": F.sum("cost").over(whole.orderBy("turn")), "total": F.sum("cost").over(whole)})
    keep = (F.col("total") <= budget) | (F.col("used") <= budget)
    out = blocks.groupBy("session_id").agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct("i", "block")))).alias("kept"),
        F.count_if(~keep).alias("dropped"), F.min(F.when(~keep, F.col("i"))).alias("gap"),
    )
    before = F.transform(F.filter("kept", lambda b: b["i"] < F.coalesce("gap", F.lit(1 << 30))), lambda b: b["block"])
    after = F.transform(F.filter("kept", lambda b: b["i"] > F.coalesce("gap", F.lit(1 << 30))), lambda b: b["block"])
    marker = F.when(F.col("dropped") > 0, F.array(F.concat(F.lit(DROPPED[0]), F.col("dropped").cast("string"), F.lit(DROPPED[1])))).otherwise(F.array().cast("array<string>"))
    return out.select("session_id", F.concat(F.lit(header), F.array_join(F.concat(before, marker, after), "\n\n")).alias("text"), "dropped")


def with_digest(df: DataFrame, col: str = "text") -> DataFrame:
    return df.withColumn("digest", F.sha2(F.col(col).cast("binary"), 256))


def local_notes(turns: DataFrame, least: int = 12, most: int = 12) -> DataFrame:
    """Without a model: title and first sentences of the user's turns, and where the talk stopped."""
    first = F.trim(F.regexp_extract(_stripped(F.col("text")), r"^[^.!?\n]*", 0))
    said = turns.filter("role = 'user'").withColumn("sentence", first).filter(F.length("sentence") > least)
    ranked = said.withColumn("rn", F.row_number().over(Window.partitionBy("session_id").orderBy("seq")))
    return ranked.groupBy("session_id").agg(
        F.min_by("sentence", "seq").alias("title"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= most, F.struct("seq", "sentence")))), lambda x: x["sentence"]), " | ").alias("did"),
        F.max_by("sentence", "seq").alias("where_left"),
    )


def drop_tiny(stats: DataFrame, min_user_chars: int = 200) -> DataFrame:
    return stats.filter(F.col("user_chars") >= min_user_chars)


def same_text(distilled: DataFrame, notes: DataFrame) -> DataFrame:
    """Adds verdict: same when the session's note was made of the same digest, else todo."""
    known = notes.select("session_id", "digest", F.lit(True).alias("known"))
    return distilled.join(known.hint("shuffle_merge"), ["session_id", "digest"], "left").withColumn("verdict", F.when(F.col("known"), "same").otherwise("todo")).drop("known")


def changed_files(files: DataFrame, ledger: DataFrame, min_user_chars: int = 200, force: bool = False) -> DataFrame:
    """files: path, size, mtime. ledger: path, fingerprint, status, min_user_chars. Adds the fingerprint and a
    verdict: new, changed, retry, rejudge or unchanged."""
    print_ = F.concat_ws(":", F.col("size").cast("string"), F.col("mtime").cast("string"))
    j = files.withColumn("fingerprint", print_).join(ledger.select("path", F.col("fingerprint").alias("was"), "status", F.col("min_user_chars").alias("threshold")).hint("shuffle_merge"), "path", "left")
    verdict = (
        F.when(F.lit(force), "changed")
        .when(F.col("was").isNull(), "new")
        .when(F.col("was") != F.col("fingerprint"), "changed")
        .when(F.col("status").isin("quarantined", "pending-extraction"), "retry")
        .when((F.col("status") == "empty") & (F.col("threshold") != min_user_chars), "rejudge")
        .otherwise("unchanged")
    )
    return j.withColumn("verdict", verdict).drop("was", "status", "threshold")


def select_candidates(files: DataFrame, limit: int = 100, project: str | None = None, agent: str | None = None) -> DataFrame:
    """files: path, mtime, project, agent. The filters come first, then the oldest `limit` files are taken. Adds rank (null: left for the next
    run) and left, how many those are. Only `limit` rows are ever ranked."""
    if project is not None:
        files = files.filter(F.col("project") == project)
    if agent is not None:
        files = files.filter(F.col("agent") == agent)
    first = written(files.orderBy("mtime", "path").limit(limit).select("path", "mtime"))
    ranked = F.broadcast(first.withColumn("rank", F.row_number().over(Window.orderBy("mtime", "path"))).select("path", "rank"))  # at most `limit` rows
    total = F.broadcast(files.agg(F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias("left")))  # one row
    return files.join(ranked, "path", "left").crossJoin(total)


def drop_self(sessions: DataFrame, folder: str) -> DataFrame:
    """Without the extractor's own sessions: those whose cwd is its folder."""
    tidy = lambda c: F.lower(F.regexp_replace(F.regexp_replace(c, r"\\\\", "/"), "/+$", ""))
    return sessions.filter(~F.coalesce(tidy(F.col("cwd")) == tidy(F.lit(folder)), F.lit(False)))


def record_unread(ledger: DataFrame, judged: DataFrame, min_user_chars: int = 200) -> DataFrame:
    """ledger: session_id, fingerprint, status, min_user_chars. judged: session_id (null: the file yields none), agent, path, fingerprint, kind (tiny, self or
    none), user_chars. The ledger with what was read and set aside; a row that says more than that is never overwritten."""
    new = judged.filter("fingerprint IS NOT NULL").select(
        F.coalesce("session_id", F.concat_ws(":", "agent", "path")).alias("session_id"), "fingerprint",
        F.when(F.col("kind") == "self", "skipped").otherwise("empty").alias("status"),
        F.when((F.col("kind") == "tiny") & F.col("user_chars").isNotNull(), min_user_chars).cast("int").alias("min_user_chars"),
    )
    row = lambda side: F.struct(*(F.col(f"{side}.{c}") for c in ("fingerprint", "status", "min_user_chars")))
    keep = F.col("l.session_id").isNotNull() & (F.col("n.session_id").isNull() | ~F.col("l.status").isin("empty", "skipped"))
    j = ledger.alias("l").join(new.alias("n").hint("shuffle_merge"), F.col("l.session_id") == F.col("n.session_id"), "full_outer")
    return j.select(F.coalesce("l.session_id", "n.session_id").alias("session_id"), F.when(keep, row("l")).otherwise(row("n")).alias("r")).select("session_id", "r.*")


def offered_facts(facts: DataFrame, sessions: DataFrame, readers: DataFrame, tools: DataFrame) -> DataFrame:
    """readers: reader, project, agent (null: only the project's own). sessions: session_id, project, agent. tools: subject. For each reader the live
    facts of its project, and those of defined tools that the same agent filed elsewhere."""
    f = facts.filter("superseded_at IS NULL AND retracted_at IS NULL").join(sessions.select("session_id", "project", "agent").hint("shuffle_merge"), "session_id")
    f = f.select("subject", "key", "claim", "session_id", "seq", "project", "agent")
    own = readers.select("reader", "project").join(f.drop("agent").hint("shuffle_merge"), "project").drop("project")
    known = f.join(tools.select("subject").distinct().hint("shuffle_merge"), "subject", "left_semi")
    others = readers.select("reader", "agent", F.col("project").alias("ours")).join(known.hint("shuffle_merge"), "agent").filter("project <> ours").drop("agent", "project", "ours")
    return own.unionByName(others)


#: A reading's commit follows its row within this many milliseconds, and may precede it by a minute.
READING_SPAN, SLACK = 12 * 3_600_000, 60_000


def infer_digests(notes: DataFrame, commits: DataFrame, files: DataFrame) -> DataFrame:
    """notes: note, session_id, processed_at, fingerprint, path, of model notes without a digest. commits: note, at, kind (scan, revert or other). files: path, size,
    parsed_id. Adds skipped: null if the digest of what the file distils to now may stand for the text that was read, else why not."""
    scans = commits.groupBy("note").agg(F.max(F.when(F.col("kind") == "scan", F.col("at"))).alias("scan_at"), F.max(F.when(F.col("kind") == "revert", F.col("at"))).alias("revert_at"))
    j = notes.join(scans.hint("shuffle_merge"), "note", "left").join(files.hint("shuffle_merge"), "path", "left")
    late = F.unix_millis(F.col("scan_at").cast("timestamp")) - F.unix_millis(F.col("processed_at").cast("timestamp"))
    recorded = F.regexp_extract("fingerprint", r"^(\d+):\d+$", 1)
    why = (
        F.when(F.col("scan_at").isNull(), "no reading")
        .when(F.col("revert_at") > F.col("scan_at"), "reverted since")
        .when(~((late >= -SLACK) & (late <= READING_SPAN)), "another reading's row")
        .when(recorded == "", "not a reading's fingerprint")
        .when(F.col("size").isNull(), "no file")
        .when(F.col("size").cast("string") != recorded, "file grew")
        .when(~F.col("parsed_id").eqNullSafe(F.col("session_id")), "another session")
    )
    return j.select("note", "session_id", why.alias("skipped"))


def tally(candidates: DataFrame) -> DataFrame:
    """candidates: outcome. How many of each, and in all."""
    return candidates.groupingSets([["outcome"], []], "outcome").agg(F.coalesce("outcome", F.lit("discovered")).alias("what"), F.count(F.lit(1)).alias("files")).select("what", "files")


def open_report(active: DataFrame, files: DataFrame, now, quiet: str = "2 minutes", busy: str = "6 hours") -> DataFrame:
    """active: key, at, busy. files: key, mtime. Sessions that are still open, and why: busy, quiet for too short, or only their file was touched."""
    j = close_sessions(active, now, quiet, busy).join(files.hint("shuffle_merge"), "key", "full_outer")
    touched = F.coalesce(F.col("mtime") + F.expr(f"INTERVAL {quiet}") > now, F.lit(False))
    why = F.when(F.col("open") & F.col("busy"), "busy").when(F.col("open"), "quiet").when(touched, "mtime")
    return j.withColumn("why", why).filter("why IS NOT NULL").select("key", "why")


def retry(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Files (path) of sessions (session_id, source_file, status) that had no answer or were unsafe: they enter every run."""
    again = sessions.filter(F.col("status").isin("pending-extraction", "quarantined")).select("session_id", "status", F.col("source_file").alias("path"))
    return files.join(again.hint("shuffle_merge"), "path")


def kept_notes(previous: DataFrame, new: DataFrame) -> DataFrame:
    """Both: session_id, text. A reading that failed (null text) leaves the note before it, as does a session that was not read."""
    j = previous.select("session_id", F.col("text").alias("was")).join(new.select("session_id", F.col("text").alias("now")).hint("shuffle_merge"), "session_id", "full_outer")
    return j.select("session_id", F.coalesce("now", "was").alias("text"))


def resume_files(files: DataFrame, stats: DataFrame, most: int = 15) -> DataFrame:
    """files: session_id, pos, path. stats: path, mtime. Paths worth coming back to: scratch folders are out; up to `most` keep their order, of more the newest
    stay. rank orders them."""
    slashed = F.concat(F.lit("/"), F.lower(F.regexp_replace("path", r"\\\\", "/")), F.lit("/"))
    kept = files.filter(~slashed.rlike(RESUME_SKIP)).join(stats.hint("shuffle_merge"), "path", "left").withColumn("mtime", F.coalesce("mtime", F.lit(0)))
    by = Window.partitionBy("session_id")
    kept = kept.withColumns({"n": F.count(F.lit(1)).over(by), "newest": F.row_number().over(by.orderBy(F.desc("mtime"), "pos")), "first": F.row_number().over(by.orderBy("pos"))})
    return kept.withColumn("rank", F.when(F.col("n") <= most, F.col("first")).otherwise(F.col("newest"))).filter(F.col("rank") <= most).select("session_id", "path", "rank")


def islands(events: DataFrame, quiet: str = "2 minutes", busy: str = "6 hours") -> DataFrame:
    """events: key, ts, busy. Sessions end after a gap that depends on the last record before it."""
    order = Window.partitionBy("key").orderBy("ts", "id")
    gap = F.when(F.lag("busy").over(order), F.expr(f"INTERVAL {busy}")).otherwise(F.expr(f"INTERVAL {quiet}"))
    starts = events.withColumn("starts", F.coalesce((F.col("ts") >= F.lag("ts").over(order) + gap), F.lit(True)))
    part = starts.withColumn("island", F.sum(F.col("starts").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return part.groupBy("key", "island").agg(F.min("ts").alias("opened"), F.max("ts").alias("last_at"), F.count(F.lit(1)).alias("records"), F.max_by("busy", F.struct("ts", "id")).alias("busy"))


def activity(records: DataFrame) -> DataFrame:
    """key, ts, id, busy → the last record of each key and whether it leaves a turn running."""
    return records.groupBy("key").agg(F.max("ts").alias("at"), F.max_by("busy", F.struct("ts", "id")).alias("busy"))


def close_sessions(active: DataFrame, now, quiet: str = "2 minutes", busy: str = "6 hours") -> DataFrame:
    limit = F.when(F.col("busy"), F.expr(f"INTERVAL {busy}")).otherwise(F.expr(f"INTERVAL {quiet}"))
    return active.withColumn("open", F.col("at") + limit > now)
