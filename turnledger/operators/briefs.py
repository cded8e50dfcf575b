"""What a project's next session is shown: facts, sections and a brief under a character budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import recent
from .reconcile import live

# Headings of the sections, in the order of their priority, and the line under open questions.
TITLE = "# ذاكرة "
RESUME, FACTS, PENDING, DECISIONS, HISTORY = "## استئناف — آخر جلسة (", "## ما هو صحيح الآن", "## معلّق — من آخر جلسة، ينتظر قرار المستخدم", "## قرارات سابقة", "## جلسات أخيرة"
ASK = "_لا تعتمد على هذه. اسأل المستخدم إن كانت ذات صلة._"
#: Most lines of a section, and sessions that decisions and history are read from.
OPEN, DECIDED, DECIDED_IN, RECENT = 12, 12, 12, 8

_ORDER = ("section", "a", "b", "c")


def project_facts(facts: DataFrame, sessions: DataFrame) -> DataFrame:
    """facts: live ones count. sessions: session_id, project. The live facts that each project's sessions produced, one a slot, the
    latest if there are several. A subject that two projects speak of is in both."""
    made = live(facts).join(sessions.select("session_id", "project").hint("shuffle_merge"), "session_id")
    row = F.struct("seq", "subject_kind", "claim", "confidence", "session_id")
    return made.groupBy("project", "subject", "key").agg(F.max_by(row, "seq").alias("f")).select("project", "subject", "key", "f.claim", "f.confidence", "f.session_id")


def _line(section: int, a: Column | str, b: Column | int, c: Column | str, text: Column | str) -> list[Column]:
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return ["project", F.lit(section).alias("section"), col(a).alias("a"), col(b).cast("int").alias("b"), col(c).alias("c"), col(text).alias("text")]


def _headed(lines: DataFrame, section: int, heading: str) -> DataFrame:
    """The lines under their heading and an empty line, for the projects that have any."""
    projects = lines.select("project").distinct()
    return lines.unionByName(projects.select(*_line(section, "", 0, "", heading))).unionByName(projects.select(*_line(section, "", 1, "", "")))


def brief_sections(sessions: DataFrame, facts: DataFrame, pending: DataFrame, decisions: DataFrame, resumes: DataFrame) -> DataFrame:
    """project, section 1 to 5, a, b, c (the order of lines), text.

    sessions: session_id, project, agent, started_at. pending: session_id, subject, key, claim, created_at. decisions: session_id, items
    array<string>. resumes: session_id, lines array<string>. Where the newest session stopped; live facts by subject; what
    the newest session left open; decisions of the newest sessions; those sessions."""
    newest = recent(sessions, max(DECIDED_IN, RECENT))
    last = newest.filter("rank = 1")
    day, number = F.substring("started_at", 1, 10), lambda c: F.lpad(F.col(c).cast("string"), 8, "0")
    stopped = last.join(resumes.hint("shuffle_merge"), "session_id").filter("size(lines) > 0")
    resume = stopped.select("*", F.posexplode("lines").alias("pos", "said")).select(*_line(1, "1", F.col("pos"), "", F.col("said")))
    heading = F.concat(F.lit(RESUME), day, F.lit(" · "), "agent", F.lit(")"))
    resume = resume.unionByName(stopped.select(*_line(1, "", 0, "", heading))).unionByName(stopped.select(*_line(1, "", 1, "", "")))
    held = project_facts(facts, sessions)
    by_subject = held.select("project", "subject").distinct()
    said = held.select(*_line(2, F.col("subject"), 1, F.col("key"), F.concat(F.lit("- "), "key", F.lit(": "), "claim")))
    said = said.unionByName(by_subject.select(*_line(2, F.col("subject"), 0, "", F.concat(F.lit("**"), "subject", F.lit("**"))))).unionByName(by_subject.select(*_line(2, F.col("subject"), 2, "", "")))
    order = Window.partitionBy("project").orderBy(F.desc("created_at"), "subject", "key")
    waiting = last.select("project", "session_id").join(pending.hint("shuffle_merge"), "session_id").withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= OPEN)
    asked = waiting.select(*_line(3, "1", F.col("rn"), "", F.concat(F.lit("- `"), "subject", F.lit("."), "key", F.lit("` — "), "claim")))
    asked = asked.unionByName(waiting.select("project").distinct().select(*_line(3, "2", 0, "", ""))).unionByName(waiting.select("project").distinct().select(*_line(3, "2", 1, "", ASK)))
    made = newest.filter(F.col("rank") <= DECIDED_IN).join(decisions.hint("shuffle_merge"), "session_id").select("project", "rank", F.posexplode("items").alias("pos", "item"))
    made = made.withColumn("rn", F.row_number().over(Window.partitionBy("project").orderBy("rank", "pos"))).filter(F.col("rn") <= DECIDED)
    decided = made.select(*_line(4, "1", F.col("rn"), "", F.concat(F.lit("- "), "item")))
    past = newest.filter(F.col("rank") <= RECENT).select(*_line(5, "1", F.col("rank"), "", F.concat(F.lit("- "), day, F.lit(" · "), "agent", F.lit(" · "), F.col("session_id").cast("string"))))
    parts = [resume, _headed(said, 2, FACTS), _headed(asked, 3, PENDING), _headed(decided, 4, DECISIONS), _headed(past, 5, HISTORY)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


# How the line that says how old a brief is begins and goes on, and a command that was never on the path.
STAMP, AGED, BEFORE_USE = "_محدَّث", " — إن مضى أكثر من يوم على هذا الختم فشغّل `", "` قبل الاعتماد عليه._"
NO_COMMAND = r"^mem\b"


def stamp_line(at: str, command: str) -> str:
    """The first line of a brief: when it was written, and what to run if that is long ago."""
    return f"{STAMP} {at}{AGED}{command}{BEFORE_USE}"


def stale_offers(documents: DataFrame, sessions: DataFrame, files: DataFrame, folders: DataFrame) -> DataFrame:
    """documents: doc_id, project, text. sessions: project, resume, source_file, a project's last one each. files, folders: path, what there is. doc_id, why: documents that offer what
    works no more. resume: a fenced command of the project's last session, whose transcript or whose folder (quoted after cd) is gone; the same words in prose are no offer. stamp: the line of the stamp names a command that
    was never there, or quotes a path that is not."""
    there = files.select(F.col("path").alias("source_file"), F.lit(True).alias("kept")).distinct()
    opens = F.regexp_extract("resume", r'^cd "([^"]+)"', 1)
    j = sessions.filter("resume IS NOT NULL").withColumn("folder", opens).join(there.hint("shuffle_merge"), "source_file", "left")
    j = j.join(folders.select(F.col("path").alias("folder"), F.lit(True).alias("stands")).distinct().hint("shuffle_merge"), "folder", "left")
    dead = j.filter("kept IS NULL OR (folder <> '' AND stands IS NULL)").select("project", F.col("resume").alias("command")).distinct()
    fenced = documents.select("doc_id", "project", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("```bash\\n([^\\n]*)\\n```"), F.lit(1)))).alias("command"))
    offered = fenced.join(dead.hint("shuffle_merge"), ["project", "command"], "left_semi").select("doc_id", F.lit("resume").alias("why"))
    line = F.regexp_extract("text", f"(?m)^{STAMP}[^\\n]*", 0)
    told = documents.select("doc_id", F.regexp_extract(line, "`([^`]+)`", 1).alias("command")).filter("command <> ''")
    never = told.filter(F.col("command").rlike(NO_COMMAND)).select("doc_id")
    quoted = told.select("doc_id", F.explode(F.regexp_extract_all("command", F.lit('"([^"]+)"'), F.lit(1))).alias("path"))
    missing = quoted.join(files.select("path").unionByName(folders.select("path")).distinct().hint("shuffle_merge"), "path", "left_anti").select("doc_id")
    return offered.unionByName(never.unionByName(missing).select("doc_id", F.lit("stamp").alias("why"))).distinct()


def briefs(sections: DataFrame, max_chars: int = 6000, stamp: str | None = None) -> DataFrame:
    """project, text: the stamp, if there is one, and sections in their order until the budget is used up. The one that does not fit is cut to whole lines, and left out
    if two or fewer are left; nothing after it is shown. As each line costs its length and one, all of this is a running sum
    that stops counting. No more than max_chars lines of a project are ever looked at."""
    by = Window.partitionBy("project").orderBy(*_ORDER)
    head = F.concat(F.lit(f"{stamp}\n\n" if stamp else ""), F.lit(TITLE), "project", F.lit("\n"))
    lines = sections.withColumn("rn", F.row_number().over(by)).filter(F.col("rn") <= max_chars)
    lines = lines.withColumn("used", F.length(head) + F.sum(F.length("text") + 1).over(by)).withColumn("fits", F.col("used") <= max_chars)
    part = Window.partitionBy("project", "section")
    lines = lines.withColumns({"whole": F.min("fits").over(part), "kept": F.count_if("fits").over(part)})
    shown = lines.filter("fits AND (whole OR kept > 2)")
    ends = shown.select("project", "section").distinct().select("project", "section", F.lit("￿").alias("a"), F.lit(9).alias("b"), F.lit("").alias("c"), F.lit("").alias("text"))
    rows = shown.select("project", *_ORDER, "text").unionByName(ends)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*_ORDER, "text"))), lambda x: x["text"]), "\n")
    body = rows.groupBy("project").agg(text.alias("body"))
    names = sections.select("project").distinct().join(body.hint("shuffle_merge"), "project", "left")
    return names.select("project", F.concat(F.regexp_replace(F.concat(head, F.lit("\n"), F.coalesce("body", F.lit(""))), r"\s+$", ""), F.lit("\n")).alias("text"))


def brief(sessions: DataFrame, facts: DataFrame, pending: DataFrame, decisions: DataFrame, resumes: DataFrame, project: str, max_chars: int = 6000) -> DataFrame:
    """One project's brief; only its sessions are read."""
    return briefs(brief_sections(sessions.filter(F.col("project") == project), facts, pending, decisions, resumes), max_chars)


def read_sessions(sessions: DataFrame, notes: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted: session_id. sessions: session_id, status. notes: session_id, text. What each holds: its note, else what became of it."""
    j = wanted.join(sessions.select("session_id", "status").hint("shuffle_merge"), "session_id", "left").join(notes.select("session_id", "text").hint("shuffle_merge"), "session_id", "left")
    return j.select("session_id", F.coalesce("text", F.when(F.col("status").isNull(), F.lit("unknown session")).otherwise(F.concat(F.lit("no note: "), "status"))).alias("text"))
