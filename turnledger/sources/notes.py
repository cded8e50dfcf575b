"""Notes and model replies as tables: documents with front matter and a JSON trailer, and replies that hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import once

# What opens and closes a note's trailer, the kinds of a subject, what a note without a title is called.
OPEN, CLOSE = "<!-- engine:facts", "-->"
KINDS = ("person", "project", "org", "term", "tool")
UNTITLED = "جلسة بلا عنوان"

_FACT = "subject:string,subjectKind:string,key:string,claim:string,confidence:double"
TRAILER = f"struct<facts:array<struct<{_FACT}>>,links:array<struct<from:string,to:string,relation:string>>,project:string,retracted:array<struct<{_FACT},createdAt:string,retractedAt:string,reason:string>>,distilled:string>"


def read_notes(spark: SparkSession, path: str) -> DataFrame:
    """Every note below a folder; a file is one row, as a note is small."""
    return parse_notes(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("md")))


def parse_notes(docs: DataFrame) -> DataFrame:
    """docs: path, md. session_id, date, agent, project, extractor, prose, trailer (null if there is none that parses). Documents without a session are
    no notes and are left out."""
    def parsed(md: Column, head: Column) -> Column:
        field = lambda name: F.regexp_extract(head, rf"(?m)^[ ]*{name}[ ]*:[ \t]*(.*?)[ \t]*$", 1).alias(name)
        body = F.regexp_replace(md, r"(?s)^---\n.*?\n---\n?", "")
        prose = F.trim(F.regexp_replace(F.substring_index(body, OPEN, 1), r"^\s+|\s+$", ""))
        start = F.instr(md, OPEN)
        trailer = once(F.substring(md, start + len(OPEN), F.length(md)), lambda rest: F.when((start > 0) & (F.instr(rest, CLOSE) > 0), F.from_json(F.trim(F.substring_index(rest, CLOSE, 1)), TRAILER)))
        return F.struct(field("session").alias("session_id"), field("date"), field("agent"), field("project"), field("extractor"), prose.alias("prose"), trailer.alias("trailer"))

    def note(md: Column) -> Column:
        return once(F.regexp_extract(md, r"(?s)^---\n(.*?)\n---", 1), lambda head: parsed(md, head))

    # one row from one document: a filter over the columns would be pushed below them, where it parses every document again
    one = F.filter(F.transform(F.array(F.regexp_replace("md", "\r\n", "\n")), note), lambda n: n["session_id"] != "")
    return docs.select("path", F.explode(one).alias("n")).select("path", "n.*")


def claims(notes: DataFrame) -> DataFrame:
    """The notes' claims as the fold reads them."""
    one = notes.select("session_id", "date", F.posexplode("trailer.facts").alias("ord", "f"))
    return one.select("session_id", "date", F.col("ord").cast("long").alias("ord"), "f.subject", F.col("f.subjectKind").alias("subject_kind"), "f.key", "f.claim", "f.confidence")


def withdrawals(notes: DataFrame) -> DataFrame:
    one = notes.select("session_id", "date", F.posexplode("trailer.retracted").alias("ord", "f"))
    return one.select("session_id", "date", F.col("ord").cast("long").alias("ord"), "f.subject", F.col("f.subjectKind").alias("subject_kind"), "f.key", "f.claim", "f.confidence", F.col("f.createdAt").alias("created_at"), F.col("f.retractedAt").alias("retracted_at"), "f.reason")


def links(notes: DataFrame) -> DataFrame:
    one = notes.select("session_id", "date", F.explode("trailer.links").alias("l"))
    return one.select("session_id", "date", F.col("l.from").alias("a"), F.col("l.to").alias("b"), "l.relation")


def said(notes: DataFrame) -> DataFrame:
    """session_id, date, kind (claim, withdrawal, link), subject, key, claim: what claims, withdrawals and links hold, of one reading of the notes. A link's ends
    stand for subject and key, its relation for the claim."""

    def rows(items: str, kind: str, subject: str, key: str, claim: str) -> Column:
        row = lambda x: F.struct(F.lit(kind).alias("kind"), x[subject].alias("subject"), x[key].alias("key"), x[claim].alias("claim"))
        return F.coalesce(F.transform(f"trailer.{items}", row), F.array().cast("array<struct<kind:string,subject:string,key:string,claim:string>>"))

    fact = ("subject", "key", "claim")
    every = F.concat(rows("facts", "claim", *fact), rows("retracted", "withdrawal", *fact), rows("links", "link", "from", "to", "relation"))
    return notes.select("session_id", "date", F.explode(every).alias("x")).select("session_id", "date", "x.*")


def rendered(notes: DataFrame) -> DataFrame:
    """session_id, agent, project, date, extractor, title, summary, did array<string>, trailer → path, md: what read_notes reads back."""
    day, colon = F.substring("date", 1, 10), F.instr("session_id", ":")
    short = F.left(F.when(colon > 0, F.substring("session_id", colon + 1, F.length("session_id"))).otherwise(F.col("session_id")), F.lit(8))
    agent = F.when(colon > 0, F.substring_index("session_id", ":", 1)).otherwise("unknown")
    path = F.concat(F.lit("sessions/"), F.substring(day, 1, 4), F.lit("/"), F.substring(day, 6, 2), F.lit("/"), day, F.lit("-"), agent, F.lit("-"), short, F.lit(".md"))
    head = F.concat(F.lit("---\nsession: "), "session_id", F.lit("\nagent: "), "agent", F.lit("\nproject: "), "project", F.lit("\ndate: "), "date", F.lit("\nextractor: "), "extractor", F.lit("\n---\n\n"))
    did = F.when(F.size("did") > 0, F.concat(F.lit("## عملنا\n- "), F.array_join("did", "\n- "), F.lit("\n\n"))).otherwise("")
    md = F.concat(head, F.lit("# "), "title", F.lit("\n\n"), "summary", F.lit("\n\n"), did, F.lit(OPEN + "\n"), F.to_json("trailer"), F.lit(f"\n{CLOSE}\n"))
    return notes.select(path.alias("path"), md.alias("md"))


def changed_docs(docs: DataFrame, previous: DataFrame) -> DataFrame:
    """Both: path, md. Documents that are new or read otherwise than before: only these are written."""
    known = previous.select("path", F.sha2(F.col("md").cast("binary"), 256).alias("digest"))
    return docs.withColumn("digest", F.sha2(F.col("md").cast("binary"), 256)).join(known.hint("shuffle_merge"), ["path", "digest"], "left_anti").drop("digest")


def _walked(texts):
    """The first balanced object of each text, with care for strings; null where it never closes."""

    def walk(text):
        if text is None or (start := text.find("{")) < 0:
            return None
        depth, quoted, escaped = 0, False, False
        for i in range(start, len(text)):
            c = text[i]
            if quoted:
                quoted, escaped = c != '"' or escaped, c == "\\" and not escaped
            elif c == '"':
                quoted, escaped = True, False
            else:
                depth += (c == "{") - (c == "}")
                if depth == 0:
                    return text[start : i + 1]
        return None

    return texts.map(walk)


def _scalar(v: Column, path: str) -> Column:
    """A string, or a number or truth value as one; null for anything else."""
    x = F.try_variant_get(v, path, "variant")
    return F.when(F.schema_of_variant(x).rlike("^(STRING|BIGINT|BOOLEAN|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get(x, "$", "string"))


def _list(v: Column, name: str) -> Column:
    return F.coalesce(F.try_variant_get(v, f"$.{name}", "array<variant>"), F.array().cast("array<variant>"))


def _filled(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def _confidence(v: Column) -> Column:
    text = F.lower(F.trim(_scalar(v, "$.confidence")))
    number = F.when(text == "true", 1.0).when(text == "false", 0.0).when(text == "", 0.0).otherwise(text.try_cast("double"))
    return F.when((number >= 0) & (number <= 1), number)


def parse_replies(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """replies: session_id, reply. notes: session_id, status (ok, no-json, unreadable), title, summary, did, open, facts; rejects: session_id, field, item, the list
    items that were dropped, cut to 120 characters. Only replies whose first to last brace is no object leave the JVM: the frame is split and put together again."""
    span = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(F.nullif(span, F.lit("")))
    walk = F.pandas_udf(_walked, "string")
    rows = replies.select("session_id", "reply", whole.alias("v"))
    doubtful = F.coalesce(F.col("reply").contains("{"), F.lit(False)) & F.col("v").isNull()
    rows = rows.filter(~doubtful).unionByName(rows.filter(doubtful).withColumn("v", F.try_parse_json(walk(F.col("reply")))))
    status = F.when(~F.coalesce(F.col("reply").contains("{"), F.lit(False)), "no-json").when(F.col("v").isNull(), "unreadable").otherwise("ok")
    kind = lambda x: F.when(_scalar(x, "$.subjectKind").isin(*KINDS), _scalar(x, "$.subjectKind")).otherwise("term")
    fact = lambda x: F.struct(_filled(_scalar(x, "$.subject")).alias("subject"), kind(x).alias("subject_kind"), _filled(_scalar(x, "$.key")).alias("key"), _filled(_scalar(x, "$.claim")).alias("claim"), _confidence(x).alias("confidence"), F.to_json(x).alias("item"))
    said = lambda x: F.struct(_filled(_scalar(x, "$")).alias("text"), F.to_json(x).alias("item"))
    rows = rows.select("session_id", status.alias("status"), F.coalesce(_scalar(F.col("v"), "$.title"), F.lit("")).alias("title"), F.coalesce(_scalar(F.col("v"), "$.summary"), F.lit("")).alias("summary"), F.transform(_list(F.col("v"), "facts"), fact).alias("facts"), *(F.transform(_list(F.col("v"), n), said).alias(n) for n in ("did", "open")))
    good = lambda f: f["subject"].isNotNull() & f["key"].isNotNull() & f["claim"].isNotNull() & f["confidence"].isNotNull()
    first = F.trim(F.regexp_extract(F.trim("summary"), r"^[^.!?؟\n]*", 0))
    title = F.coalesce(_filled(F.col("title")), F.nullif(first, F.lit("")), F.lit(UNTITLED))
    kept = lambda name: F.transform(F.filter(name, lambda x: x["text"].isNotNull()), lambda x: x["text"])
    notes = rows.select("session_id", "status", title.alias("title"), "summary", kept("did").alias("did"), kept("open").alias("open"), F.transform(F.filter("facts", good), lambda f: f.dropFields("item")).alias("facts"))
    bad = [rows.select("session_id", F.lit("facts").alias("field"), F.explode(F.filter("facts", lambda f: ~good(f))).alias("x"))]
    bad += [rows.select("session_id", F.lit(n).alias("field"), F.explode(F.filter(n, lambda x: x["text"].isNull())).alias("x")) for n in ("did", "open")]
    dropped = [b.select("session_id", "field", F.left("x.item", F.lit(120)).alias("item")) for b in bad]
    return notes, dropped[0].unionByName(dropped[1]).unionByName(dropped[2])
