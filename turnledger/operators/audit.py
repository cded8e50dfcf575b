"""Checks over memory: keys that look like one slot, facts and sessions gone stale, transcripts gone, and the report of all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import composed, key_forms, terms
from ..sources.scratch import written
from .reconcile import current, live

#: What makes two keys near, strongest first.
WHY = ("same-key", "key-subset", "key-same-noun", "claim-overlap")
#: Shared words of two claims, and their least share of the shorter claim's.
SHARED, SHARE = 4, 3


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days; 0 if either is no date."""
    millis = lambda c: F.unix_millis(F.try_to_timestamp(c))
    return F.coalesce(F.floor((millis(later) - millis(earlier)) / 86_400_000), F.lit(0)).cast("long")


def _words(noun: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(noun, "([a-z0-9])([A-Z])", "$1-$2")), "[^a-z0-9؀-ۿ]+"), lambda w: w != "")))


def near_keys(facts: DataFrame) -> DataFrame:
    """subject, key, other (key < other), why, shared (words, of claims that overlap): pairs of live slots of a subject that look like one.

    Pairs arise from what they must share, never from a subject's keys against each other: a form of the key; the rarest word of the
    smaller key; all words of the key; one of a claim's rarer words, of which it has to hold one to share enough."""
    dotted = F.instr("key", ".") > 1
    rest = F.when(dotted, F.substring("key", F.instr("key", ".") + 1, F.length("key"))).otherwise(F.col("key"))
    k = composed(current(facts), "key", "claim").select("subject", "key", F.when(dotted, F.lower(F.substring_index("key", ".", 1))).otherwise("").alias("prefix"), _words(rest).alias("words"), F.array_distinct(F.filter(terms(F.col("claim")), lambda w: F.length(w) >= SHARED)).alias("said"))
    k = written(k)

    def met(a: DataFrame, b: DataFrame, on: list[str], test: Column, why: str) -> DataFrame:
        """Pairs of rows of a and b that agree on some columns and pass the test."""
        left, right = (df.select(*on, *(F.col(c).alias(f"{side}_{c}") for c in ("key", "prefix", "words", "said"))) for df, side in ((a, "a"), (b, "b")))
        pairs = left.join(right.hint("shuffle_merge"), on).filter((F.col("a_key") != F.col("b_key")) & test)
        return pairs.select("subject", F.least("a_key", "b_key").alias("key"), F.greatest("a_key", "b_key").alias("other"), F.lit(WHY.index(why)).alias("rank")).distinct()

    forms = k.withColumn("form", F.explode(key_forms(F.col("key"))))
    same_words = F.col("a_words") == F.col("b_words")
    found = met(forms, forms, ["subject", "form"], F.lit(True), "same-key")
    # a key inside another: the smaller brings its rarest word, the larger all of its own
    worded = k.filter("size(words) > 0").withColumn("word", F.explode("words"))
    often = worded.groupBy("subject", "prefix", "word").agg(F.count(F.lit(1)).alias("n"))
    rarest = worded.join(often.hint("shuffle_merge"), ["subject", "prefix", "word"]).groupBy("subject", "key").agg(F.min(F.struct("n", "word")).alias("r")).select("subject", "key", F.col("r.word").alias("word"))
    smaller = k.join(rarest.hint("shuffle_merge"), ["subject", "key"])
    inside = (F.col("a_prefix") == F.col("b_prefix")) & ~same_words & (F.size(F.array_except("a_words", "b_words")) == 0)
    found = found.unionByName(met(smaller, worded, ["subject", "word"], inside, "key-subset"))
    noun = k.filter("size(words) > 0").withColumn("noun", F.array_join("words", "-"))
    found = found.unionByName(met(noun, noun, ["subject", "noun"], F.col("a_prefix") != F.col("b_prefix"), "key-same-noun"))
    # claims that share four words share one of all but the three most frequent of either
    spoken = k.filter(F.size("said") >= SHARED).withColumn("word", F.explode("said"))
    often = written(spoken.groupBy("subject", "word").agg(F.count(F.lit(1)).alias("n")))
    ordered = spoken.join(often.hint("shuffle_merge"), ["subject", "word"]).groupBy("subject", "key").agg(F.array_sort(F.collect_list(F.struct("n", "word"))).alias("o"))
    heads = ordered.select("subject", "key", F.explode(F.slice("o", F.lit(1), F.size("o") - (SHARED - 1))).alias("h")).select("subject", "key", F.col("h.word").alias("word"))
    heads = written(k.join(heads.hint("shuffle_merge"), ["subject", "key"]))
    both = F.size(F.array_intersect("a_said", "b_said"))
    overlap = (F.col("a_key") < F.col("b_key")) & (both >= SHARED) & (SHARE * both >= F.least(F.size("a_said"), F.size("b_said")))
    found = found.unionByName(met(heads, heads, ["subject", "word"], overlap, "claim-overlap"))
    best = found.groupBy("subject", "key", "other").agg(F.min("rank").alias("rank"))
    why = F.element_at(F.array(*map(F.lit, WHY)), F.col("rank") + 1)
    said = lambda name, by: k.select("subject", F.col("key").alias(by), F.col("said").alias(name)).hint("shuffle_merge")
    out = best.withColumn("why", why).join(said("x", "key"), ["subject", "key"]).join(said("y", "other"), ["subject", "other"])
    return out.select("subject", "key", "other", "why", F.when(F.col("why") == WHY[3], F.size(F.array_intersect("x", "y"))).otherwise(0).cast("long").alias("shared"))


def stale(facts: DataFrame, claims: DataFrame, sessions: DataFrame, now: str, days: int = 60) -> DataFrame:
    """Slots below confidence 1 that no claim (subject, key, date) has restated for `days`, while the liveliest project of their subject (sessions:
    session_id, project, at, status) is not older than that."""
    seen = claims.groupBy(F.trim("subject").alias("subject"), F.trim("key").alias("key")).agg(F.max("date").alias("last_said"))
    newest = sessions.filter("status = 'ok'").groupBy("project").agg(F.max("at").alias("project_last")).filter("project_last IS NOT NULL")
    of_subject = facts.select("subject", "session_id").distinct().join(sessions.select("session_id", "project").hint("shuffle_merge"), "session_id").select("subject", "project").distinct()
    lively = of_subject.join(newest.hint("shuffle_merge"), "project").groupBy("subject").agg(F.min(F.struct("project")).alias("_"), F.max("project_last").alias("project_last"), F.max_by("project", F.struct("project_last", "project")).alias("project")).drop("_")
    held = current(facts.filter("confidence < 1")).select("subject", "key", "claim", "created_at")
    j = held.join(seen.hint("shuffle_merge"), ["subject", "key"], "left").join(lively.hint("shuffle_merge"), "subject").withColumn("last_seen", F.coalesce("last_said", "created_at"))
    j = j.withColumns({"age": days_between(F.col("last_seen"), F.lit(now)), "project_age": days_between(F.col("project_last"), F.lit(now))})
    return j.filter((F.col("age") >= days) & (F.col("project_age") <= days)).select("subject", "key", "claim", "last_seen", "age", "project", "project_age")


def gone(sessions: DataFrame, files: DataFrame) -> DataFrame:
    """Sessions whose source_file is not among the files (path)."""
    return sessions.join(files.select(F.col("path").alias("source_file")).distinct().hint("shuffle_merge"), "source_file", "left_anti")


def stale_pending(sessions: DataFrame, files: DataFrame, now: str, days: int = 7) -> tuple[DataFrame, DataFrame]:
    """Sessions that wait for an answer: those older than `days` whose transcript is there, and those whose transcript is gone, however old."""
    waits = sessions.filter("status = 'pending-extraction'").withColumn("age", days_between(F.col("at"), F.lit(now)))
    lost = gone(waits, files)
    there = waits.join(files.select(F.col("path").alias("source_file")).distinct().hint("shuffle_merge"), "source_file", "left_semi")
    return there.filter(F.col("age") >= days), lost


def report(parts: dict[str, DataFrame], scanned: dict[str, DataFrame]) -> DataFrame:
    """section, item, detail: every check (item, detail) under its name, and how many rows each scanned table has."""
    out = None
    for name, part in parts.items():
        rows = part.select(F.lit(name).alias("section"), F.col("item").cast("string").alias("item"), F.col("detail").cast("string").alias("detail"))
        out = rows if out is None else out.unionByName(rows)
    for name, table in scanned.items():
        rows = table.agg(F.count(F.lit(1)).cast("string").alias("detail")).select(F.lit("scanned").alias("section"), F.lit(name).alias("item"), "detail")
        out = rows if out is None else out.unionByName(rows)
    return out


def live_subjects(facts: DataFrame) -> DataFrame:
    return live(facts).select("subject").distinct()
