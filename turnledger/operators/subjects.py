"""Which names may be subjects: the guard, anchoring to a project, moves that were recorded, confirmed claims that carry over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import claim_form, equivalent, key_forms, name_form
from ..sources.scratch import written
from .reconcile import live

# The shapes of item numbers and of class names.
TICKET, NUMBER = r"(?<![A-Za-z0-9_])[A-Za-z]{1,6}\d{0,3}-\d{1,5}(?![A-Za-z0-9_])", r"(^|\s)#\d+(?![A-Za-z0-9_])"
CLASS = r"^[A-Z][^A-Z]*[A-Z]"


def part_of_project(subject: Column, kind: Column, is_folder: Column) -> Column:
    """What a name says it is when it names a part of a project: file, ticket, class or folder; else null. A tool or a person is
    excused for all but a path."""
    return (
        F.when(subject.rlike(r"[/\\]"), "file")
        .when(kind.isin("tool", "person"), F.lit(None).cast("string"))
        .when(subject.rlike(TICKET) | subject.rlike(NUMBER), "ticket")
        .when(subject.contains("."), "file")
        .when(subject.rlike("^[A-Z][A-Za-z0-9]*$") & subject.rlike("[a-z]") & subject.rlike(CLASS), "class")
        .when(is_folder, "folder")
    )


def _with_folder_flag(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds is_folder: does the project have a folder of the subject's name, however spelled? folders: project, folder."""
    known = folders.select("project", name_form(F.col("folder")).alias("_form")).distinct().withColumn("is_folder", F.lit(True))
    return df.withColumn("_form", name_form(F.col("subject"))).join(known.hint("shuffle_merge"), ["project", "_form"], "left").withColumn("is_folder", F.coalesce("is_folder", F.lit(False))).drop("_form")


def classify_subjects(subjects: DataFrame, folders: DataFrame) -> DataFrame:
    """subjects: subject, subject_kind, project. Adds why."""
    flagged = _with_folder_flag(subjects, folders)
    return flagged.withColumn("why", part_of_project(F.col("subject"), F.col("subject_kind"), F.col("is_folder"))).drop("is_folder")


def name_words(name: Column) -> Column:
    """Lower-case words, parted at humps and at what is no letter or digit."""
    humps = F.regexp_replace(F.regexp_replace(name, "([a-z0-9])([A-Z])", "$1-$2"), "([A-Z]+)([A-Z][a-z])", "$1-$2")
    return F.filter(F.split(F.lower(humps), "[^a-z0-9؀-ۿ]+"), lambda w: w != "")


def part_key(key: Column, part: Column, project: Column) -> Column:
    """The key under which a part's claim moves to its project: prefix, the part's own words, the key's words."""
    dotted = F.instr(key, ".") > 1
    prefix = F.when(dotted, F.lower(F.substring_index(key, ".", 1))).otherwise("misc")
    noun = F.when(dotted, F.substring(key, F.instr(key, ".") + 1, F.length(key))).otherwise(key)
    own = F.concat(name_words(project), F.array(prefix))
    words = F.array_distinct(F.concat(F.array_except(name_words(part), own), name_words(noun)))
    return F.concat(prefix, F.lit("."), F.when(F.size(words) > 0, F.array_join(words, "-")).otherwise("part"))


def anchor(claims: DataFrame, known: DataFrame, folders: DataFrame) -> DataFrame:
    """claims: subject, subject_kind, key, project and more. known: subject, first_seen. Adds to_subject, to_kind, to_key and why (null: the
    claim stays as it is). Known subjects and the project itself pass; another spelling of one takes its spelling, the project's
    first, else the oldest; a name of a part moves to the project under a key that names the part."""
    subject = F.trim("subject")
    exact = known.select(F.col("subject").alias("_s")).distinct().withColumn("is_known", F.lit(True))
    oldest = known.groupBy(name_form(F.col("subject")).alias("_f")).agg(F.min(F.struct("first_seen", "subject")).alias("old"))
    j = _with_folder_flag(claims, folders).withColumns({"_s": subject, "_f": name_form(subject)})
    j = j.join(exact.hint("shuffle_merge"), "_s", "left").join(oldest.hint("shuffle_merge"), "_f", "left")
    project = F.coalesce("project", F.lit(""))
    passes = (F.col("_s") == project) | F.col("is_known")
    same = F.when(name_form(project) == F.col("_f"), project).otherwise(F.col("old.subject"))
    part = F.when(project != "", part_of_project(F.col("_s"), F.col("subject_kind"), F.col("is_folder")))
    j = j.withColumn("why", F.when(passes, F.lit(None).cast("string")).when(same.isNotNull(), "spelling").otherwise(part))
    moves = F.col("why").isNotNull() & (F.col("why") != "spelling")
    return j.withColumns({
        "to_subject": F.when(F.col("why") == "spelling", same).when(moves, project).otherwise(F.col("_s")),
        "to_kind": F.when(moves, "project").otherwise(F.col("subject_kind")),
        "to_key": F.when(moves, part_key(F.col("key"), F.col("_s"), project)).otherwise(F.col("key")),
    }).drop("_s", "_f", "is_known", "old", "is_folder")


def apply_moves(claims: DataFrame, moves: DataFrame) -> DataFrame:
    """claims: subject, key and more. moves: ord, subject, key, to_subject, to_key. Adds to_subject, to_key: where the ledger's first fitting
    record sends the slot, and that one's again, for as many hops as the ledger has records. Spellings meet by their forms. Only
    distinct slots hop; rounds end as soon as none does."""
    hops = moves.count()
    form = lambda df: df.withColumn("_s", name_form(F.col("subject"))).withColumn("_k", F.explode(key_forms(F.col("key"))))
    ledger = written(form(moves).groupBy("_s", "_k").agg(F.min(F.struct("ord", F.trim("to_subject").alias("s"), F.trim("to_key").alias("k"))).alias("to")))
    slots = written(claims.select("subject", "key").distinct().withColumns({"at_subject": F.trim("subject"), "at_key": F.trim("key")}))
    for _ in range(hops):
        here = slots.select(F.col("at_subject").alias("subject"), F.col("at_key").alias("key")).distinct()
        met = form(here).join(ledger.hint("shuffle_merge"), ["_s", "_k"]).groupBy("subject", "key").agg(F.min("to").alias("to"))
        met = written(met.select(F.col("subject").alias("at_subject"), F.col("key").alias("at_key"), "to"))
        if met.isEmpty():
            break
        slots = written(slots.join(met.hint("shuffle_merge"), ["at_subject", "at_key"], "left").select("subject", "key", F.coalesce("to.s", "at_subject").alias("at_subject"), F.coalesce("to.k", "at_key").alias("at_key")))
    return claims.join(slots.withColumnsRenamed({"at_subject": "to_subject", "at_key": "to_key"}).hint("shuffle_merge"), ["subject", "key"])


def carry_confirmed(previous: DataFrame, claims: DataFrame) -> DataFrame:
    """Both: session_id, ord, subject, subject_kind, key, claim, confidence. The new reading's claims after those of the earlier one that a person confirmed
    and that it does not repeat; carried tells which."""
    cols = ["session_id", "ord", "subject", "subject_kind", "key", "claim", "confidence"]
    old = previous.filter("confidence >= 1").select(*cols, claim_form(F.col("claim")).alias("form"))
    new = claims.select("session_id", F.trim("subject").alias("subject"), claim_form(F.col("claim")).alias("new_form")).distinct()
    left = old.join(new.withColumnRenamed("new_form", "form").hint("shuffle_merge"), ["session_id", "subject", "form"], "left_anti")
    said = left.join(new.hint("shuffle_merge"), ["session_id", "subject"]).filter(equivalent(F.col("form"), F.col("new_form"))).select("session_id", "subject", "form").distinct()
    kept = left.join(said.hint("shuffle_merge"), ["session_id", "subject", "form"], "left_anti")
    return kept.select(*cols, F.lit(True).alias("carried")).unionByName(claims.select(*cols, F.lit(False).alias("carried")))


def rejected_subjects(facts: DataFrame, sessions: DataFrame, folders: DataFrame) -> DataFrame:
    """Live subjects the guard would not let in if they were new, by project. sessions: session_id, project."""
    rows = live(facts).join(sessions.select("session_id", "project").hint("shuffle_merge"), "session_id").filter("subject <> project")
    counted = rows.groupBy("subject", "project").agg(F.min_by("subject_kind", "seq").alias("subject_kind"), F.count(F.lit(1)).alias("facts"))
    return classify_subjects(counted, folders).filter("why IS NOT NULL").select("subject", "subject_kind", "project", "facts", "why")


def undefined_tools(facts: DataFrame, sessions: DataFrame, definitions: DataFrame) -> DataFrame:
    """Live tools that no definition (subject, definition) says anything of, with their projects."""
    rows = live(facts).filter("subject_kind = 'tool'").join(sessions.select("session_id", "project").hint("shuffle_merge"), "session_id").filter("subject <> project")
    defined = definitions.filter("trim(definition) <> ''").select("subject").distinct()
    rows = rows.filter(part_of_project(F.col("subject"), F.lit("tool"), F.lit(False)).isNull()).join(defined.hint("shuffle_merge"), "subject", "left_anti")
    return rows.groupBy("subject").agg(F.count(F.lit(1)).alias("facts"), F.array_join(F.array_sort(F.collect_set("project")), ",").alias("projects"))
