"""Documents as a corpus: terms, search, redaction."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import redact as red
from ..operators import search as ops



def _docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def x1_terms(spark, sf_dir):
    return ops.term_table(ops.build_index(_docs(spark, sf_dir)))


def x2_postings(spark, sf_dir):
    return ops.build_index(_docs(spark, sf_dir)).postings


def x4_search(spark, sf_dir):
    """Each benchmark item is a query: all words of its text, as prefixes."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return ops.search_many(ops.build_index(_docs(spark, sf_dir)), queries, 10).select("query_id", "doc_id", "rank")


FIELDS = {"title": 3.0, "prose": 1.0, "norm": 2.0}


def x3_fields(spark, sf_dir):
    """The first words of each benchmark item, where a word in a document's first line counts three times, and one in its origin twice."""
    docs = _docs(spark, sf_dir).select("doc_id", F.split("text", "\n")[0].alias("title"), F.col("text").alias("prose"), F.concat_ws(" ", "lang", "source").alias("norm"))
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    queries = items.select(F.col("item_id").alias("query_id"), F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("query"))
    return ops.search_many(ops.build_field_index(docs, FIELDS), queries, 10).select("query_id", "doc_id", "rank")


def p10_findings(spark, sf_dir):
    return red.findings(red.redact(_docs(spark, sf_dir)), "source")


def p10_redacted(spark, sf_dir):
    return red.redact(_docs(spark, sf_dir)).select("doc_id", "text", F.to_json("findings").alias("findings"), "safe")


def _changed(redacted):
    return redacted.filter("size(findings) > 0").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), "safe")


def p10_text(spark, sf_dir):
    return _changed(red.redact(_docs(spark, sf_dir)))


def p11_quarantine(spark, sf_dir):
    """What of each source leaves the flow, and why. No text of the tables survives redaction unsafe, so the rules are cut to the
    last: what the others would have caught is then left over."""
    return red.with_reason(red.redact(_docs(spark, sf_dir), rules=red.RULES[-1:], verify=red.RULES)).select("doc_id", "reason")


def p12_scrub(spark, sf_dir):
    """Every string of a nested note: the text and its lines."""
    notes = _docs(spark, sf_dir).select("doc_id", F.struct(F.col("text").alias("summary"), F.split("text", "\n").alias("did")).alias("note"))
    out = red.scrub(notes)
    return out.select("doc_id", F.sha2(F.col("note.summary").cast("binary"), 256).alias("summary"), F.sha2(F.array_join("note.did", "\n").cast("binary"), 256).alias("did"))


QUERIES = {f.__name__: f for f in (x1_terms, x2_postings, x3_fields, x4_search, p10_findings, p10_redacted, p10_text, p11_quarantine, p12_scrub)}
QUERIES |= {"p10_findings_all": p10_findings, "p10_text_all": p10_text}

_FOLD = "lower(translate(regexp_replace(coalesce(text, ''), '[ؐ-ًؚ-ٰٟۖ-ۭـ]', '', 'g'), '{}', '{}'))"
_TERMS = """w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({fold}, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '')) AS word FROM documents),
t AS (SELECT doc_id, CASE WHEN length(word) > 4 AND starts_with(word, '{art}') THEN word[3:] ELSE word END AS term FROM w)"""


def _terms_sql() -> str:
    from ..functions.text import ARTICLE, FOLD_FROM, FOLD_TO

    return _TERMS.format(fold=_FOLD.format(FOLD_FROM, FOLD_TO), art=ARTICLE)


#: national-id without look-arounds: a run of digits and dots holds one exactly if it begins with nine digits that no digit and no
#: dot before a digit follows.
_RUNS = "regexp_extract_all({}, '[0-9.]+|[^0-9.]+')"
_HOLDS_ID = "regexp_full_match(x, '[0-9]{9}(\\.(\\.[0-9.]*)?)?')"


def _rule_sql(text: str, kind: str, pattern: str, any_case: bool, to: str) -> tuple[str, str]:
    """How often a rule matches, and what it leaves."""
    if kind == "national-id":
        runs = _RUNS.format(text)
        return f"len(list_filter({runs}, lambda x: {_HOLDS_ID}))", f"array_to_string(list_transform({runs}, lambda x: CASE WHEN {_HOLDS_ID} THEN '{to}' || x[10:] ELSE x END), '')"
    p = ("(?i)" if any_case else "") + pattern.replace("'", "''")
    return f"len(regexp_extract_all({text}, '{p}'))", f"regexp_replace({text}, '{p}', '{to.replace('$1', chr(92) + '1')}', 'g')"


def _steps(rules, text: str = "text") -> tuple[str, str]:
    """Each rule as a step: what it finds, then what it leaves."""
    steps = [f"r0 AS (SELECT doc_id, source, {text} AS t FROM documents)"]
    for at, rule in enumerate(rules):
        n, left = _rule_sql("t", *rule)
        steps.append(f"r{at + 1} AS (SELECT * EXCLUDE (t), {n} AS n{at}, {left} AS t FROM r{at})")
    return ", ".join(steps), f"r{len(rules)}"


def _left_sql(kind: str, pattern: str, any_case: bool) -> str:
    return f"regexp_matches(regexp_replace(t, '\\[REDACTED-[A-Z-]+\\]', '·', 'g'), '{('(?i)' if any_case else '') + pattern.replace(chr(39), chr(39) * 2)}')"


_STEPS, _LAST = _steps(red.RULES)
_COUNTS = " UNION ALL ".join(f"SELECT doc_id, source, '{r[0]}' AS kind, n{i} AS n FROM {_LAST} WHERE n{i} > 0" for i, r in enumerate(red.RULES))
_VERIFIED = [r for r in red.RULES if r[0] not in red.UNVERIFIED]
_UNSAFE = " OR ".join(_left_sql(*r[:3]) for r in _VERIFIED)
_FOUND = "list_filter([" + ", ".join(f"CASE WHEN n{i} > 0 THEN '{{\"kind\":\"{r[0]}\",\"count\":' || n{i} || '}}' END" for i, r in enumerate(red.RULES)) + "], lambda x: x IS NOT NULL)"
_CARDS, _CARDS_LAST = _steps(red.RULES[-1:])
_SURVIVORS = "list_filter([" + ", ".join(f"CASE WHEN {_left_sql(*r[:3])} THEN 'survived:{r[0]}' END" for r in _VERIFIED) + "], lambda x: x IS NOT NULL)"


def _scrubbed(text: str) -> str:
    for rule in red.RULES:
        text = _rule_sql(text, *rule)[1]
    return text


SQL = {
    "x1_terms": f"WITH {_terms_sql()}, p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM p GROUP BY 1",
    "x2_postings": f"WITH {_terms_sql()} SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2",
    "x3_fields": f"""WITH fd AS (SELECT doc_id, string_split(text, chr(10))[1] AS text, 3.0 AS weight FROM documents UNION ALL SELECT doc_id, text, 1.0 FROM documents UNION ALL SELECT doc_id, concat_ws(' ', lang, source), 2.0 FROM documents),
t AS (SELECT doc_id, weight, lower(unnest(list_filter(regexp_split_to_array(coalesce(text, ''), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))) AS term FROM fd),
p AS (SELECT doc_id, term, sum(CAST(weight AS DOUBLE)) AS tf FROM t GROUP BY 1, 2), lens AS (SELECT d.doc_id, count(term) AS len FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(list_filter(regexp_split_to_array(array_to_string(string_split(text, ' ')[1:6], ' '), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))) AS word FROM benchmark),
h AS (SELECT word, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT word FROM q) JOIN p ON starts_with(term, word) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM h GROUP BY 1), tot AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens),
s AS (SELECT word, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM h JOIN df USING (word) JOIN lens USING (doc_id), tot),
r AS (SELECT query_id, doc_id, round(sum(part), 3) AS score FROM q JOIN s USING (word) GROUP BY 1, 2)
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "x4_search": f"""WITH {_terms_sql()}, p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
lens AS (SELECT d.doc_id, count(term) AS len FROM documents d LEFT JOIN t USING (doc_id) GROUP BY 1),
q AS (SELECT DISTINCT item_id AS query_id, lower(unnest(list_filter(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))) AS word FROM benchmark),
h AS (SELECT word, doc_id, sum(tf) AS tf FROM (SELECT DISTINCT word FROM q) JOIN p ON starts_with(term, word) GROUP BY 1, 2),
df AS (SELECT word, count(*) AS df FROM h GROUP BY 1), tot AS (SELECT count(*) AS docs, avg(len) AS mean FROM lens),
s AS (SELECT word, doc_id, ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean)) AS part FROM h JOIN df USING (word) JOIN lens USING (doc_id), tot),
r AS (SELECT query_id, doc_id, round(sum(part), 3) AS score FROM q JOIN s USING (word) GROUP BY 1, 2)
SELECT query_id, doc_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM r) WHERE rank <= 10""",
    "p10_findings": f"WITH {_STEPS} SELECT source, kind, count(*) AS documents, CAST(sum(n) AS BIGINT) AS matches FROM ({_COUNTS}) GROUP BY 1, 2",
    "p10_text": f"WITH {_STEPS} SELECT doc_id, sha256(t) AS digest, NOT ({_UNSAFE}) AS safe FROM {_LAST} WHERE " + " OR ".join(f"n{i} > 0" for i in range(len(red.RULES))),
    "p10_redacted": f"WITH {_STEPS} SELECT doc_id, t AS text, '[' || array_to_string({_FOUND}, ',') || ']' AS findings, coalesce(NOT ({_UNSAFE}), true) AS safe FROM {_LAST}",
    "p11_quarantine": f"""WITH {_CARDS}, s AS (SELECT doc_id, {_SURVIVORS} AS left_over, n0 FROM {_CARDS_LAST})
SELECT doc_id, CASE WHEN len(left_over) > 0 THEN array_to_string(list_concat(CASE WHEN n0 > 0 THEN ['credit-card×' || n0] ELSE [] END, left_over), ', ') END AS reason FROM s""",
    "p12_scrub": f"SELECT doc_id, sha256({_scrubbed('text')}) AS summary, sha256(array_to_string(list_transform(string_split(text, chr(10)), lambda y: {_scrubbed('y')}), chr(10))) AS did FROM documents",
}
SQL |= {"p10_findings_all": SQL["p10_findings"], "p10_text_all": SQL["p10_text"]}
