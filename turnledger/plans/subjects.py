"""Subjects over the parts table: brands are what memory knows, other spellings and part names are what a new reading says."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import subjects as ops

_FOLDERS = (("proj0", "acme-server"), ("proj1", "Acme_Server"), ("proj2", "docs"), ("proj3", "acme client"))


def parts(spark, sf_dir):
    """A claim for each part: its subject is spelled in eight ways, its kind is a tool or a person for one part in five each."""
    n, name = F.col("p_partkey"), F.split("p_name", " ")
    adjective, noun = F.initcap(name[0]), F.initcap(name[1])
    subject = (
        F.when(n % 8 == 0, F.col("p_brand")).when(n % 8 == 1, F.concat(F.lit("src/"), "p_brand")).when(n % 8 == 2, F.concat(adjective, noun)).when(n % 8 == 3, F.concat(F.lit("AB-"), (n % 100).cast("string")))
        .when(n % 8 == 4, F.lower("p_brand")).when(n % 8 == 5, F.concat(name[1], F.lit(".yaml"))).when(n % 8 == 6, F.lit("acme_server")).otherwise(F.concat(F.lit("item #"), (n % 50).cast("string")))
    )
    kind = F.when(n % 5 == 0, "tool").when(n % 5 == 1, "person").otherwise("term")
    key = F.when(n % 3 == 0, F.concat(F.lit("Arch."), name[1], F.lit("State"))).otherwise(F.concat(name[1], F.lit("_"), name[0]))
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(
        n.cast("string").alias("session_id"), F.lit(0).cast("long").alias("ord"), subject.alias("subject"), kind.alias("subject_kind"), F.concat(F.lit("proj"), (F.col("p_size") % 5).cast("string")).alias("project"),
        key.alias("key"), F.concat("p_name", F.lit(" is "), F.lower("p_type")).alias("claim"), F.when(n % 2 == 0, 1.0).otherwise(0.9).alias("confidence"), n.alias("n"), "p_size", "p_brand",
    )


def _folders(spark):
    return spark.createDataFrame(list(_FOLDERS), "project string, folder string")


def p13_guard(spark, sf_dir):
    rows = ops.classify_subjects(parts(spark, sf_dir), _folders(spark))
    return rows.select("session_id", "subject", "why")


def p14_anchor(spark, sf_dir):
    """Brands of small parts are known, oldest part first."""
    said = parts(spark, sf_dir)
    known = said.filter("p_size < 25").groupBy(F.col("p_brand").alias("subject")).agg(F.min("n").alias("first_seen"))
    return ops.anchor(said, known, _folders(spark)).select("session_id", "to_subject", "to_kind", "to_key", "why")


def p16_moves(spark, sf_dir):
    """One slot of every fourth brand was moved, that of every eighth once more; the ledger spells them in other ways."""
    said = parts(spark, sf_dir).select("session_id", F.regexp_replace("p_brand", "#", "-").alias("subject"), F.concat(F.lit("k"), (F.col("n") % 4).cast("string")).alias("key"))
    brands = said.select("subject").distinct().withColumn("b", F.regexp_extract("subject", "[0-9]+", 0).cast("long"))
    moves = brands.filter("b % 4 = 1").select(F.col("b").alias("ord"), F.upper("subject").alias("subject"), F.lit("k1").alias("key"), F.concat(F.lit("brand_"), F.col("b").cast("string")).alias("to_subject"), F.lit("moved").alias("to_key"))
    again = brands.filter("b % 8 = 1").select((F.col("b") + 100).alias("ord"), F.concat(F.lit("Brand "), F.col("b").cast("string")).alias("subject"), F.lit("moved").alias("key"), F.lit("store").alias("to_subject"), F.concat(F.lit("of-"), F.col("b").cast("string")).alias("to_key"))
    return ops.apply_moves(said, moves.unionByName(again)).select("session_id", "subject", "key", "to_subject", "to_key")


def p17_carried(spark, sf_dir):
    """Readings again of every brand: the claims of even parts were confirmed, every third is said again in other words."""
    old = parts(spark, sf_dir).withColumns({"session_id": F.col("p_brand"), "subject": F.lit("x")})
    new = old.filter("n % 3 > 0").withColumns({"claim": F.when(F.col("n") % 3 == 1, F.concat(F.lit("the "), "claim", F.lit(" indeed"))).otherwise(F.lit("something else")), "confidence": F.lit(0.9)})
    return ops.carry_confirmed(old, new).groupBy("session_id", "claim", "carried").agg(F.count(F.lit(1)).alias("rows"))


def _facts(spark, sf_dir):
    said = parts(spark, sf_dir)
    return said.select("subject", "subject_kind", "key", "claim", "confidence", "session_id", F.col("n").alias("seq"), F.lit("d").alias("created_at"), F.lit(None).cast("string").alias("superseded_at"), F.when(F.col("n") % 7 == 0, "d").alias("retracted_at")), said.select("session_id", "project")


def j8_rejected(spark, sf_dir):
    return ops.rejected_subjects(*_facts(spark, sf_dir), _folders(spark))


def j8_undefined(spark, sf_dir):
    """Of the brands the first has a definition, the second an empty one."""
    return ops.undefined_tools(*_facts(spark, sf_dir), spark.createDataFrame([("Brand#1", "what it is"), ("Brand#2", " ")], "subject string, definition string"))


QUERIES = {f.__name__: f for f in (p13_guard, p14_anchor, p16_moves, p17_carried, j8_rejected, j8_undefined)}

_P = """pt AS (SELECT *, string_split(p_name, ' ')[1] AS adj, string_split(p_name, ' ')[2] AS noun FROM part),
s AS (SELECT CAST(p_partkey AS VARCHAR) AS session_id, p_partkey AS n, p_size, p_brand, 'proj' || (p_size % 5) AS project,
  CASE p_partkey % 8 WHEN 0 THEN p_brand WHEN 1 THEN 'src/' || p_brand WHEN 2 THEN upper(adj[1]) || adj[2:] || upper(noun[1]) || noun[2:] WHEN 3 THEN 'AB-' || (p_partkey % 100)
    WHEN 4 THEN lower(p_brand) WHEN 5 THEN noun || '.yaml' WHEN 6 THEN 'acme_server' ELSE 'item #' || (p_partkey % 50) END AS subject,
  CASE p_partkey % 5 WHEN 0 THEN 'tool' WHEN 1 THEN 'person' ELSE 'term' END AS subject_kind,
  CASE WHEN p_partkey % 3 = 0 THEN 'Arch.' || noun || 'State' ELSE noun || '_' || adj END AS key, p_name || ' is ' || lower(p_type) AS claim,
  CAST(CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS confidence FROM pt)"""
_FORM = "regexp_replace(lower(trim({})), '[\\s_-]+', '', 'g')"
_WHY = """CASE WHEN regexp_matches(subject, '[/\\\\]') THEN 'file' WHEN subject_kind IN ('tool', 'person') THEN NULL
  WHEN regexp_matches(subject, '\\b[A-Za-z]{1,6}\\d{0,3}-\\d{1,5}\\b') OR regexp_matches(subject, '(^|\\s)#\\d+\\b') THEN 'ticket' WHEN contains(subject, '.') THEN 'file'
  WHEN regexp_matches(subject, '^[A-Z][A-Za-z0-9]*$') AND regexp_matches(subject, '[a-z]') AND regexp_matches(subject, '^.[^A-Z]*[A-Z]') THEN 'class'
  WHEN (project, """ + _FORM.format("subject") + ") IN (" + ", ".join(f"('{p}', '{f.lower().replace(' ', '').replace('-', '').replace('_', '')}')" for p, f in _FOLDERS) + ") THEN 'folder' END"
_WORDS = "list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace({}, '([a-z0-9])([A-Z])', '\\1-\\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1-\\2', 'g')), '[^a-z0-9]+'), lambda x: x <> '')"
_J8 = f"WITH {_P}, lf AS (SELECT * FROM s WHERE n % 7 > 0 AND subject <> project)"

SQL = {
    "p13_guard": f"WITH {_P} SELECT session_id, subject, {_WHY} AS why FROM s",
    "p14_anchor": f"""WITH {_P}, known AS (SELECT p_brand AS ks, min(n) AS seen FROM s WHERE p_size < 25 GROUP BY 1), oldest AS (SELECT {_FORM.format("ks")} AS kf, arg_min(ks, (seen, ks)) AS old FROM known GROUP BY 1),
w AS (SELECT s.*, old, CASE WHEN subject = project OR subject IN (SELECT ks FROM known) THEN NULL WHEN old IS NOT NULL THEN 'spelling' ELSE {_WHY} END AS why FROM s LEFT JOIN oldest ON kf = {_FORM.format("subject")}),
x AS (SELECT *, CASE WHEN instr(key, '.') > 1 THEN lower(string_split(key, '.')[1]) ELSE 'misc' END AS prefix, CASE WHEN instr(key, '.') > 1 THEN key[instr(key, '.') + 1:] ELSE key END AS rest FROM w),
y AS (SELECT *, list_concat(list_filter({_WORDS.format("subject")}, lambda a: NOT list_contains(list_concat({_WORDS.format("project")}, [prefix]), a)), {_WORDS.format("rest")}) AS ws FROM x)
SELECT session_id, CASE WHEN why = 'spelling' THEN old WHEN why IS NOT NULL THEN project ELSE subject END AS to_subject, CASE WHEN why <> 'spelling' THEN 'project' ELSE subject_kind END AS to_kind,
  CASE WHEN why <> 'spelling' THEN prefix || '.' || CASE WHEN len(ws) > 0 THEN array_to_string(list_filter(ws, lambda a, i: list_position(ws, a) = i), '-') ELSE 'part' END ELSE key END AS to_key, why FROM y""",
    "p16_moves": """WITH s AS (SELECT CAST(p_partkey AS VARCHAR) AS session_id, replace(p_brand, '#', '-') AS subject, 'k' || (p_partkey % 4) AS key, CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) AS b FROM part)
SELECT session_id, subject, key, CASE WHEN key <> 'k1' OR b % 4 <> 1 THEN subject WHEN b % 8 = 1 THEN 'store' ELSE 'brand_' || b END AS to_subject,
  CASE WHEN key <> 'k1' OR b % 4 <> 1 THEN key WHEN b % 8 = 1 THEN 'of-' || b ELSE 'moved' END AS to_key FROM s""",
    "p17_carried": f"""WITH {_P}, o AS (SELECT p_brand AS session_id, claim, confidence, n FROM s), nw AS (SELECT session_id, CASE WHEN n % 3 = 1 THEN 'the ' || claim || ' indeed' ELSE 'something else' END AS claim FROM o WHERE n % 3 > 0),
c AS (SELECT session_id, claim, true AS carried FROM o WHERE confidence >= 1 AND NOT EXISTS (SELECT 1 FROM nw WHERE nw.session_id = o.session_id AND (nw.claim = o.claim OR (length(nw.claim) > 12 AND length(o.claim) > 12 AND (contains(nw.claim, o.claim) OR contains(o.claim, nw.claim)))))
  UNION ALL SELECT session_id, claim, false FROM nw)
SELECT session_id, claim, carried, count(*) AS rows FROM c GROUP BY 1, 2, 3""",
    "j8_rejected": _J8 + f", g AS (SELECT subject, project, arg_min(subject_kind, n) AS subject_kind, count(*) AS facts FROM lf GROUP BY 1, 2), h AS (SELECT *, {_WHY} AS why FROM g) SELECT subject, subject_kind, project, facts, why FROM h WHERE why IS NOT NULL",
    "j8_undefined": _J8 + " SELECT subject, count(*) AS facts, string_agg(DISTINCT project, ',' ORDER BY project) AS projects FROM lf WHERE subject_kind = 'tool' AND subject <> 'Brand#1' AND NOT regexp_matches(subject, '[/\\\\]') GROUP BY 1",
}
