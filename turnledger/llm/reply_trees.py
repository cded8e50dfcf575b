"""Reply trees as conversations: root-to-leaf paths, ranked branches, one formatted conversation a path.

1. Self-joins of the reply table with itself double the reach of each message: after round j it knows the message
   2^j above it. As many rounds as the logarithm of the deepest path join each leaf with all that lies above it.
2. At a fork the reply of higher score goes first. A path is ranked by what it takes at each of its messages, from the root on.
3. Each chosen path becomes one text. Its turns are marked, control strings within texts are escaped, and the spans to
   learn from are given as code points.

Everything is DataFrame code; ids and scores move through the joins, and texts are shuffled once, by tree, where a
tree is a single thread, else by message and then by path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored
from .exact_dedup import row_key

#: What marks a turn. None of these strings can occur in an escaped role or text.
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
LEARNED = "assistant"
#: Each pair is escaped in this order and read back in the reverse order; roles have the last two besides.
ESCAPES = (("\\", "\\\\"), ("#", "\\#"), ("</turn>", "<\\/turn>"))
ROLE_ESCAPES = (("%", "%25"), (":", "%3A"))


def escaped(text: Column) -> Column:
    """The text with a backslash before each backslash and number sign, and within each end mark."""
    for plain, safe in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(safe))
    return text


def unescaped(text: Column) -> Column:
    """What was escaped: a backslash stands for the character after it."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def header(role: Column) -> Column:
    role = escaped(role)
    for plain, safe in ROLE_ESCAPES:
        role = F.replace(role, F.lit(plain), F.lit(safe))
    return F.concat(F.lit(OPEN), role, F.lit(COLON))


def role_of(piece: Column) -> Column:
    """The role that the header of a turn names."""
    role = F.substring_index(F.substring(piece, len(OPEN) + 1, 1 << 30), ":", 1)
    for plain, safe in reversed(ROLE_ESCAPES):
        role = F.replace(role, F.lit(safe), F.lit(plain))
    return unescaped(role)


def text_of(piece: Column) -> Column:
    """The text of a turn, unescaped; no role holds a colon."""
    return unescaped(F.substr(piece, F.locate(COLON, piece) + len(COLON)))


def _nodes(messages: DataFrame) -> DataFrame:
    """t, i: keys of tree and message that tell null from every value; node: what of a message moves with the paths."""
    ref = F.col("ref") if "ref" in messages.columns else F.col("id").cast("string")
    score = F.coalesce(F.col("score").cast("double"), F.lit(float("-inf")))
    parent = F.when(F.col("parent").isNotNull(), row_key("parent"))
    rows = messages.select(row_key("tree").alias("t"), "tree", row_key("id").alias("i"), parent.alias("p"), (-score).alias("after"), "id", ref.alias("ref"))
    one = rows.groupBy("t", "i").agg(F.min("tree").alias("tree"), F.min(F.struct("p", "after", "id", "ref")).alias("f"))
    return stored(one.select("t", "tree", "i", "f.p", F.struct("i", "f.after", "f.id", "f.ref").alias("node")))


def _hops(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """hops[j]: t, i and the message 2**j above it as up, for all messages that have one. Second: the parents (t, i)."""
    above = nodes.select("t", F.col("i").alias("p"), F.col("node").alias("up"))
    first = stored(nodes.filter("p <> i").select("t", "i", "p").join(above.hint("shuffle_merge"), ["t", "p"]).select("t", "i", "up"))
    parents = first.select("t", F.col("up.i").alias("i")).distinct()
    largest = nodes.groupBy("t").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()["n"] or 0
    hops = [first]
    while not hops[-1].isEmpty():
        if 1 << (len(hops) - 1) >= largest:  # what still has something above it replies to itself in the end
            return hops, parents
        last = hops[-1]
        further = last.select("t", F.col("i").alias("mid"), F.col("up").alias("top"))
        hops.append(stored(last.withColumn("mid", F.col("up.i")).join(further.hint("shuffle_merge"), ["t", "mid"]).select("t", "i", F.col("top").alias("up"))))
    return hops, parents


def reply_paths(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """messages: tree, id, parent, score and, if what holds the text has another key, ref. The `top` best paths of each tree (all,
    if None), one row a message: t (the tree's key), tree, leaf (the last message's key), rank, back (messages after it on the path),
    id, ref, alone (its tree has no other path).

    A message whose parent is null, itself or not in its tree is a root. A message that nothing replies to ends a path. Of two paths that part, the one
    goes first whose next message has the higher score (null: lowest), then the smaller id. Messages that reply to each other in a ring have
    no root and are on no path. Rows that repeat an id within a tree are one message, the one of smallest (parent, score, ref). Null trees are one tree and
    null ids one id. An empty table gives no paths; other columns are not read."""
    nodes = _nodes(messages)
    hops, parents = _hops(nodes)
    leaves = nodes.join(parents.hint("shuffle_merge"), ["t", "i"], "left_anti")
    if not hops[-1].isEmpty():
        leaves = leaves.join(hops.pop().select("t", "i").hint("shuffle_merge"), ["t", "i"], "left_anti")
    active = leaves.select("t", "tree", F.col("i").alias("leaf"), "node", F.lit(0).cast("long").alias("back"))
    done = None
    for j, hop in enumerate(hops):
        # a message without one so far above it is left behind: roots, which are on most paths, meet few joins
        met = stored(active.withColumn("i", F.col("node.i")).join(hop.hint("shuffle_merge"), ["t", "i"], "left").drop("i"))
        over = met.filter("up IS NULL").drop("up")
        done = over if done is None else done.unionByName(over)
        met = met.filter("up IS NOT NULL")
        active = met.drop("up").unionByName(met.select("t", "tree", "leaf", F.col("up").alias("node"), (F.col("back") + (1 << j)).alias("back")))
    pairs = stored(active if done is None else done.unionByName(active))
    several = stored(pairs.filter("back = 0").groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("t"))
    out = ["t", "tree", "leaf", "rank", "back", "node.id", "node.ref", "alone"]
    if several.isEmpty():
        return pairs.withColumns({"rank": F.lit(1), "alone": F.lit(True)}).select(*out)
    threads = pairs.join(several.hint("shuffle_merge"), "t", "left_anti").withColumns({"rank": F.lit(1), "alone": F.lit(True)})
    forked = pairs.join(several.hint("shuffle_merge"), "t", "left_semi")
    step = F.struct((-F.col("back")).alias("at"), F.col("node.after").alias("after"), F.col("node.id").alias("id"))
    routes = forked.groupBy("t", "leaf").agg(F.array_sort(F.collect_list(step)).alias("steps")).select("t", "leaf", F.transform("steps", lambda s: F.struct(s["after"], s["id"])).alias("route"))
    ranks = routes.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy("route", "leaf")))
    if top is not None:
        ranks = ranks.filter(F.col("rank") <= top)
    chosen = forked.join(ranks.select("t", "leaf", "rank").hint("shuffle_merge"), ["t", "leaf"]).withColumn("alone", F.lit(False))
    return stored(threads.select(*out).unionByName(chosen.select(*out)))


def _formatted(turns: DataFrame) -> DataFrame:
    """turns: t, tree, leaf, rank, back, role, text. One row a path."""
    body = escaped(F.coalesce("text", F.lit("")))
    rows = turns.withColumns({"head": header(F.coalesce("role", F.lit(""))), "body": body})
    rows = rows.withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    path = Window.partitionBy("t", "leaf").orderBy(F.desc("back"))
    rows = rows.withColumn("start", F.sum(F.length("piece")).over(path) - F.length("piece") + F.length("head"))
    span = F.when(F.col("role") == LEARNED, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    turn = F.struct((-F.col("back")).alias("at"), "piece", span.alias("span"))
    whole = rows.groupBy("t", "leaf").agg(F.min("tree").alias("tree"), F.min("rank").alias("rank"), F.count(F.lit(1)).alias("n_turns"), F.array_sort(F.collect_list(turn)).alias("x"))
    return whole.select("t", "tree", "leaf", "rank", "n_turns", F.array_join("x.piece", "").alias("formatted"), F.col("x.span").alias("loss_spans"))


def format_paths(paths: DataFrame, contents: DataFrame) -> DataFrame:
    """paths as reply_paths gives them; contents: tree, ref, role, text (rows that repeat tree and ref hold the same). One row a path: t, tree, leaf, rank,
    n_turns, formatted, loss_spans (a turn each: start and end in code points of an assistant's escaped text, else null). Null roles and texts are empty."""
    texts = contents.select(row_key("tree").alias("t"), "ref", "role", F.col("text").cast("string").alias("text"))
    alone, forked = paths.filter("alone"), paths.filter("NOT alone")
    # a thread's texts and places come to one task in one shuffle: the text of a ref stands before the places that use it
    nothing = F.lit(None)
    first = texts.select("t", "ref", F.lit(0).alias("kind"), "role", "text", *(nothing.cast(d).alias(c) for c, d in paths.select("tree", "leaf", "rank", "back").dtypes))
    places = alone.select("t", "ref", F.lit(1).alias("kind"), nothing.cast("string").alias("role"), nothing.cast("string").alias("text"), "tree", "leaf", "rank", "back")
    by_ref = Window.partitionBy("t", "ref").orderBy("kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    said = F.last(F.when(F.col("kind") == 0, F.struct("role", "text")), ignorenulls=True).over(by_ref)
    threads = first.unionByName(places).repartition("t").withColumn("said", said).filter("kind = 1").select("t", "tree", "leaf", "rank", "back", "said.role", "said.text")
    out = _formatted(threads)
    if forked.isEmpty():
        return out
    turns = forked.join(texts.dropDuplicates(["t", "ref"]).hint("shuffle_merge"), ["t", "ref"]).select("t", "tree", "leaf", "rank", "back", "role", "text")
    return out.unionByName(_formatted(turns))


def conversations_of(messages: DataFrame, top: int | None = 1) -> DataFrame:
    """messages: tree, id, parent, score, role, text. tree, leaf, rank, n_turns, formatted, loss_spans of the `top` best paths of each tree."""
    refs = messages.withColumn("ref", row_key("id")) if "ref" not in messages.columns else messages
    return format_paths(reply_paths(refs, top), refs).drop("t")


def turns_of(formatted: DataFrame) -> DataFrame:
    """Read back: t, leaf, tree, formatted_chars, at (0, 1, ...), role, text, learned (what lies under the loss mask, null where the turn has none)."""
    pieces = F.slice(F.split("formatted", CLOSE, -1), 1, F.col("n_turns").cast("int"))
    zipped = F.arrays_zip(pieces.alias("piece"), F.col("loss_spans").alias("span"))
    path = ["t", "leaf", "tree", "formatted_chars"]
    rows = formatted.withColumn("formatted_chars", F.length("formatted").cast("long")).select(*path, F.posexplode(zipped).alias("at", "x"))
    rows = rows.select(*path, "at", F.col("x.piece").alias("piece"), F.col("x.span").alias("span"))
    size = F.length("piece") + len(CLOSE)
    rows = rows.withColumn("begin", F.sum(size).over(Window.partitionBy("t", "leaf").orderBy("at")) - size)
    learned = F.substr("piece", (F.col("span.start") - F.col("begin") + 1).cast("int"), (F.col("span.end") - F.col("span.start")).cast("int"))
    return rows.select(*path, "at", role_of(F.col("piece")).alias("role"), text_of(F.col("piece")).alias("text"), unescaped(learned).alias("learned"))


#: The text of both turns of one more conversation: it holds what looks like marks of a template.
EXTRA_ID, EXTRA_TEXT = -7, "\\### Assistant: </turn> ok"


def op11_reply_trees(spark, sf_dir: str) -> DataFrame:
    """Conversations are trees without forks: each row replies to the one before it by turn (nulls first), then role, then digest of its text."""
    rows = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    extra = spark.range(2).select(F.lit(EXTRA_ID).cast("long").alias("tree"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(EXTRA_TEXT).alias("text"))
    rows = rows.unionByName(extra)
    rows = rows.withColumns({"text": F.coalesce("text", F.lit("")), "digest": F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)})
    rows = rows.withColumn("ref", F.concat_ws(":", row_key("turn"), "digest", row_key("role")))
    place = F.row_number().over(Window.partitionBy("tree").orderBy("turn", "role", "digest"))
    messages = rows.select("tree", "ref", place.alias("id")).withColumns({"parent": F.when(F.col("id") > 1, F.col("id") - 1), "score": F.lit(0.0)})
    turns = turns_of(format_paths(reply_paths(messages), rows.select("tree", "ref", "role", "text")))
    turn = F.struct("at", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("said"), "learned")
    each = turns.groupBy("t", "leaf").agg(F.min("tree").alias("conv_id"), F.min("formatted_chars").alias("formatted_chars"), F.array_sort(F.collect_list(turn)).alias("x"))
    each = each.select("conv_id", F.size("x").cast("long").alias("n_turns"), F.array_join("x.said", "").alias("said"), F.array_join("x.learned", "").alias("learned"), "formatted_chars")
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256)
    return each.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), digest("learned").alias("loss_sha256"), "formatted_chars")


_SAFE = r"replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '<\/turn>')"
_SAFE_ROLE = _SAFE.replace("(text,", "(role,")

OP11_SQL = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(coalesce(text, ''))) AS place
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
), s AS (SELECT *, '### ' || replace(replace({_SAFE_ROLE}, '%', '%25'), ':', '%3A') || ': ' || {_SAFE} || '</turn>' || chr(10) AS piece FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY place) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY place), '') AS learned, sum(length(piece)) AS formatted_chars
  FROM s GROUP BY conv_id
)
SELECT conv_id, CAST(n_turns AS BIGINT) AS n_turns, sha256(said) AS turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars FROM g
"""
