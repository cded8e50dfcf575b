"""Repair of conversation structure by the cheapest edits, found by divide and conquer in linear space.

A conversation is legal if its role initials are an optional s and then pairs of u and a. As rows go by, four states tell what
may come next. What a row can do to a state is one of sixteen small tables, by the row's role initial, whether it has to go and whether it is
truncated, so a task keeps one byte a row of the conversation at hand.

Hirschberg's scheme: costs forward from the start and backward from the end, four numbers each, meet in the middle;
of the states where their sum is least the one is crossed whose left half has the ASCII-least audit; both halves are solved likewise. Edits
put in before a row belong to that row. Audits of different states therefore part before either ends, and a rank
beside each forward cost is all that comparing them takes.

1. Thin rows (digests in place of texts) are sorted by conversation and turn; a stream over them yields one row of counts and edits
   a conversation.
2. The rows themselves, sorted likewise behind their conversation's edits, are repaired as they stream by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import read, stored
from .exact_dedup import row_key

START, SYSTEM, USER, ASSISTANT = range(4)
#: The only steps from state to state, by role initial; a conversation may end in START or ASSISTANT.
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: The role that an inserted or renamed row gets in a state, and how many rows have to be inserted from it to end.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
TO_END = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED_COST = 5
#: Stretches up to this many rows are solved with the audits themselves at hand.
SHORT = 32
FAULTS = ("blank", "duplicate", "truncated")
WHITE = r"\x20\x09-\x0D"
LEGAL_PAIRS = ("su", "ua", "au")


def _inserted() -> list[list[int | None]]:
    """How many inserted rows lead from one state to another, at least."""
    out: list[list[int | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        state, k = p, 0
        while out[p][state] is None:
            out[p][state] = k
            state, k = STEPS[state, NEXT_ROLE[state][0]], k + 1
    return out


def row_table(initial: str, goes: bool, truncated: bool) -> list[list[tuple[int, str] | None]]:
    """For each state before and after a row: least cost and, among those, ASCII-least edits (inserts, then one edit of the row)."""
    inserted = _inserted()
    extra = TRUNCATED_COST * truncated
    out: list[list[tuple[int, str] | None]] = [[None] * 4 for _ in range(4)]
    for p in range(4):
        for r in range(4):
            if inserted[p][r] is None:
                continue
            ways = [(COST[DELETE], DELETE, r)]
            if not goes:
                if (r, initial) in STEPS:
                    ways.append((COST[KEEP] + extra, KEEP, STEPS[r, initial]))
                ways.append((COST[REROLE] + extra, REROLE, STEPS[r, NEXT_ROLE[r][0]]))
            for cost, letter, q in ways:
                found = inserted[p][r] * COST[INSERT] + cost, INSERT * inserted[p][r] + letter
                if out[p][q] is None or found < out[p][q]:
                    out[p][q] = found
    return out


INITIALS = "sua"
TABLES = [row_table((INITIALS + "?")[c & 3], bool(c & 4), bool(c & 8)) for c in range(16)]
#: The same as lists of (before, after, cost, edits).
MOVES = [[(p, q, *t[p][q]) for p in range(4) for q in range(4) if t[p][q]] for t in TABLES]


def forward(codes: bytes, lo: int, hi: int, start: int) -> dict[int, tuple[int, int]]:
    """state: (least cost, rank of its ASCII-least cheapest edits among those of the states) after rows lo to hi."""
    at = {start: (0, 0)}
    for code in codes[lo:hi]:
        best: dict[int, tuple[int, int, str]] = {}
        for p, q, cost, edits in MOVES[code]:
            if p in at:
                way = (at[p][0] + cost, at[p][1], edits)
                if q not in best or way < best[q]:
                    best[q] = way
        order = sorted(best, key=lambda q: best[q][1:])
        at = {q: (best[q][0], n) for n, q in enumerate(order)}
    return at


def backward(codes: bytes, lo: int, hi: int, end: int) -> dict[int, int]:
    """state: least cost of rows lo to hi from that state to the end state."""
    at = {end: 0}
    for code in reversed(codes[lo:hi]):
        before: dict[int, int] = {}
        for p, q, cost, _ in MOVES[code]:
            if q in at and cost + at[q] < before.get(p, 1 << 62):
                before[p] = cost + at[q]
        at = before
    return at


def _short(codes: bytes, lo: int, hi: int, start: int, end: int) -> str:
    at = {start: (0, "")}
    for code in codes[lo:hi]:
        after: dict[int, tuple[int, str]] = {}
        for p, q, cost, edits in MOVES[code]:
            if p in at:
                way = (at[p][0] + cost, at[p][1] + edits)
                if q not in after or way < after[q]:
                    after[q] = way
        at = after
    return at[end][1]


def _between(codes: bytes, lo: int, hi: int, start: int, end: int) -> Iterator[str]:
    if hi - lo <= SHORT:
        yield _short(codes, lo, hi, start, end)
        return
    mid = (lo + hi) // 2
    left, right = forward(codes, lo, mid, start), backward(codes, mid, hi, end)
    _, _, cross = min((left[q][0] + right[q], left[q][1], q) for q in left if q in right)
    yield from _between(codes, lo, mid, start, cross)
    yield from _between(codes, mid, hi, cross, end)


def cheapest(codes: bytes) -> tuple[int, str]:
    """Least cost of making the rows legal, and the ASCII-least of the cheapest edits."""
    ends = forward(codes, 0, len(codes), START)
    cost, _, end = min((c + COST[INSERT] * TO_END[q], rank, q) for q, (c, rank) in ends.items())
    return cost, "".join(_between(codes, 0, len(codes), START, end)) + INSERT * TO_END[end]


class _Seen:
    """What has been read of one conversation."""

    def __init__(self, key: str, conv):
        self.key, self.conv, self.codes = key, conv, bytearray()
        self.faults, self.illegal, self.before = dict.fromkeys(FAULTS, 0), 0, None
        self.first = self.last = None
        self.turns = 0

    def add(self, turn, initial: str, fault: str | None) -> None:
        if fault:
            self.faults[fault] += 1
        self.codes.append((INITIALS.index(initial) if initial and initial in INITIALS else 3) | 4 * (fault in FAULTS[:2]) | 8 * (fault == FAULTS[2]))
        self.illegal += self.before is not None and self.before + initial not in LEGAL_PAIRS
        self.before = initial
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last, self.turns = turn, self.turns + 1

    def row(self) -> dict:
        cost, audit = cheapest(bytes(self.codes))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"k": self.key, "conv_id": self.conv, "gaps": gaps, **self.faults, "illegal": self.illegal, "cost": cost, "audit": audit}


_COUNTS = ("gaps", *FAULTS, "illegal", "cost")
_EDITS = "k string, conv_id {}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _ordered(rows: DataFrame) -> DataFrame:
    """k, conv_id, turn, role, text, digest: null roles and texts are one space. The order within a conversation is turn (nulls first), role, digest."""
    return rows.select(
        row_key("conv_id").alias("k"), "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))


def find_edits(rows: DataFrame) -> DataFrame:
    """rows: conv_id, turn, role, text. One row a conversation: k (a key that tells null from every id), conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    Null ids are one conversation. A row is blank if it has nothing but ASCII white space, else a duplicate if its role and text were there
    before, else truncated if it does not end in a full stop, exclamation or question mark. A role that is empty, or begins with none of s, u, a, is
    never kept as it is. Rows of one turn go by role and digest; very long texts stay where they are (only digests move); an empty table
    gives no rows; other columns are not read."""
    tail = F.right(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    thin = _ordered(rows).select(
        "k", "conv_id", "turn", "role", "digest", F.left("role", F.lit(1)).alias("initial"),
        F.when(~F.col("text").rlike(f"[^{WHITE}]"), "blank").when(~tail.isin(".", "!", "?"), "truncated").alias("fault"),
    ).repartition("k")
    again = F.row_number().over(Window.partitionBy("k", "role", "digest").orderBy("turn")) > 1
    thin = thin.withColumn("fault", F.when(again & ~F.coalesce(F.col("fault") == "blank", F.lit(False)), "duplicate").otherwise(F.col("fault")))
    schema = _EDITS.format(rows.schema["conv_id"].dataType.simpleString())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: _Seen | None = None
        for batch in batches:
            found = []
            for k, conv, turn, initial, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if seen is None or k != seen.key:
                    if seen:
                        found.append(seen.row())
                    seen = _Seen(k, conv)
                seen.add(turn, initial, fault)
            if found:
                yield _batch(found, batch.schema.field("conv_id").type)
        if seen:
            yield _batch([seen.row()], batch.schema.field("conv_id").type)

    def _batch(found: list[dict], kind: pa.DataType) -> pa.RecordBatch:
        fields = [("k", pa.string()), ("conv_id", kind), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string())]
        return pa.RecordBatch.from_pylist(found, schema=pa.schema(fields))

    dealt = thin.sortWithinPartitions("k", "turn", "role", "digest")
    return dealt.select("k", "conv_id", "turn", "initial", "fault").mapInArrow(run, schema)


def repaired_turns(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The rows with the edits of find_edits carried out: k, place (0, 1, ...), turn (null if inserted), role, text, edit. The rows of a conversation
    lie in one partition, in order; a conversation of which nothing is left has none."""
    nothing = F.lit(None)
    told = edits.select("k", F.lit(0).alias("kind"), nothing.cast("long").alias("turn"), nothing.cast("string").alias("role"), F.col("audit").alias("text"), nothing.cast("string").alias("digest"))
    all_ = _ordered(rows).select("k", F.lit(1).alias("kind"), "turn", "role", "text", "digest").unionByName(told)
    names = ["k", "place", "turn", "role", "text", "edit"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, audit, at, state, place = None, "", 0, START, 0
        out: list[tuple] = []

        def put(turn, role: str, text: str, edit: str) -> None:
            nonlocal state, place
            state = STEPS[state, role[:1]]
            out.append((key, place, turn, role, text, edit))
            place += 1

        def inserts() -> None:
            nonlocal at
            while audit[at : at + 1] == INSERT:
                put(None, NEXT_ROLE[state], "", INSERT)
                at += 1

        def flushed() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            made = pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names)
            out.clear()
            return made

        for batch in batches:
            for k, kind, turn, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    inserts()
                    key, audit, at, state, place = k, text, 0, START, 0
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != DELETE:
                    put(turn, NEXT_ROLE[state] if edit == REROLE else role, text, edit)
            yield flushed()
        inserts()
        yield flushed()

    dealt = all_.repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "digest")
    return dealt.select("k", "kind", "turn", "role", "text").mapInArrow(run, "k string, place long, turn long, role string, text string, edit string")


def digests(repaired: DataFrame) -> DataFrame:
    """k, sha: SHA-256 of each conversation's role:text lines, as repaired_turns gives them; nothing is shuffled or held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = held = None
        for batch in batches:
            done = []
            for k, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != key:
                    if held:
                        done.append((key, held.hexdigest()))
                    key, held = k, hashlib.sha256()
                else:
                    held.update(b"\n")
                held.update(f"{role}:{text}".encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], pa.string()) for i in (0, 1)], ["k", "sha"])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([held.hexdigest()])], ["k", "sha"])

    return repaired.select("k", "role", "text").mapInArrow(run, "k string, sha string")


def damaged(rows: DataFrame) -> DataFrame:
    """What op12 repairs: by the checksum of conversation and turn a row is dropped, emptied, freed of marks, repeated or given to the user."""
    space = F.lit(" ")
    how = F.crc32(F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), space), F.coalesce(F.col("turn").cast("string"), space)).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), how.alias("how")).filter("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": text, "role": F.when(F.col("how") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.when(F.col("how") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("how", "copy")


def op12_structure_repair(spark, sf_dir: str) -> DataFrame:
    table = read(spark, sf_dir, "conversations")
    rows = damaged(table)
    edits = stored(find_edits(rows))
    shas = stored(digests(repaired_turns(rows, edits)))
    every = table.select(row_key("conv_id").alias("k"), F.col("conv_id").alias("id")).distinct()
    out = every.join(edits.drop("conv_id").hint("shuffle_merge"), "k", "left").join(shas.hint("shuffle_merge"), "k", "left")
    none = hashlib.sha256(b"").hexdigest()
    return out.select(F.col("id").alias("conv_id"), *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in _COUNTS), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(none)).alias("repaired_sha256"))


OP12_SQL = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END)) AS t
), o AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id FROM conversations
), h AS (
  SELECT o.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(id, ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[CAST(xor(c, b) % 256 AS INTEGER) + 1], c // 256)), 4294967295) % 20 AS how FROM o, crc
), d AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role, CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE how WHEN 3 THEN [1, 2] ELSE [1] END) FROM h WHERE how <> 0)
), n AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM d
), f AS (
  SELECT *, left(role, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE 'fine' END AS fault FROM n
), step(p, ch, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
ins(p, r, k) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (0, 3, 2), (1, 2, 1), (1, 3, 2), (2, 3, 1), (3, 2, 1)),
dp AS (
  SELECT DISTINCT c, CAST(0 AS BIGINT) AS i, 0 AS st, CAST(0 AS BIGINT) AS cost, '' AS audit, [] :: VARCHAR[] AS outs FROM n
  UNION ALL
  SELECT c, i, st, cost, audit, outs FROM (
    SELECT dp.c, f.i, w.st, dp.cost + 5 * ins.k + w.cost AS cost, dp.audit || repeat('I', ins.k) || w.letter AS audit,
      list_concat(dp.outs, CASE WHEN ins.k = 0 THEN [] WHEN ins.p IN (0, 1) AND ins.k = 1 THEN ['user:'] WHEN ins.k = 2 THEN ['user:', 'assistant:'] WHEN ins.p = 2 THEN ['assistant:'] ELSE ['user:'] END, w.added) AS outs,
      row_number() OVER (PARTITION BY dp.c, w.st ORDER BY dp.cost + 5 * ins.k + w.cost, dp.audit || repeat('I', ins.k) || w.letter) AS nth
    FROM dp JOIN f ON f.c = dp.c AND f.i = dp.i + 1 JOIN ins ON ins.p = dp.st, LATERAL (
      SELECT ins.r AS st, 2 AS cost, 'D' AS letter, [] :: VARCHAR[] AS added
      UNION ALL SELECT s.q, CASE f.fault WHEN 'truncated' THEN 5 ELSE 0 END, 'K', [f.role || ':' || f.text] FROM step s WHERE s.p = ins.r AND s.ch = f.ini AND f.fault NOT IN ('blank', 'duplicate')
      UNION ALL SELECT s.q, CASE f.fault WHEN 'truncated' THEN 6 ELSE 1 END, 'R', [CASE s.ch WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || f.text] FROM step s WHERE s.p = ins.r AND s.ch <> 's' AND f.fault NOT IN ('blank', 'duplicate')
    ) w
  ) WHERE nth = 1
), e AS (
  SELECT c, cost + CASE st WHEN 1 THEN 10 WHEN 2 THEN 5 ELSE 0 END AS cost, audit || CASE st WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END AS audit,
    list_concat(outs, CASE st WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE [] END) AS outs
  FROM dp WHERE i = (SELECT max(f.i) FROM f WHERE f.c = dp.c)
), best AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY c ORDER BY cost, audit) = 1),
s AS (
  SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated
  FROM f GROUP BY c
), l AS (SELECT c, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM (SELECT c, lag(ini) OVER (PARTITION BY c ORDER BY i) || ini AS pair FROM f) GROUP BY c)
SELECT a.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(outs, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM a.conv_id LEFT JOIN l ON l.c = s.c LEFT JOIN best ON best.c = s.c
"""
