"""The cheapest edits against all edits and against a plain table of audits; the query against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from turnledger.llm import structure_repair as repair

LEGAL = re.compile(r"(s?(ua)+)?")


def every_edit(rows):
    """(cost, audit) of all edits of up to two inserts before each row and at the end; rows: (initial, goes, truncated)."""
    options = []
    for initial, goes, truncated in rows:
        ways = [("D", 2, "")]
        if not goes:
            extra = 5 * truncated
            ways += [("K", extra, initial), ("R", 1 + extra, "u"), ("R", 1 + extra, "a")]
        options.append([(("I" * len(put)) + letter, 5 * len(put) + cost, "".join(put) + left) for n in range(3) for put in itertools.product("ua", repeat=n) for letter, cost, left in ways])
    options.append([("I" * len(put), 5 * len(put), "".join(put)) for n in range(3) for put in itertools.product("ua", repeat=n)])
    for way in itertools.product(*options):
        if LEGAL.fullmatch("".join(w[2] for w in way)):
            yield sum(w[1] for w in way), "".join(w[0] for w in way)


def code(row):
    initial, goes, truncated = row
    return (repair.INITIALS + "?").index(initial) | 4 * goes | 8 * truncated


def random_row(r):
    goes = r.random() < 0.2
    return r.choice("suaua?"), goes, not goes and r.random() < 0.25


@pytest.mark.parametrize("seed", range(40))
def test_against_all_edits(seed):
    r = random.Random(seed)
    rows = [random_row(r) for _ in range(r.randint(0, 3))]
    assert repair.cheapest(bytes(map(code, rows))) == min(every_edit(rows))


@pytest.mark.parametrize("seed", range(30))
def test_divide_and_conquer_against_whole_audits(seed):
    r = random.Random(seed)
    codes = bytes(code(random_row(r)) for _ in range(r.choice([33, 64, 65, 150, 700])))
    at = {repair.START: (0, "")}
    for c in codes:
        after = {}
        for p, q, cost, edits in repair.MOVES[c]:
            if p in at:
                after[q] = min(after.get(q, (1 << 60, "")), (at[p][0] + cost, at[p][1] + edits))
        at = after
    want = min((c + 5 * repair.TO_END[q], a + "I" * repair.TO_END[q]) for q, (c, a) in at.items())
    assert repair.cheapest(codes) == want


def plain(rows):
    """op12's rows in plain Python, with audits as strings."""
    space = lambda v: " " if v is None else str(v)
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        how = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        role, text = space(role), space(text)
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            kept[conv] += [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    for conv, left in kept.items():
        left.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in left:
            bare = text.strip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [t for t, *_ in left if t is not None]
        codes = bytes(code((r[:1] if r[:1] and r[:1] in "sua" else "?", f in ("blank", "duplicate"), f == "truncated")) for (_, r, _), f in zip(left, faults, strict=True))
        cost, audit = repair.cheapest(codes)
        state, out, rest = 0, [], iter(left)
        for letter in audit:
            role, text = (repair.NEXT_ROLE[state], "") if letter == "I" else next(rest)[1:]
            if letter == "D":
                continue
            role = repair.NEXT_ROLE[state] if letter == "R" else role
            state = repair.STEPS[state, role[:1]]
            out.append(f"{role}:{text}")
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(left)]
        yield (
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in repair.FAULTS), sum(p not in repair.LEGAL_PAIRS for p in pairs),
            cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest(),
        )


def test_query(spark, tmp_path):
    r = random.Random(3)
    texts = ["Yes.", "No!", "cut", "", None, " \t\n", "Why? ", "é。", "Yes."]
    rows = [(c, r.choice([None, *range(9)]), r.choice(["user", "assistant", "system", "tool", "", None, "user", "assistant"]), r.choice(texts)) for c in (*range(40), None) for _ in range(r.randint(1, 9))]
    rows += [(77, t, "user" if t % 2 == 0 else "assistant", "long " * 50_000 + ("." if t % 3 else "")) for t in range(90)]
    rows += [(78, None, "user", "a."), (78, None, "user", "a.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df.repartition(5).write.parquet(str(tmp_path / "conversations.parquet"))
    got = [tuple(x) for x in repair.op12_structure_repair(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)
    df.filter("false").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert repair.op12_structure_repair(spark, str(tmp_path / "none")).count() == 0


def test_repaired_rows_are_legal(spark):
    r = random.Random(5)
    rows = [(c, t, r.choice(["user", "assistant", "system"]), r.choice(["a.", "b", "c!"])) for c in range(30) for t in range(r.randint(1, 12))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' AS k", "'x' AS digest", "'x' AS fault", "1 AS place")
    edits = repair.find_edits(df)
    found = {}
    for x in repair.repaired_turns(df, edits).collect():
        found.setdefault(x.k, []).append((x.place, x.role))
    for turns in found.values():
        assert [p for p, _ in turns] == list(range(len(turns)))
        assert LEGAL.fullmatch("".join(role[0] for _, role in turns))
