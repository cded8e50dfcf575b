"""Reply trees against a walk in plain Python; escapes read back; forks, rings, orphans, nulls and repeated rows."""

import random

import pytest
from pyspark.sql import functions as F

from turnledger.llm import reply_trees

SCHEMA = "tree long, id long, parent long, score double, role string, text string"
NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### user: x", "\\", "\\\\#", "#" * 5, "a\\</turn", ">: %3A %25", "", None, "é日本語 \U0001f600 </turn>"]


def paths(rows, top):
    """(tree, [messages from root to leaf]) of the best paths."""
    trees, out = {}, []
    for tree, i, parent, score, role, text in rows:
        trees.setdefault(tree, {})[i] = (parent, score, role, text)
    for tree, nodes in trees.items():
        kids, found = {}, []
        for i, (p, *_) in nodes.items():
            kids.setdefault(p if p in nodes and p != i else "root", []).append(i)
        stack = [((), x) for x in kids.get("root", ())]
        while stack:
            route, i = stack.pop()
            s = nodes[i][1]
            route += ((float("inf") if s is None else -s, i),)
            stack += [(route, x) for x in kids.get(i, ())]
            if i not in kids:
                found.append(route)
        out += [(tree, n + 1, [i for _, i in r]) for n, r in enumerate(sorted(found)) if top is None or n < top]
    return sorted(out, key=str)


def random_rows(seed):
    r = random.Random(seed)
    rows = []
    for tree in (*range(8), None):
        n = r.randint(1, 40)
        for i in range(n):
            parent = None if r.random() < 0.1 else r.choice([999, i]) if r.random() < 0.1 else r.randrange(i) if i else None
            rows.append((tree, i, parent, r.choice([None, 0.5, 1.0, 2.0]), r.choice(["user", "assistant", "a: b%", None]), r.choice(NASTY)))
    rows += [(50, 1, 2, 0.0, "user", "ring"), (50, 2, 1, 0.0, "user", "ring"), (50, 3, 2, 0.0, "user", "below a ring"), (50, 4, None, 0.0, "user", "not in it")]
    rows += [(51, i, i - 1 if i else None, 0.0, "assistant" if i % 2 else "user", f"turn {i}") for i in range(70)]
    return rows


@pytest.mark.parametrize("top", [1, 2, None])
def test_paths(spark, top):
    rows = random_rows(7)
    df = spark.createDataFrame(rows + rows[:9], SCHEMA).withColumns({c: F.lit("clash") for c in ("t", "leaf", "rank", "node", "up", "start")})
    got = {}
    for p in reply_trees.reply_paths(df, top).collect():
        got.setdefault((p.tree, p.leaf), (p.tree, p["rank"], []))[2].append((-p.back, p.id))
    assert sorted(((t, n, [i for _, i in sorted(x)]) for t, n, x in got.values()), key=str) == paths(rows, top)


@pytest.mark.parametrize("top", [1, None])
def test_texts_read_back(spark, top):
    rows = random_rows(11)
    held = {(r[0], r[1]): r for r in rows}
    df = spark.createDataFrame(rows, SCHEMA)
    out = reply_trees.format_paths(reply_trees.reply_paths(df, top), df.withColumn("ref", F.col("id").cast("string")))
    got = {}
    for t in reply_trees.turns_of(out).collect():
        got.setdefault((t.tree, t.leaf), []).append((t.at, t.role, t.text, t.learned))
    want = []
    for tree, _, ids in paths(rows, top):
        turns = [held[tree, i] for i in ids]
        want.append((tree, [(n, r[4] or "", r[5] or "", (r[5] or "") if r[4] == "assistant" else None) for n, r in enumerate(turns)]))
    assert sorted(((k[0], sorted(v)) for k, v in got.items()), key=str) == sorted(want, key=str)
    for row in out.collect():
        # a mark is found where a turn begins or ends and nowhere else
        assert row.formatted.count("</turn>") == row.n_turns and row.formatted.count("###") == row.n_turns
        spans = [row.formatted[s.start : s.end] for s in row.loss_spans if s]
        assert all("</turn>" not in s for s in spans)


def test_public_form_and_nothing(spark):
    rows = [(1, 1, None, 0.0, "user", "which?"), (1, 2, 1, 1.0, "assistant", "this"), (1, 3, 1, 5.0, "assistant", "that # one")]
    df = spark.createDataFrame(rows, SCHEMA)
    one = reply_trees.conversations_of(df).collect()
    assert [(r.tree, r["rank"], r.n_turns, r.formatted) for r in one] == [(1, 1, 2, "### user: which?</turn>\n### assistant: that \\# one</turn>\n")]
    s = one[0].loss_spans[1]
    assert one[0].formatted[s.start : s.end] == "that \\# one" and one[0].loss_spans[0] is None
    assert reply_trees.conversations_of(df.filter("false")).count() == 0
    assert reply_trees.conversations_of(df, None).count() == 2


def test_query(spark, tmp_path):
    """Nulls, ties, repeated rows and a very long text; by turn with nulls first."""
    import hashlib

    long = "word ### " * 200_000
    rows = [(1, 1, "assistant", None), (1, 0, "user", "q"), (1, None, "system", "s"), (2, 5, "user", "same"), (2, 5, "user", "same"), (None, 0, "user", long), (None, 1, "assistant", long), (3, None, None, None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = {r.conv_id: r for r in reply_trees.op11_reply_trees(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    assert got[1].turns_sha256 == sha("system\ns\nuser\nq\nassistant\n\n") and got[1].loss_chars == 0 and got[1].n_turns == 3
    assert got[2].turns_sha256 == sha("user\nsame\n" * 2) and got[2].loss_sha256 == sha("")
    assert got[None].turns_sha256 == sha(f"user\n{long}\nassistant\n{long}\n") and got[None].loss_sha256 == sha(long) and got[None].loss_chars == len(long)
    assert got[3].turns_sha256 == sha("\n\n") and got[-7].loss_sha256 == sha(reply_trees.EXTRA_TEXT) and got[-7].n_turns == 2
    spark.createDataFrame([], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "none" / "conversations.parquet"))
    assert [r.conv_id for r in reply_trees.op11_reply_trees(spark, str(tmp_path / "none")).collect()] == [-7]
