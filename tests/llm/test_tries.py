"""The trie against one built from plain tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from visitloom.llm import queries, tries

SCHEMA = "conv_id long, turn int, role string, text string"


def slow(convs):
    """Rows of all nodes from a dict of conversation id to its list of (role, text)."""
    members = defaultdict(list)
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            members[tuple(convs[c][:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    out, totals = set(), {}
    for node in sorted(members, key=len, reverse=True):
        leaves = sum(totals[x][0] for x in children[node]) or 1
        saved = sum(totals[x][1] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        totals[node] = leaves, saved
        ends = ",".join(str(c) for c in members[node] if len(convs[c]) == len(node))
        out.add((members[node][0], len(node), members[node[:-1]][0] if node else None, len(members[node]), len(children[node]),
                 leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def rebuilt(rows):
    """The conversations as the query's contract has them, from (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = own.get(c - c % 100, [])[:h] + own[c][h:]
    return out


def table(n, seed, longest=8):
    rnd = random.Random(seed)
    rows = []
    for c in range(n):
        last = rnd.choice([1, 2, 3, longest])
        for t in range(last):
            role, text = rnd.choice(["user", "assistant", None]), rnd.choice(["", "hi", "é日", None, "long " * 9, "x"])
            rows.append((c, None if t == 0 and c % 3 == 0 else t, role, text))
    rnd.shuffle(rows)
    return rows


def query_rows(spark, rows, folder):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as depth", "'y' as conv", "1 as pos")
    df.repartition(3).write.parquet(f"{folder}/conversations.parquet")
    out = queries.queries()["op13_conversation_trie"](spark, str(folder))
    got = [tuple(r) for r in out.collect()]
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("members,span", [(2048, 256), (3, 2)])
def test_query_equals_brute_force(spark, tmp_path, monkeypatch, members, span):
    monkeypatch.setattr(tries, "MEMBERS", members)
    monkeypatch.setattr(tries, "SPAN", span)
    rows = table(250, 3) + [(None, 1, "user", "nobody")]
    rows += [(c, t, "user", f"copy {t}") for c in (300, 301, 500, 555, 660, 777) for t in range(20)]
    rows += [(1000 + c, t, "user", "same") for c in range(1, 40) for t in range(2)]
    assert query_rows(spark, rows, tmp_path) == slow(rebuilt(rows))


def test_operator_with_long_and_turnless_conversations(spark, monkeypatch):
    monkeypatch.setattr(tries, "MEMBERS", 2)
    convs = {1: [("u", "a")] * 900, 2: [("u", "a")] * 600 + [("u", "b")], 5: [], 6: [], 7: [("u", "a")] * 900, 9: [("v", "a")]}
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    thin = tries.thin_turns(spark.createDataFrame(rows, SCHEMA))
    made = tries.trie(thin, spark.createDataFrame([(c,) for c in convs], "conv long"))
    got = {tuple(r) for r in made.nodes.collect()}
    wanted = slow(convs)
    assert got == {r[:-1] for r in wanted}
    lists = defaultdict(list)
    for r in made.ends.collect():
        lists[r.conv_id, r.depth].append(r.member)
    for row in wanted:
        listed = ",".join(map(str, sorted(lists.get(row[:2], []))))
        assert hashlib.sha256(listed.encode()).hexdigest() == row[-1]


def test_repeated_rows_are_turns_of_their_own(spark):
    rows = [(4, 1, "u", "a")] * 3 + [(5, 1, "u", "a"), (5, 1, "u", "bb")]
    made = tries.trie(tries.thin_turns(spark.createDataFrame(rows, SCHEMA)))
    either = [{4: [("u", "a")] * 3, 5: order} for order in ([("u", "a"), ("u", "bb")], [("u", "bb"), ("u", "a")])]
    assert {tuple(r) for r in made.nodes.collect()} in [{r[:-1] for r in slow(c)} for c in either]


def test_long_lists_are_digested_in_parts(spark):
    ids = list(range(5000, 0, -1))
    ends = spark.createDataFrame([(i, 1, 0) for i in ids] + [(9, 9, 2)], "member long, conv_id long, depth long")
    got = {(r.conv_id, r.depth): r.ends_sha256 for r in tries.listed_digest(ends.repartition(7)).collect()}
    assert got == {
        (1, 0): hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(),
        (9, 2): hashlib.sha256(b"9").hexdigest(),
    }


def test_empty_table(spark, tmp_path):
    assert query_rows(spark, [], tmp_path) == set()
