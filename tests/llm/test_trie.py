"""The prefix trie against one built from Python lists."""

import hashlib
import random
import zlib

import pytest

from partgraph.llm import trie
from partgraph.llm.common import Scratch

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string, rep string, depth int"


def expected(rows):
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [t[2:] for t in sorted(ts)] for c, ts in turns.items()}
    rebuilt = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
    members, ends = {}, {}
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    children = {}
    for seq in members:
        if seq:
            children.setdefault(seq[:-1], []).append(seq)
    out, totals = [], {}
    for seq in sorted(members, key=len, reverse=True):
        below = [totals[s] for s in children.get(seq, [])]
        saved = (len(members[seq]) - 1) * len(seq[-1][1].encode()) if seq else 0
        totals[seq] = (sum(b[0] for b in below) or 1, saved + sum(b[1] for b in below))
        ids = ",".join(map(str, sorted(ends.get(seq, []))))
        out.append((min(members[seq]), len(seq), min(members[seq[:-1]]) if seq else None, len(members[seq]), len(below), *totals[seq],
                    hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(llm, rows, **options):
    table = llm.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    result = trie.prefix_trie(table, Scratch(llm, "test"), **options)
    assert result.columns == COLUMNS
    return sorted(map(tuple, result.collect()), key=lambda r: (r[1], r[0]))


def some_rows(n, seed=1):
    pick = random.Random(seed)
    return [(c, t, pick.choice(["user", "assistant"]), pick.choice(["a", "bé", "", "long text " * 9])) for c in range(n) for t in range(pick.randrange(1, 13))]


ODD = [
    (0, 0, "user", "hi"), (0, 1, "assistant", None), (0, None, None, "first"), (0, 1, "assistant", None), (0, 1, "aside", "tie"),
    (1, 5, "user", "x"), (2, 0, "", ""), (3, 0, "user", "hi"), (3, 0, "user", "hi"), (None, 0, "user", "lost"), (None, None, None, None),
    (7, 0, "user", "no lender"), (8, -3, "user", "é" * 200_000), (-1, 0, "user", "minus"), (-5, 0, "user", "lender of -1"), (-5, 1, "user", "two"),
    (10**12, 0, "user", "hi"), (10**12 + 1, 3, "user", "hi"), *((12, t, "u", "own") for t in range(9)), *((10, t, "u", "lent") for t in range(3)),
]


def test_odd_rows(llm):
    assert found(llm, ODD) == expected(ODD)


def test_empty(llm):
    assert found(llm, []) == []
    assert found(llm, [(None, 1, "user", "x")]) == []


def test_all_turnless_but_one(llm):
    rows = [(c, 0, "user", "x") for c in (1, 2, 3, 6, 7, 8)]
    assert found(llm, rows) == expected(rows)


@pytest.mark.parametrize("limit", [12, 150])
def test_split_components(llm, limit, monkeypatch):
    monkeypatch.setattr(trie, "LARGE", 6)
    monkeypatch.setattr(trie, "BLOCK", 3)
    rows = some_rows(60) + [(5, 100 + t, "user", f"chain {t}") for t in range(80)]
    assert found(llm, rows, limit=limit) == expected(rows)


def test_hot_conversation_and_first_turn(llm, monkeypatch):
    monkeypatch.setattr(trie, "LARGE", 20)
    monkeypatch.setattr(trie, "BLOCK", 64)
    monkeypatch.setattr(trie, "CHUNK", 30)
    rows = [(c, t, "user", ["same", "again"][t]) for c in range(400) for t in range(2)] + [(3, 2 + t, "user", f"t{t % 7}") for t in range(700)]
    assert found(llm, rows, limit=400) == expected(rows)


def test_roll_up_of_trees():
    pick = random.Random(5)
    for n in (1, 2, 3, 30, 400):
        for near in (1, 5, n):
            parents = [-1] + [pick.randrange(max(0, i - near), i) for i in range(1, n)]
            own = [(pick.randrange(3), pick.randrange(100)) for _ in parents]
            weights, want = [1] * n, [list(v) for v in own]
            for i in range(n - 1, 0, -1):
                weights[parents[i]] += weights[i]
                want[parents[i]] = [a + b for a, b in zip(want[parents[i]], want[i])]
            sums = [[0, 0] for _ in parents]
            trie.roll_up(parents, weights, own, sums)
            assert sums == want


def test_file_sizes_choose_no_broadcast(llm, monkeypatch):
    """Sides that Parquet packs well are joined by shuffles: as broadcasts the driver would hold them unpacked."""
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before, save, plans = [llm.conf.get(n, None) for n in names], Scratch.save, []

    def saved(self, df, name):
        plans.append((name, df._jdf.queryExecution().sparkPlan().toString()))  # as chosen by the sizes of files
        return save(self, df, name)

    monkeypatch.setattr(Scratch, "save", saved)
    rows = some_rows(60)
    table = llm.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    result = trie.prefix_trie(table, Scratch(llm, "test"), limit=150)
    plans.append(("result", result._jdf.queryExecution().sparkPlan().toString()))
    explicit = ("placed", "deep", "keyed", "path")  # one row per range; large nodes, few by their least size
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan and name not in explicit] == []
    assert sum("SortMergeJoin" in plan for _, plan in plans) > 5
    assert sorted(map(tuple, result.collect()), key=lambda r: (r[1], r[0])) == expected(rows)
    assert [llm.conf.get(n, None) for n in names] == [before[0] or "10485760b", before[1]]
