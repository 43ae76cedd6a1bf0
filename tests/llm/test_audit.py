"""Filter audit against a plain count of every order, and its handling of odd rows."""

from itertools import permutations

import compare
import pytest

from partgraph.llm import audit
from partgraph.llm.common import Scratch
from partgraph.llm.oracle import ORACLES
from partgraph.llm.queries import QUERIES

LABELS = "doc_id long, quality int, toxic int"


def own_bits(text):
    words = text.replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    capitals = sum("A" <= c <= "Z" for c in text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * capitals > 2 * len(text), any(c in "#$%&*|" for c in text)]


def expected(rows, labels):
    smallest = {}
    for i, text, _ in rows:
        if i is not None:
            smallest[text or ""] = min(i, smallest.get(text or "", i))
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    docs = []
    for i, text, source in rows:
        fails = own_bits(text or "") + [i is not None and smallest[text or ""] < i]
        docs.append((source or "", i, {x for x, f in zip("ABCDE", fails) if f}))
    out, removed_by = [], {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order):
                gone = [d for d in left if x in d[2]]
                before = len(own) - len(left)
                left = [d for d in left if x not in d[2]]
                failing = [d for d in own if x in d[2]]
                removed_by[part, x] = removed_by.get((part, x), 0) + len(gone)
                out.append((part, "".join(order), step + 1, len(left), len(gone), len(failing) - len(gone), sum(d[2] == {x} for d in own),
                            sum(d[1] in good for d in gone), sum(d[1] in toxic for d in gone)))
                assert before + len(gone) + len(left) == len(own)
    return sorted((*r, removed_by[r[0], r[1][r[2] - 1]]) for r in out)


def run(llm, rows, labels, **options):
    docs = llm.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], "doc_id long, text string, source string, part string, hash int")
    found = audit.audit(docs, llm.createDataFrame(labels, LABELS), Scratch(llm, "test"), **options)
    return sorted(tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect())


LONG = " ".join(f"w{i}" for i in range(250))
ROWS = [
    (1, LONG, "a"), (2, LONG, "a"), (3, LONG, "b"), (4, LONG + " #", "b"), (5, "word " * 300, "a"), (6, LONG + " X" * 40, None),
    (7, None, "a"), (8, "", ""), (None, LONG, "b"), (None, None, "b"), (9, "A B |", "a"), (9, "A B |", "a"), (9, "other", "a"),
    (10, "A B |", "b"), (10, LONG, "a"), (11, "é" * 60 + "É\tB\nC", "a"), (12, "x" * 500_000, "c"), (13, "x" * 500_000, "c"),
]
SAID = [(1, 1, 0), (2, 1, 0), (2, 0, 1), (5, 0, 1), (9, 1, None), (10, None, 1), (None, 1, 1), (99, 1, 1)]


@pytest.mark.parametrize("spread", [1, 256])
def test_against_every_order(llm, spread):
    got, want = run(llm, ROWS, SAID, spread=spread), expected(ROWS, SAID)
    assert [x for x in zip(got, want) if x[0] != x[1]][:5] == []
    assert len(got) == len(want)


def test_empty_tables(llm):
    assert run(llm, [], SAID) == []
    assert run(llm, ROWS[:3], []) == expected(ROWS[:3], [])


def test_hot_text(llm):
    rows = [(i, "same text" if i % 3 else f"text {i}", "hot") for i in range(900)]
    assert run(llm, rows, [(i, i % 2, 0) for i in range(900)], spread=16) == expected(rows, [(i, i % 2, 0) for i in range(900)])


def test_sql(llm):
    folder = "/root/testdata/sf0.001"
    assert compare.differences(compare.connect(folder), ORACLES["op12_filter_audit"], QUERIES["op12_filter_audit"](llm, folder)) == ""
