"""Near duplicates against all pairs, components against a union-find."""

import random
import re

from partgraph.llm import near
from partgraph.llm.links import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text):
    words = WORD.findall(lowered(text))
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def roots(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def brute(rows):
    sets = {i: shingles(t) for i, t in rows}
    links = [
        (a, b)
        for a in sets
        for b in sets
        if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])
    ]
    root = roots(list(sets), links)
    return {i: (len(sets[i]), root[i], root[i] == i) for i in sets}


def group(rng, count, edits, length=120):
    base = [rng.choice("abcdefghij") + str(rng.randrange(900)) for _ in range(length)]
    out = []
    for _ in range(count):
        words = list(base)
        for _ in range(rng.randrange(edits + 1)):
            words[rng.randrange(length)] = "new" + str(rng.randrange(10**6))
        out.append(" ".join(words))
    return out


def test_against_all_pairs(documents, scratch):
    rng = random.Random(11)
    texts = group(rng, 150, 4) + group(rng, 40, 2, 60) + group(rng, 60, 9, 300) + group(rng, 20, 1, 30)
    shared = group(rng, 1, 0, 40)[0]
    texts += [shared + " " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(20, 90))) for _ in range(120)]
    texts += ["", " ", "a b", "A  B", "a b c d e", "a b c d e", "K ſ É", "k ſ é"] + [texts[0]] * 30
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    found = near.near_duplicates(documents(rows), scratch).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(rows)


def test_base_text_missing(documents, scratch):
    """Copies that differ from each other more than from a text between them stay linked through it only."""
    rng = random.Random(4)
    rows = list(enumerate(group(rng, 90, 5, 150)))
    found = near.near_duplicates(documents(rows), scratch).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute(rows)


def test_nulls_repeats_and_nothing(documents, scratch):
    long = " ".join(f"w{i}" for i in range(60_000))
    rows = [(1, None), (2, "x y z"), (2, "x y z"), (None, "x y z"), (None, None), (3, long), (4, long + " end")]
    found = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near.near_duplicates(documents(rows), scratch).collect()), key=str)
    expected = [(1, 0, 1, True), (2, 1, 2, True), (2, 1, 2, True), (None, 1, None, True), (None, 0, None, True), (3, 59_996, 3, True), (4, 59_997, 3, False)]
    assert found == sorted(expected, key=str)


def test_one_of_each(documents, scratch):
    rows = [(5, "a b c d e f"), (3, "A b c d e f"), (3, "A b c d e f"), (9, "other text"), (None, "a b c d e f"), (4, None)]
    docs = documents(rows)
    kept = near.one_of_each(docs, scratch)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(3, "A b c d e f"), (9, "other text"), (None, "a b c d e f"), (4, None)], key=str)


def test_pipeline_stage_links_from_80_percent(llm, documents):
    import corpus_pipeline

    rows, rng = [], random.Random(8)
    for i in range(60):
        words = [f"g{i}w{rng.randrange(10**6)}" for _ in range(54)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:27], "edited", *words[28:]]))]
    a, b = shingles(rows[0][1]), shingles(rows[1][1])
    assert 80 * len(a | b) <= 100 * len(a & b) < 85 * len(a | b)
    kept = corpus_pipeline.near_dedup(llm, documents(rows), "")
    assert sorted(r.doc_id for r in kept.collect()) == [2 * i for i in range(60)]
    assert near.Sketcher(0.85).sizes == [(8, 2), (10, 3)] and near.Sketcher(0.8).sizes == [(10, 2), (14, 3)]


def test_empty_table(documents, scratch):
    assert near.near_duplicates(documents([]), scratch).count() == 0


def test_components(llm, scratch):
    rng = random.Random(1)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(i, i + 1) for i in range(500, 600)] + [(1000 + i, 900) for i in range(50)] + [(7, 7)]
    found = {r.node: r.label for r in components(llm.createDataFrame(pairs, "a long, b long"), scratch, "c").collect()}
    nodes = {n for p in pairs for n in p if p[0] != p[1]}
    assert found == {n: r for n, r in roots({n for p in pairs for n in p}, pairs).items() if n in nodes}
