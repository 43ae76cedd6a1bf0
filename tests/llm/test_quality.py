"""Statistics by brute force, models by held-out accuracy."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from partgraph.llm import classifier, rules
from partgraph.llm.common import read

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLDER = "/root/testdata/sf0.01"


def brute(text):
    words = WORD.findall(text)
    runs = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if runs[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(2)
    parts = ["a", "b", "cc", "ä😀", "#", "%%", "\n", " ", "\t", "\x0b", "\xa0", "\x1c", "x", "dog", "\r\n"]
    made = ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(300)]
    return ["", " ", "\n\n", "a a a a", "x\nx\n\nx \n y", "w " * 3000, "z" * 5000, *made]


def test_statistics():
    for text in texts():
        assert rules.statistics(text.encode())[:5] == brute(text), repr(text)


def test_long_texts_go_in_pieces(monkeypatch):
    from partgraph.llm import words

    for text in texts():
        parts = list(words.pieces(text.encode(), 16))
        assert b"".join(parts) == text.encode()
        whole = words.word_hashes(text.encode())
        assert np.concatenate([words._word_hashes(p) for p in parts]).tolist() == whole.tolist()
        assert len(whole) == len(WORD.findall(text))


def test_judge_handles_anything(llm, documents, scratch):
    rows = [(1, None), (2, ""), (None, "a b"), (4, "x " * 60), (4, "x " * 60), (5, " ".join(f"w{i}" for i in range(80)))]
    labels = llm.createDataFrame([(4, None, None), (None, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    found = sorted(((r.doc_id, r.n_words, r.base_failed, r.kept) for r in rules.judge(documents(rows), labels, scratch).collect()), key=str)
    assert found == sorted([(1, 0, True, False), (2, 0, True, False), (None, 2, True, False), (4, 60, True, False), (4, 60, True, False), (5, 80, False, True)], key=str)


def test_judge_of_nothing(llm, documents, scratch):
    labels = llm.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rules.judge(documents([]), labels, scratch).count() == 0


def test_trees_hold_out(llm, scratch):
    docs, labels = read(llm, FOLDER, "documents"), read(llm, FOLDER, "labels")
    judged = rules.judge(docs, labels, scratch).join(labels, "doc_id").toPandas()
    held = judged[judged.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2) & ~judged.base_failed]
    assert ((held.tree_score >= 0.5) == (held.quality == 1)).mean() > 0.95


def test_verdict_against_a_walk(llm, scratch):
    """``kept`` from the plain counts and a walk through each tree, row by row."""
    folder = "/root/testdata/sf0.001"
    docs, labels = read(llm, folder, "documents"), read(llm, folder, "labels")
    rows = rules.judge(docs, labels, scratch).toPandas()
    trees = rules.fit_on(rules.document_stats(docs), labels)
    x = rules.features({c: rows[c].to_numpy() for c in rules.COUNTS + rules.MORE})
    texts_by_id = {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
    assert len(rows) == len(texts_by_id)
    for doc_id, kept, values in zip(rows.doc_id, rows.kept, x):
        total = trees.base
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if values[feature[node]] > threshold[node] else 1)
            total += leaf[node - len(feature)]
        n_words, _, _, _, n_repeat = brute(texts_by_id[doc_id])
        failed = n_words < 50 or 100 * n_repeat > 50 * n_words
        assert kept == (not failed and 1 / (1 + np.exp(-total)) >= rules.KEEP_FROM), doc_id


def test_trees_are_monotone():
    rng = np.random.default_rng(0)
    x = rng.uniform(0, 1, (2000, 3))
    y = (rng.uniform(0, 1, 2000) < 0.5 + 0.4 * np.sin(6 * x[:, 0]) * x[:, 1]).astype(float)
    trees = rules.fit_trees(x, y, (-1, 0, 1))
    grid = np.linspace(0, 1, 50)
    for _ in range(50):
        row = np.tile(rng.uniform(0, 1, 3), (50, 1))
        down, up = row.copy(), row.copy()
        down[:, 0], up[:, 2] = grid, grid
        assert (np.diff(trees.score(down)) <= 1e-12).all() and (np.diff(trees.score(up)) >= -1e-12).all()


def test_classifier_holds_out(llm):
    docs, labels = read(llm, FOLDER, "documents"), read(llm, FOLDER, "labels")
    scored = classifier.with_score(docs, classifier.fit(docs, labels)).withColumn("held", classifier.is_held_out(F.col("doc_id")))
    rows = scored.join(labels, "doc_id").toPandas()
    assert rows.held.equals(rows.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2))
    held = rows[rows.held]
    assert ((held.quality_score >= 0.7) == (held.quality == 1)).mean() > 0.9
    assert classifier.accept(docs, classifier.fit(docs, labels)).columns == docs.columns


@pytest.mark.parametrize("known", [[], [(1, 1)], [(1, 1), (1, 0), (4, 0), (4, 0), (None, 1), (5, None), (6, 7)]])
def test_classifier_handles_anything(llm, documents, known):
    docs = documents([(1, None), (2, ""), (None, "a b"), (4, "x " * 60), (4, "x " * 60), (5, "long " * 20_000)])
    labels = llm.createDataFrame([(i, q, 0) for i, q in known], "doc_id long, quality int, toxic int")
    rows = classifier.with_score(docs, classifier.fit(docs, labels)).collect()
    assert len(rows) == 6 and all(0 <= r.quality_score <= 1 for r in rows)
    assert classifier.with_score(documents([]), classifier.fit(documents([]), labels)).count() == 0
