"""Stages keep every column of their documents, whatever its name, and every row of a repeated id that has a text of its own."""

import random

import pytest
from pyspark.sql import functions as F

from partgraph.llm import classifier, decontam, near, pii, repeats
from partgraph.llm.common import Scratch, unused

NAMES = [
    "_id", "_tie", "_pii", "_removed", "quality_score", "node", "digest", "id", "sum", "new", "removed", "pii_spans", "tie", "again", "rep", "key",
    "label", "hash", "doc_words", "parts", "score", "n", "Quality_Score_",
]


def prose(seed, n=40):
    rng = random.Random(seed)
    return " ".join(rng.choice("abcdefgh") + str(rng.randrange(500)) for _ in range(n))


QUESTION = "which river runs past the old mill where the miller keeps nine grey geese and one gander"
ROWS = [
    (1, prose(1)), (2, prose(1)), (4, prose(2)), (4, prose(1)), (4, prose(3)), (4, prose(3)), (5, "so they ask " + QUESTION + " today"), (5, prose(5)),
    (6, "write to ann@example.org now. " + prose(6)), (6, prose(7)), (None, prose(8)), (None, prose(8)), (7, None), (7, ""),
]


@pytest.fixture
def docs(llm):
    table = llm.createDataFrame(ROWS, "doc_id long, text string")
    return table.select("doc_id", *(F.lit(f"kept {n}").alias(n) for n in NAMES), "text")


def rows_of(df, docs):
    assert df.columns == docs.columns
    found = [r.asDict() for r in df.collect()]
    assert all(r[n] == f"kept {n}" for r in found for n in NAMES)
    return sorted(((r["doc_id"], r["text"]) for r in found), key=str)


def test_one_of_each(llm, docs):
    expected = [(1, prose(1)), (4, prose(2)), (4, prose(3)), *ROWS[6:12], (7, None)]
    found = rows_of(near.one_of_each(docs, Scratch(llm, "test")), docs)
    empty = [r for r in found if r[0] == 7]
    assert len(empty) == 1  # null and empty are one text
    assert [r for r in found if r[0] != 7] == sorted((r for r in expected if r[0] != 7), key=str)


def test_without_leaks(llm, docs):
    bench = llm.createDataFrame([(1, QUESTION)], "item_id long, text string")
    assert rows_of(decontam.without_leaks(docs, bench, Scratch(llm, "test")), docs) == sorted(ROWS[:6] + ROWS[7:], key=str)


def test_remove_repeats(llm, docs):
    found = rows_of(repeats.remove_repeats(docs, Scratch(llm, "test")), docs)
    assert len(found) == len(ROWS)


def test_redact(docs):
    found = rows_of(pii.redact(docs), docs)
    assert found == sorted(((i, t and t.replace("ann@example.org", "<EMAIL>")) for i, t in ROWS), key=str)


def test_accept(llm, docs):
    labels = llm.createDataFrame([(i, i % 2, 0) for i in range(1, 7)], "doc_id long, quality int, toxic int")
    model = classifier.fit(docs, labels)
    assert rows_of(classifier.accept(docs, model, 0.0), docs) == sorted(ROWS, key=str)


def test_labelled_rows_of_a_repeated_id_are_bounded(llm):
    docs = llm.createDataFrame([(1, f"text {i}") for i in range(50)], "doc_id long, text string")
    labels = llm.createDataFrame([(1, 1)], "doc_id long, quality int")
    seen = []
    train = classifier._train_task
    try:
        classifier._train_task = lambda batches: (seen.append(1), train(batches))[1]
        weights, _ = classifier.fit(docs, labels, limit=5)
    finally:
        classifier._train_task = train
    assert weights.shape == (1 << classifier.BUCKET_BITS,)


def test_unused(docs):
    assert unused(docs, "quality_score") == "quality_score__" and unused(docs, "other") == "other"
