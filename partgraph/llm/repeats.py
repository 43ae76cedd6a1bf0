"""Substring dedup by sliding sentence spans: every run of consecutive sentences is hashed, and joined globally.

A sentence ends behind . ! or ? before white space, or at a line end. Sentences that differ in case or white
space only count as equal. A run of ``SPAN`` sentences with ``MIN_WORDS`` words or more is repeated if an equal run stands
before it, by document id, then hash of the text, then place. With ``whole``, as op2 has it, a run with fewer words is not left out but
goes on until it holds MIN_WORDS, and a sentence of ``ALONE`` words or more is a run of its own, so passages of short lines
and of one long sentence are seen too. Every sentence that a repeated run covers, other
than in the first of the equal runs, is removed; rows equal in id and text are one document here.

First places are found by an aggregation that combines in each task, so a passage of a third of all documents is one
row from each; they are written down, and joined back by hash with large partitions split.

Null and empty text has no sentences. A document with fewer sentences than a run has no runs but of long sentences.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import Scratch, map_batches, text_or_empty, unused
from partgraph.llm.words import mix, windows

SPAN, MIN_WORDS, ALONE = 2, 8, 20
SCHEMA = "doc_id long, tie long, place long, start long, end long, hash long"
ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])
SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|$)|(?=\n|$))")


def sentences(text: str) -> list[tuple[int, int]]:
    """Places of sentences without the white space around them, end exclusive."""
    return [m.span() for m in SENTENCE.finditer(text)]


def runs(text: str, span: int, min_words: int, whole: bool = False) -> Iterator[tuple[int, int, int, int]]:
    """(place, start, end, hash) of each run of ``span`` sentences; ``whole``: also of longer runs, and of long sentences."""
    places = sentences(text)
    if len(places) < (1 if whole else span):
        return
    hashes, counts = np.zeros(len(places), np.uint64), np.zeros(len(places), int)
    for i, (start, end) in enumerate(places):
        words = text[start:end].lower().split()
        counts[i] = len(words)
        hashes[i] = xxhash.xxh64_intdigest(" ".join(words))
    size, before = span, np.zeros(0, bool)
    while size <= len(places):  # a sentence has a word, so the last size is MIN_WORDS at most
        joined = mix(windows(hashes, size)).view(np.int64)
        enough = np.convolve(counts, np.ones(size, int), "valid") >= min_words
        fresh = enough & ~before[: len(enough)] if len(before) else enough
        for i in np.flatnonzero(fresh).tolist():
            yield i, places[i][0], places[i + size - 1][1], int(joined[i])
        if not whole or enough.all():
            break
        size, before = size + 1, enough
    if whole and span > 1:
        joined = mix(windows(hashes, 1)).view(np.int64)
        for i in np.flatnonzero(counts >= ALONE).tolist():
            yield i, *places[i], int(joined[i])


def _runs(span: int, min_words: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (doc_id, tie, *r)
                for doc_id, tie, text in zip(*(batch.column(i).to_pylist() for i in range(3)))
                for r in runs(text, span, min_words, whole)
            ]
            for at in range(0, len(rows), 50_000):
                columns = list(zip(*rows[at : at + 50_000]))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=ARROW)

    return run


def sentence_runs(docs: DataFrame, span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("tie"), text_or_empty().alias("text"))
    return map_batches(texts, _runs(span, min_words, whole), SCHEMA)


def repeated_runs(docs: DataFrame, scratch: Scratch, span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """Runs that stand in ``docs`` before, with the document of the first one."""
    order = F.struct("doc_id", "tie", "place")
    found = scratch.save(sentence_runs(docs, span, min_words, whole), "runs")  # texts are split once
    first = found.groupBy("hash").agg(F.min(order).alias("first"), F.max(order).alias("last"))
    known = scratch.save(first.where("first <> last").select("hash", "first"), "first")
    return found.join(known, "hash").where(F.struct("doc_id", "tie", "place") != F.col("first")).select(
        "doc_id", "tie", "start", "end", F.col("first.doc_id").alias("first_doc_id")
    )


REMOVED = "doc_id long, tie long, n_runs long, n_removed_chars long, removed string, first_doc_ids array<bigint>"


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Joined spans of each document, from rows sorted by document and place."""
    key, spans, firsts, count, out = None, [], set(), 0, []
    names = ["doc_id", "tie", "n_runs", "n_removed_chars", "removed", "first_doc_ids"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]

    def close() -> None:
        if key is not None:
            ids = sorted(firsts, key=lambda f: (f is not None, f))
            out.append((*key, count, sum(b - a for a, b in spans), ",".join(f"{a}:{b}" for a, b in spans), ids))

    def batch_of() -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [()] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    for batch in batches:
        for doc_id, tie, start, end, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if key != (doc_id, tie):
                close()
                key, spans, firsts, count = (doc_id, tie), [], set(), 0
            count += 1
            firsts.add(first)
            if spans and start <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        if len(out) >= 1000:
            yield batch_of()
            out.clear()
    close()
    yield batch_of()


def removed_spans(docs: DataFrame, scratch: Scratch, span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = False) -> DataFrame:
    """One row per document that loses text: the joined spans to remove, as start:end in code points, comma-joined,
    and the documents that keep them."""
    found = repeated_runs(docs, scratch, span, min_words, whole).distinct()
    placed = found.repartition("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "start", "end")
    return map_batches(placed, _spans, REMOVED)


def remove_repeats(docs: DataFrame, scratch: Scratch, span: int = SPAN, min_words: int = MIN_WORDS, whole: bool = True) -> DataFrame:
    """``docs`` without the repeated sentences; rows without any stay as they are."""
    spans = scratch.save(removed_spans(docs, scratch, span, min_words, whole).select("doc_id", "tie", "removed"), "spans")
    same = docs["doc_id"].cast("long").eqNullSafe(spans["doc_id"]) & (F.xxhash64(docs["text"]) == spans["tie"])
    rows = docs.join(spans, same, "left")

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, removed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, at = [], 0
                for a, b in (map(int, s.split(":")) for s in removed.split(",")) if removed else ():
                    kept.append(text[at:a])
                    at = b
                out.append("".join([*kept, text[at:]]) if removed else text)
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(out, pa.string())], names)

    names = [*[c for c in docs.columns if c != "text"], "text"]
    others = [docs[c] for c in names[:-1]]
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(rows.select(docs["text"], spans["removed"].alias(unused(docs, "removed")), *others), drop, schema).select(*docs.columns)
