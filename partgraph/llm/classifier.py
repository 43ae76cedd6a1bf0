"""Quality classifier: learned vectors of hashed words and character n-grams, averaged, softmax output.

A document's features are its words, its byte n-grams (white space as one byte, so they see word ends)
and one feature for each three-word run that is new, and another for each that stood in the text before. The
vectors are trained by stochastic gradient descent in numpy, in one task, on at most ``MAX_LABELLED`` labelled
documents that aren't held out. For scoring, vectors and output layer fold into one number per bucket (2 MB,
whatever the corpus), and every whole text is scored in tasks.

Null or empty text has no features: its score is that of the bias. Labels other than 0 and 1 and repeated labels
don't count; without labels of both classes every score is the share of ones (0.5 if none). A document
without id is never a training row. Labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import map_batches, text_or_empty, unused
from partgraph.llm.words import WHITE, mix, pieces, windows, word_hashes

#: Most labelled documents trained on: those with the smallest hash of their id.
MAX_LABELLED = 3_000
BUCKET_BITS, GRAMS, VECTOR, EPOCHS, RATE = 18, (3, 4), 8, 6, 0.3
NEW_RUN, OLD_RUN = 0, 1  # the first buckets, for runs of three words
ACCEPT = 0.7


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def gram_buckets(piece: bytes) -> list[np.ndarray]:
    """Buckets of the n-grams of one piece; runs of white space count as one."""
    codes = np.frombuffer(piece, np.uint8)
    white = WHITE[codes]
    keep = ~white
    keep[1:] |= ~white[:-1]
    codes = np.where(white, np.uint8(32), codes)[keep].astype(np.uint64)
    shift = np.uint64(64 - BUCKET_BITS)
    out = []
    for size in GRAMS:
        count = len(codes) - size + 1
        if count > 0:
            packed = np.full(count, np.uint64(size), np.uint64)
            for i in range(size):
                packed = (packed << np.uint64(8)) | codes[i : i + count]
            out.append(((packed * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64))
    return out


def buckets(text: bytes) -> Iterator[np.ndarray]:
    """Feature buckets of a text, some at a time."""
    for piece in pieces(text):
        yield from gram_buckets(piece)
    hashes = word_hashes(text)
    if len(hashes):
        yield (mix(hashes) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    runs = windows(hashes, 3)
    if len(runs):
        new = len(np.unique(runs))
        yield np.repeat(np.array([NEW_RUN, OLD_RUN]), [new, len(runs) - new])


def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their shares."""
    parts = list(buckets(text))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0)
    ids, counts = np.unique(np.concatenate(parts), return_counts=True)
    return ids, counts / counts.sum()


def train(texts: list[bytes], quality: np.ndarray, seed: int = 7) -> tuple[np.ndarray, float]:
    """One weight per bucket and the bias: the log odds of quality are the mean weight plus the bias."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-0.1, 0.1, (1 << BUCKET_BITS, VECTOR)).astype(np.float32)
    share = float(np.clip(quality.mean(), 0.01, 0.99)) if len(quality) else 0.5
    output, bias = rng.normal(0, 0.5, (2, VECTOR)), np.log([1 - share, share])
    if len(set(quality.tolist())) < 2:
        return np.zeros(1 << BUCKET_BITS, np.float32), float(bias[1] - bias[0])
    bags = [bag(t) for t in texts]
    steps, total = 0, EPOCHS * len(bags)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(bags)):
            ids, weight = bags[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            hidden = weight @ vectors[ids]
            odds = output @ hidden + bias
            chance = np.exp(odds - odds.max())
            chance /= chance.sum()
            chance[int(quality[i])] -= 1  # now the gradient of the loss
            back = chance @ output
            output -= rate * np.outer(chance, hidden)
            bias = bias - 0.1 * rate * chance
            if len(ids):  # a step of the mean vector, shared out by weight
                vectors[ids] -= np.outer(weight * (rate / (weight @ weight)), back).astype(np.float32)
    return (vectors @ (output[1] - output[0])).astype(np.float32), float(bias[1] - bias[0])


def score(text: bytes, weights: np.ndarray, bias: float) -> float:
    total, count = 0.0, 0
    for ids in buckets(text):
        total += float(weights[ids].sum(dtype=np.float64))
        count += len(ids)
    return float(1 / (1 + np.exp(-np.clip(total / max(count, 1) + bias, -40, 40))))


def _train_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((h, i, q, t) for b in batches for h, i, q, t in zip(*(c.to_pylist() for c in b.columns)))
    weights, bias = train([r[3] for r in rows], np.array([r[2] for r in rows], int))
    data = io.BytesIO()
    np.savez(data, weights=weights, bias=bias)
    yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], ["model"])


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> tuple[np.ndarray, float]:
    """Weights and bias from ``limit`` labelled, not held-out documents at most."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int").alias("_quality"))
    known = known.where("_quality in (0, 1) and doc_id is not null").where(~is_held_out(F.col("doc_id"))).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("_quality")]
    chosen = F.broadcast(known.orderBy(*order).limit(limit))  # bounded by the limit
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("_text"))
    rows = texts.join(chosen, "doc_id").select(F.xxhash64("doc_id").alias("_hash"), "doc_id", "_quality", "_text")
    rows = rows.orderBy("_hash", "doc_id", "_quality", "_text").limit(limit)  # an id may have many rows
    model = map_batches(rows.repartition(1), _train_task, "model binary").collect()
    if not model:
        return np.zeros(1 << BUCKET_BITS, np.float32), 0.0
    loaded = np.load(io.BytesIO(model[0]["model"]))
    return loaded["weights"], float(loaded["bias"])


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], name: str = "quality_score") -> DataFrame:
    """``docs`` with the score of every row in a column ``name``; one that has that name already is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the bucket count

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        for batch in batches:
            scores = [score(t.as_buffer().to_pybytes(), weights, bias) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names)

    rest = docs.drop(name).select("*", text_or_empty().cast("binary").alias(name))
    names = rest.columns
    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.drop(name).schema.fields]
    return map_batches(rest, scored, ", ".join([*fields, f"`{name}` double"]))


def accept(docs: DataFrame, model: tuple[np.ndarray, float], least: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns."""
    name = unused(docs, "quality_score")
    return with_score(docs, model, name).where(F.col(name) >= least).select(*docs.columns)
