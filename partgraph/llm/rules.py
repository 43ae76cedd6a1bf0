"""Quality rules: statistics of each document, hard limits, and boosted trees over the statistics.

The statistics are counted over whole texts, in tasks, and written down once. The trees are fitted on
the driver from at most ``MAX_LABELLED`` rows of statistics (a dozen numbers each), flattened into arrays and
applied by numpy. On chosen statistics the score may only fall as they rise.

Null or empty text: all counts are 0 and the document fails. Rows without a usable label aren't fitted;
without labels of both classes only the hard limits decide. Repeated rows are treated alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import Scratch, map_batches, text_or_empty
from partgraph.llm.words import WHITE, code_points, windows, word_hashes

#: Most labelled rows that trees are fitted on: those with the smallest hash of their id.
MAX_LABELLED = 20_000
#: Limits of the hard rules.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Probability of quality from which a document is kept.
KEEP_FROM = 0.5

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MORE = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct_words")
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS + MORE)
SYMBOL_BYTES, UPPER_BYTES, DIGIT_BYTES, MARK_BYTES = b"#*$%&|<>", bytes(range(65, 91)), b"0123456789", b".,;:!?'\"()[]-"
SPACE_BYTES = bytes(np.flatnonzero(WHITE).astype(np.uint8))

#: Statistics the trees see, and the direction in which each may move the score: -1 only down, 0 freely.
FEATURES = {
    "symbols_per_char": -1,
    "dup_line_share": -1,
    "repeat_word_share": -1,
    "upper_per_char": -1,
    "marks_per_char": 0,
    "digits_per_char": 0,
    "mean_word_chars": 0,
    "words_log": 0,
    "distinct_share": 0,
}


def repeated_words(hashes: np.ndarray, size: int = 3) -> int:
    """Words inside windows of ``size`` words that stand in the text twice or more."""
    keys = windows(hashes, size)
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    repeated = np.isin(keys, twice)
    covered = np.zeros(len(hashes), bool)
    for i in range(size):
        covered[i : i + len(keys)] |= repeated
    return int(covered.sum())


def duplicate_lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier one."""
    if b"\n" not in text:
        return int(bool(text.strip(SPACE_BYTES))), 0
    lines = [line for line in text.split(b"\n") if line.strip(SPACE_BYTES)]
    return len(lines), len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[int, ...]:
    """Values of COUNTS and MORE."""
    hashes = word_hashes(text)
    without = lambda drop: len(text) - len(text.translate(None, drop))
    n_lines, n_dup = duplicate_lines(text)
    return (
        len(hashes), code_points(text.translate(None, SPACE_BYTES)), without(SYMBOL_BYTES), n_dup, repeated_words(hashes),
        n_lines, without(UPPER_BYTES), without(DIGIT_BYTES), without(MARK_BYTES), len(np.unique(hashes)),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [*COUNTS, *MORE]
    for batch in batches:
        rows = [statistics(t.as_buffer().to_pybytes()) for t in batch.column(1)]
        columns = list(zip(*rows)) if rows else [()] * len(names)
        arrays = [batch.column(0), *[pa.array(c, pa.int64()) for c in columns]]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", *names])


def document_stats(docs: DataFrame) -> DataFrame:
    """Statistics of every document's whole text."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return map_batches(texts, _count, STATS_SCHEMA)


def features(stats: dict[str, np.ndarray]) -> np.ndarray:
    """One row of FEATURES for each document."""
    n = {k: np.asarray(v, float) for k, v in stats.items()}
    chars, words = np.maximum(n["word_chars"], 1), np.maximum(n["n_words"], 1)
    return np.stack(
        [
            n["n_symbols"] / chars,
            n["n_dup_lines"] / np.maximum(n["n_lines"], 1),
            n["n_repeat_words"] / words,
            n["n_upper"] / chars,
            n["n_marks"] / chars,
            n["n_digits"] / chars,
            n["word_chars"] / words,
            np.log1p(n["n_words"]),
            n["n_distinct_words"] / words,
        ],
        axis=1,
    )


@dataclass
class Trees:
    """Complete binary trees of one depth as arrays: node k has the children 2k+1 and 2k+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), int)
            while len(x) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.3,
    bins: int = 32, ridge: float = 1.0, least: float = 1.0,
) -> Trees:
    """Boosting on the logistic loss with Newton steps over binned statistics.

    A split on a statistic with a sign must order its sides by it, and bounds passed down keep all later
    leaves on their side.
    """
    share = float(np.clip(y.mean(), 0.01, 0.99))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(x.shape[1])], axis=1)
    inner, base = 2**depth - 1, float(np.log(share / (1 - share)))
    margin = np.full(len(y), base)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, threshold = np.zeros(inner, int), np.full(inner, np.inf)
        bounds = {0: (-4.0, 4.0)}
        node = np.zeros(len(y), int)

        def value(gs: np.ndarray, hs: np.ndarray, low: float, high: float) -> np.ndarray:
            return np.clip(gs / (hs + ridge), low, high)

        for k in range(inner):
            low, high = bounds[k]
            here = np.flatnonzero(node == k)
            best = (1e-6, None, None, None)
            total_g, total_h = g[here].sum(), h[here].sum()
            gain_of = lambda v, gs, hs: gs * v - 0.5 * (hs + ridge) * v * v
            parent = gain_of(value(total_g, total_h, low, high), total_g, total_h)
            for f, sign in enumerate(signs):
                if not len(cuts[f]) or not len(here):
                    continue
                size = len(cuts[f]) + 1
                gl = np.cumsum(np.bincount(binned[here, f], g[here], size))[:-1]
                hl = np.cumsum(np.bincount(binned[here, f], h[here], size))[:-1]
                gr, hr = total_g - gl, total_h - hl
                vl, vr = value(gl, hl, low, high), value(gr, hr, low, high)
                gain = gain_of(vl, gl, hl) + gain_of(vr, gr, hr) - parent
                gain[(hl < least) | (hr < least) | (sign * (vr - vl) < 0)] = -np.inf
                i = int(np.argmax(gain))
                if gain[i] > best[0]:
                    best = (float(gain[i]), f, i, (float(vl[i]), float(vr[i])))
            left = right = (low, high)
            if best[1] is not None:
                feature[k], threshold[k] = best[1], cuts[best[1]][best[2]]
                if sign := signs[best[1]]:
                    middle = sum(best[3]) / 2
                    left, right = ((low, middle), (middle, high)) if sign > 0 else ((middle, high), (low, middle))
                node[here] = 2 * k + 1 + (binned[here, best[1]] > best[2])
            else:
                node[here] = 2 * k + 1
            bounds[2 * k + 1], bounds[2 * k + 2] = left, right
        place = node - inner
        gs, hs = np.bincount(place, g, inner + 1), np.bincount(place, h, inner + 1)
        leaf = np.array([rate * value(gs[i], hs[i], *bounds[inner + i]) for i in range(inner + 1)])
        margin += leaf[place]
        out.append((feature, threshold, leaf))
    return Trees(base, *(np.stack(part) for part in zip(*out)))


def fit_on(stats: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Trees | None:
    """Trees from ``limit`` labelled rows at most; None without both classes."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).where("quality in (0, 1) and doc_id is not null")
    held_in = known.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2).distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality")]
    chosen = held_in.orderBy(*order).limit(limit)
    rows = stats.join(chosen, "doc_id").orderBy(*order, *COUNTS).limit(limit).toPandas()
    if rows["quality"].nunique() < 2:
        return None
    x = features({c: rows[c].to_numpy() for c in COUNTS + MORE})
    return fit_trees(x, rows["quality"].to_numpy(float), tuple(FEATURES.values()))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def judge(docs: DataFrame, labels: DataFrame, scratch: Scratch, keep_from: float = KEEP_FROM) -> DataFrame:
    """Statistics, ``base_failed``, ``tree_score`` and ``kept`` of every row of ``docs``."""
    stats = scratch.save(document_stats(docs), "stats")
    trees = fit_on(stats, labels)
    names = stats.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = {c: batch.column(names.index(c)).to_numpy() for c in COUNTS + MORE}
            score = np.ones(batch.num_rows) if trees is None else trees.score(features(values))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, "tree_score"])

    judged = map_batches(stats, scored, STATS_SCHEMA + ", tree_score double").withColumn("base_failed", base_failed())
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("tree_score") >= keep_from))
