"""Packing token sequences into windows: repeat counts of length combinations by non-negative least squares.

A task encodes its documents and gathers them to a shard of some millions of tokens. Whole windows of long
documents are sequences of their own. For what is left of each document, the shard's histogram of lengths is fitted
by combinations that fill a window: a few lengths, each once or repeated. Counts are rounded down, documents
dealt to them, gaps filled and residuals packed by cutting them at the window's end, the last one at powers
of two. So all work stays in the task that read the rows; nothing is shuffled and a lost task is done anew alone.

Null text is empty: a single end token. Every row gives its own pieces, repeated rows too.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import map_batches, text_or_empty, worker_cache
from partgraph.llm.words import WHITE, pieces, span_hashes

WINDOW, END = 2048, 1
#: Tokens of a shard: bounds a task's memory (4 bytes each) and leaves some thousand windows to fill.
SHARD = 10_000_000
#: Lengths are fitted in steps of so many tokens; smaller gaps stay padding, larger ones are filled.
STEP, GAP = 16, 24
#: Bytes of units' hashes and ids that a worker remembers, and bytes of text looked up at once.
REMEMBERED, GROUP = 16 << 20, 1 << 21
#: White space beyond ASCII, and the special string of the vocabulary.
OTHER_SPACE = re.compile(b"|".join(c.encode() for c in "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000") + b"|\xe2\x80[\x80-\x8a]")

LETTERS, MARKS = np.zeros(256, bool), np.zeros(256, bool)
LETTERS[[*range(65, 91), *range(97, 123)]] = True
MARKS[[c for c in range(33, 127) if not LETTERS[c] and chr(c) not in "'0123456789"]] = True


class Ids:
    """Ids of whole texts by a ``tokenizers`` file, remembered by unit.

    A unit is white space with the word behind it, or the marks behind its letters. The file's splitter starts anew
    where white space follows another character and where a mark other than ' follows a letter, so units are encoded for themselves: unknown ones together, between special tokens. Texts with
    other white space or the special string are encoded as they are.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.remembered = Tokenizer.from_file(path), remembered
        self.kind = np.uint16 if self.model.get_vocab_size() <= 1 << 16 else np.uint32
        self.mark, self.mark_id = next((t.content, i) for i, t in self.model.get_added_tokens_decoder().items() if t.special)
        self.forget()

    def forget(self) -> None:
        """Known units: sorted hashes, and where the ids of each lie in one row of ids."""
        self.keys, self.at, self.sizes = np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32)
        self.pool = np.zeros(0, self.kind)

    def plain(self, text: str) -> np.ndarray:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4")

    def encode_units(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and the ids."""
        joined = self.mark.join(u.decode() for u in units)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id)
        sizes = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
        return sizes, np.delete(ids, cuts)

    def learn(self, keys: np.ndarray, units: Callable[[int, int], list[bytes]]) -> None:
        """Add units by their hashes; ``units`` gives those from one place to another."""
        found = [self.encode_units(units(i, min(i + 2000, len(keys)))) for i in range(0, len(keys), 2000)]
        sizes = np.concatenate([f[0] for f in found]).astype(np.uint32)
        at = (len(self.pool) + np.cumsum(sizes) - sizes).astype(np.uint32)
        self.pool = np.concatenate([self.pool, *(f[1].astype(self.kind) for f in found)])
        order = np.argsort(both := np.concatenate([self.keys, keys]), kind="stable")
        self.keys, self.at, self.sizes = both[order], np.concatenate([self.at, at])[order], np.concatenate([self.sizes, sizes])[order]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where units would stand among the known ones, and whether they do."""
        place = np.searchsorted(self.keys, keys)
        inside = np.minimum(place, max(len(self.keys) - 1, 0))
        return place, self.keys[inside] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def group(self, parts: list[bytes]) -> list[np.ndarray]:
        """Ids of parts that each begin and end between a word and white space."""
        data, sizes = b"".join(parts), np.array([len(p) for p in parts])
        codes = np.frombuffer(data, np.uint8)
        white = WHITE[codes]
        first = np.zeros(len(codes), bool)
        first[1:] = (white[1:] & ~white[:-1]) | (MARKS[codes[1:]] & LETTERS[codes[:-1]])
        part_starts = np.cumsum(sizes) - sizes
        first[part_starts[sizes > 0]] = True
        starts = np.flatnonzero(first)
        ends = np.append(starts[1:], len(codes)) if len(starts) else starts
        keys, at, which = np.unique(span_hashes(codes, starts, ends), return_index=True, return_inverse=True)
        size = self.keys.nbytes + self.at.nbytes + self.sizes.nbytes + self.pool.nbytes
        if size > self.remembered:
            self.forget()
        new = np.flatnonzero(~self.places(keys)[1])
        if len(new):
            spans = list(zip(starts[at[new]].tolist(), ends[at[new]].tolist()))
            self.learn(keys[new], lambda i, j: [data[a:b] for a, b in spans[i:j]])
        unit = self.places(keys)[0][which]
        size = self.sizes[unit].astype(np.int64)
        out_end = np.cumsum(size)
        ids = self.pool[np.repeat(self.at[unit].astype(np.int64) - (out_end - size), size) + np.arange(int(size.sum()))].astype("<u4")
        bounds = np.append(0, out_end)[np.searchsorted(starts, np.append(part_starts, len(codes)))]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def encode(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        held: list[list[bytes] | np.ndarray] = []
        size = 0

        def ready() -> Iterator[np.ndarray]:
            parts = iter(self.group([p for h in held if isinstance(h, list) for p in h]))
            for h in held:
                yield np.concatenate([next(parts) for _ in h]) if isinstance(h, list) else h

        for text in texts:
            odd = self.mark.encode() in text or OTHER_SPACE.search(text)
            held.append(self.plain(text.decode()) if odd else list(pieces(text)))
            size += len(text)
            if size > GROUP:
                yield from ready()
                held, size = [], 0
        yield from ready()


def encoder(path: str) -> Ids:
    """One per worker: between tasks it holds the file's tokenizer and REMEMBERED bytes at most, in four arrays."""
    cache = worker_cache("ids")
    if path not in cache:
        cache[path] = Ids(path)
    return cache[path]


def combinations(present: np.ndarray, total: int) -> list[tuple[tuple[int, int], ...]]:
    """Ways to fill ``total`` with the lengths present: three at most, or one repeated and another up to three times."""
    have, out = set(present.tolist()), set()
    for i, a in enumerate(present.tolist()):
        if total % a == 0:
            out.add(((a, total // a),))
        for b in present[i:].tolist():
            c = total - a - b
            if c >= b and c in have:
                out.add(tuple(sorted((x, [a, b, c].count(x)) for x in {a, b, c})))
        for other in have - {a}:
            for times in (1, 2, 3):
                rest = total - times * other
                if rest > 0 and rest % a == 0:
                    out.add(tuple(sorted(((other, times), (a, rest // a)))))
    return sorted(out)


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 400) -> np.ndarray:
    """x >= 0 with least squares of a @ x - b, by an active set that grows where the gradient is largest."""
    x, active = np.zeros(a.shape[1]), np.zeros(0, int)
    for _ in range(rounds):
        gradient = a.T @ (b - a @ x)
        gradient[active] = -np.inf
        best = int(np.argmax(gradient))
        if gradient[best] <= 1e-6 * max(1.0, float(b.max())):
            break
        active = np.append(active, best)
        while True:
            part = a[:, active]
            solved = np.linalg.solve(part.T @ part + 1e-9 * np.eye(len(active)), part.T @ b)
            if solved.min() > 0:
                break
            falling = solved <= 0
            now = x[active]
            share = np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-12))
            now = now + share * (solved - now)
            x[:] = 0
            x[active] = np.maximum(now, 0)
            active = active[(x[active] > 1e-9) & ~(falling & (x[active] <= 1e-9))]
            if not len(active):
                return x
        x[:] = 0
        x[active] = solved
    return x


def plan(lengths: np.ndarray, window: int = WINDOW, step: int = STEP, gap: int = GAP) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that cover every document's tokens once."""
    found, sequence = [], 0
    for d in np.flatnonzero(lengths >= window).tolist():
        for k in range(int(lengths[d]) // window):
            found.append((d, k * window, window, sequence, 0))
            sequence += 1
    rest = lengths % window
    open_docs = np.flatnonzero(rest)
    steps = -(-rest[open_docs] // step)
    bins: dict[int, list[int]] = {}
    for d, s in zip(open_docs.tolist(), steps.tolist()):
        bins.setdefault(s, []).append(d)
    sequences: list[list[int]] = []
    ways = combinations(np.array(sorted(bins)), window // step) if bins else []
    if ways:
        row = {s: i for i, s in enumerate(sorted(bins))}
        matrix = np.zeros((len(row), len(ways)))
        for j, way in enumerate(ways):
            for s, times in way:
                matrix[row[s], j] = times
        counts = nnls(matrix, np.array([len(bins[s]) for s in sorted(bins)], float))
        for j in np.argsort(-counts, kind="stable").tolist():
            for _ in range(int(counts[j] + 1e-6)):
                if any(len(bins[s]) < times for s, times in ways[j]):
                    break
                sequences.append([bins[s].pop() for s, times in ways[j] for _ in range(times)])
    left = sorted((d for docs in bins.values() for d in docs), key=lambda d: (-rest[d], d))
    cursor, used = 0, 0  # the residual being cut, and what of it is packed

    def cut(space: int, offset: int) -> int:
        """Pack up to ``space`` tokens of residuals into the current sequence; what stays open of it."""
        nonlocal cursor, used
        while space and cursor < len(left):
            d = left[cursor]
            size = min(space, int(rest[d]) - used)
            found.append((d, int(lengths[d] - rest[d]) + used, size, sequence, offset))
            space, offset, used = space - size, offset + size, used + size
            if used == rest[d]:
                cursor, used = cursor + 1, 0
        return space

    for docs in sequences:
        offset = 0
        for d in docs:
            found.append((d, int(lengths[d] - rest[d]), int(rest[d]), sequence, offset))
            offset += int(rest[d])
        if window - offset >= gap:
            cut(window - offset, offset)
        sequence += 1
    open_tokens = int(sum(int(rest[d]) for d in left[cursor:])) - used
    while open_tokens:
        size = window if open_tokens >= window else 1 << (open_tokens.bit_length() - 1)
        cut(size, 0)
        open_tokens -= size
        sequence += 1
    return found


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
ARROW = pa.schema([(f.split()[0], pa.int64()) for f in SCHEMA.split(", ")])


def _pack(path: str, window: int, shard: int, with_ids: bool):
    schema = ARROW.append(pa.field("ids", pa.binary())) if with_ids else ARROW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, held, tokens = encoder(path), [], 0
        first = TaskContext.get().partitionId() << 40  # sequences of one task; the same if it runs anew

        def packed() -> Iterator[pa.RecordBatch]:
            nonlocal first, held, tokens
            lengths = np.array([len(ids) // 4 for _, ids in held], int)
            planned = plan(lengths, window)
            for at in range(0, len(planned), 20_000):
                part = planned[at : at + 20_000]
                cut = [held[d][1][4 * start : 4 * (start + size)] for d, start, size, _, _ in part]
                columns = [
                    [held[p[0]][0] for p in part], [p[1] for p in part], [p[2] for p in part], [zlib.crc32(c) for c in cut],
                    [int(lengths[p[0]]) for p in part], [first + p[3] for p in part], [p[4] for p in part],
                ]
                arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(cut, pa.binary())] if with_ids else [])
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)
            first += max((p[3] + 1 for p in planned), default=0)
            held, tokens = [], 0

        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            texts = [t.as_buffer().to_pybytes() for t in batch.column(1)]
            for doc_id, ids in zip(batch.column(0).to_pylist(), model.encode(texts)):
                held.append((doc_id, ids.tobytes() + end))
                tokens += len(ids) + 1
                if tokens >= shard:
                    yield from packed()
        yield from packed()

    return run


def pack(docs: DataFrame, path: str, window: int = WINDOW, shard: int = SHARD, with_ids: bool = False) -> DataFrame:
    """One row per piece, with its place in its document and its sequence; ``with_ids`` adds the ids themselves."""
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary").alias("text"))
    return map_batches(texts, _pack(path, window, shard, with_ids), SCHEMA + (", ids binary" if with_ids else ""))
