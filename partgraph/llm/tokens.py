"""Token counts, with huge documents encoded in overlapping chunks that are spliced where both agree.

Documents up to ``CHUNK`` characters are encoded whole. A longer one becomes chunks that overlap, each a row of
its own that any task may encode. A splice point lies in the overlap of two chunks, where white space follows
another character, the tokenizer provably starts anew there whatever stood before, and no token of
either encoding crosses it. Chunk counts are then differences between splice points. Documents with an overlap that
holds no such point are cut again with wider overlaps, up to the whole text, so every count is that of the library.

Null text is empty: no bytes, no tokens. Every row of the input gives one row, repeated rows too.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from partgraph.llm.common import Scratch, map_batches, text_or_empty, worker_cache

#: Characters of a chunk and of its overlap with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 9
LIMIT = 4096
#: A space behind something that no library takes for white space.
BOUNDARY = re.compile(r"(?<=\S)(?= )")


class Pieces:
    """A ``sentencepiece`` model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = (self.model.id_to_piece(i) for i in range(self.model.get_piece_size()))
        # with no piece that holds a word start behind another character, no merge crosses one
        self.proven = not any("▁" in name.lstrip("▁") for name in names)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(texts, num_threads=1)]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        pieces = self.model.encode(text, return_type="proto").pieces
        codes = np.frombuffer(text.encode(), np.uint8)
        chars = np.append(0, np.cumsum((codes & 0xC0) != 0x80))  # places come in bytes
        return chars[np.array([p.begin for p in pieces], int)], chars[np.array([p.end for p in pieces], int)]


class Merges:
    """A ``tokenizers`` file."""

    #: Splitters that never join a word with the space behind it.
    SPLITTERS = ("ByteLevel", "Whitespace", "WhitespaceSplit", "BertPreTokenizer")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        splitter = json.loads(self.model.to_str())["pre_tokenizer"] or {}
        parts = splitter.get("pretokenizers", [splitter])
        self.proven = any(p.get("type") in self.SPLITTERS and p.get("use_regex", True) for p in parts)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(e) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        offsets = np.array(self.model.encode(text, add_special_tokens=False).offsets, int).reshape(-1, 2)
        return offsets[:, 0], offsets[:, 1]


def tokenizer(path: str) -> Pieces | Merges:
    cache = worker_cache("tokenizers")
    if path not in cache:
        cache[path] = Pieces(path) if path.endswith(".model") else Merges(path)
    return cache[path]


def splice_points(text: str, start: int, model: Pieces | Merges, low: int, high: int) -> list[dict[str, int]]:
    """Proven points of the chunk at ``start`` between the document's places ``low`` and ``high``, with the tokens before each."""
    if not model.proven:
        return []
    begins, ends = model.places(text)
    reach = np.maximum.accumulate(ends) if len(ends) else ends
    found = []
    for match in BOUNDARY.finditer(text, max(low - start, 1), max(high - start, 1)):
        p = match.start()
        before = int(np.searchsorted(begins, p, side="left"))
        if p > 0 and (before == 0 or reach[before - 1] <= p):
            found.append({"at": start + p, "before": before})
    return found


def _whole(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            counts = model.counts(batch.column(2).to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(counts, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def _cut(chunk: int, overlap: int):
    """Each row's text as chunks: one row per chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                for no, start in enumerate(range(0, max(len(text) - overlap, 1), chunk - overlap)):
                    last = start + chunk >= len(text)
                    values = ([row], [no], [start], [len(text)], [last], [text[start : start + chunk]])
                    yield pa.RecordBatch.from_pydict(dict(zip(("row", "chunk", "start", "length", "last", "part"), values)))

    return run


POINTS = "array<struct<at:long,before:long>>"


def _encode(path: str, overlap: int):
    arrow = pa.list_(pa.struct([("at", pa.int64()), ("before", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = tokenizer(path)
        for batch in batches:
            for row in batch.to_pylist():
                text, start = row.pop("part"), row["start"]
                end = start + len(text)
                row["tokens"] = model.counts([text])[0]
                head = [] if start == 0 else splice_points(text, start, model, start, start + overlap)
                tail = [] if row["last"] else splice_points(text, start, model, end - overlap, end)
                columns = {k: pa.array([v]) for k, v in row.items()}
                columns |= {"head": pa.array([head], arrow), "tail": pa.array([tail], arrow)}
                yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _splice(encoded: DataFrame) -> DataFrame:
    """Tokens of each row's text, null where two neighbours share no point."""
    chunks = Window.partitionBy("row").orderBy("chunk")
    shared = lambda a, b: F.filter(a, lambda p: F.exists(b, lambda q: q["at"] == p["at"]))
    pairs = encoded.withColumn("next_head", F.lead("head").over(chunks)).withColumn("before_tail", F.lag("tail").over(chunks))
    middle = lambda points: F.get(points, F.floor(F.size(points) / 2).cast("int"))["before"]
    until = F.when(F.col("last"), F.col("tokens")).otherwise(middle(shared(F.col("tail"), F.col("next_head"))))
    since = F.when(F.col("chunk") == 0, F.lit(0)).otherwise(middle(shared(F.col("head"), F.col("before_tail"))))
    own = pairs.select("row", (until - since).alias("own"))
    return own.groupBy("row").agg(F.when(F.count("own") == F.count(F.lit(1)), F.sum("own")).alias("n_tokens"))


def count_tokens(
    docs: DataFrame, path: str, scratch: Scratch, limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each row, by the tokenizer file at ``path``."""
    texts = docs.select("doc_id", F.octet_length(text_or_empty()).cast("long").alias("n_bytes"), text_or_empty().alias("text"))
    is_long = F.length("text") > chunk
    fields = "doc_id " + docs.schema["doc_id"].dataType.simpleString() + ", n_bytes long"
    parts = [map_batches(texts.where(~is_long), _whole(path), fields + ", n_tokens long")]
    # numbers are given while the table is written, so they stay the same whatever is computed anew later
    open_rows = scratch.save(texts.where(is_long).withColumn("row", F.monotonically_increasing_id()), "long")
    turn = 0
    while not open_rows.isEmpty():
        cut = map_batches(
            open_rows.select("row", "text"), _cut(chunk, overlap), "row long, chunk long, start long, length long, last boolean, part string"
        )
        encoded = map_batches(
            cut.repartition("row", "chunk"),
            _encode(path, overlap),
            f"row long, chunk long, start long, length long, last boolean, tokens long, head {POINTS}, tail {POINTS}",
        )
        counted = scratch.save(_splice(scratch.save(encoded, f"chunks{turn}")), f"counts{turn}")
        rows = open_rows.join(counted, "row")
        parts.append(rows.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens"))
        open_rows = rows.where("n_tokens is null").select("doc_id", "n_bytes", "text", "row")
        chunk, overlap, turn = chunk * 4, overlap * 8, turn + 1
        overlap = min(overlap, chunk // 2)
    return reduce(DataFrame.unionByName, parts).withColumn("over_limit", F.col("n_tokens") > limit)
