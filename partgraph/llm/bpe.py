"""BPE encoding and decoding by an index from each pair to all its positions.

A task splits its texts into words as the tokenizer does, and gathers the words it has not met yet until they fill an index of
``SYMBOLS`` symbols. The symbols of all these words stand in one row of cells. An index maps the rank of every
adjacent pair to all positions where it stands, in whatever word. Ranks are applied in ascending order, each at all
its positions at once; a merge puts the pairs it makes with its neighbours into the lists of their ranks, and
positions that an earlier merge has changed are passed over. So the rows of a partition share the work: a pair is looked up
once for all its places, and a word is merged once per task however often it stands, as long as ``REMEMBERED`` bytes hold it.

Normaliser, splitter and special tokens are those of the file. Where the splitter drops white space, texts are taken
apart at ASCII white space first; printable ASCII in between goes through the file's own pattern in one call, the rest through the library's
normaliser and splitter. No text and no word is ever cut elsewhere, so ids are those of the library for any text.

Null text is empty: no ids. Every row gives one row, repeated rows too. Other columns are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
import json
import re
from array import array
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import accumulate, groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import map_batches, text_or_empty, worker_cache

#: Symbols of one index, bytes of words a task remembers, and bytes of text looked up at once.
SYMBOLS, REMEMBERED, GROUP = 1 << 18, 64 << 20, 2 << 20
#: Ids decoded at once.
IDS = 1 << 22
#: Printable ASCII and white space; other control characters are left to the library.
PRINTABLE = re.compile(rb"[\x09-\x0D\x20-\x7E]*").fullmatch
CONTROL = re.compile(rb"[\x00-\x08\x0E-\x1F\x7F]").search


class Merges:
    """The merge rules of a ``tokenizers`` BPE file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        unread = ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")
        if model.get("type", "BPE") != "BPE" or any(model.get(k) for k in unread):
            raise ValueError(f"not a plain BPE file: {path}")
        self.vocab, self.end = model["vocab"], model.get("end_of_word_suffix") or ""
        self.names = {i: t for t, i in self.vocab.items()}
        #: Rank by pair of ids; pair and the id made by rank.
        self.ranks: dict[tuple[int, int], int] = {}
        self.pairs: list[tuple[int, int]] = []
        self.made: list[int] = []
        for rule in model["merges"]:
            a, b = rule.split(" ") if isinstance(rule, str) else rule
            self.pairs.append((self.vocab[a], self.vocab[b]))
            self.ranks[self.pairs[-1]] = len(self.made)
            self.made.append(self.vocab[a + b])
        #: Rules after which a rule of a lower rank may apply: their positions are taken one by one in each unit.
        first_use: dict[int, int] = {}
        for pair, rank in self.ranks.items():
            for part in pair:
                first_use[part] = min(rank, first_use.get(part, rank))
        self.early = {r for r, made in enumerate(self.made) if first_use.get(made, r) < r}
        added = spec.get("added_tokens") or []
        if any(t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError(f"special tokens that change the text around them: {path}")
        self.special = {t["content"]: t["id"] for t in added}
        self.special_bytes = [t.encode() for t in self.special]
        self.names |= {i: t for t, i in self.special.items()}
        self.special_at = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))) if added else None
        self.between_white, self.printable = self._quick(spec["normalizer"] or {}, spec["pre_tokenizer"] or {})

    def _quick(self, normal: dict, splitter: dict) -> tuple[bool, Callable[[str], list[str]] | None]:
        """Whether white space parts what is encoded apart, and the splitter of printable ASCII if its parts are known."""
        steps = [n["type"] for n in normal.get("normalizers", [normal] if normal else [])]
        parts = splitter.get("pretokenizers", [splitter])
        drops = parts[0].get("type") == "Split" and parts[0]["behavior"] == "Removed" and parts[0]["invert"] and "\\s" in parts[0]["pattern"].get("Regex", "")
        drops = drops and set(steps) <= {"NFC", "Lowercase", "Replace"} and all(
            n["pattern"] == {"Regex": "\\s+"} and n["content"] == " " for n in normal.get("normalizers", [normal]) if n.get("type") == "Replace"
        )
        if not drops or [p["type"] for p in parts[1:]] != ["ByteLevel"] or parts[1]["use_regex"] or parts[1]["add_prefix_space"]:
            return drops, None
        pattern = parts[0]["pattern"]["Regex"]
        if "\\p" in re.sub(r"\[[^\]]*\]", "", pattern) or re.search(r"\\[pP](?!\{[LN]\})", pattern):
            return True, None
        find = re.compile(pattern.replace("\\p{L}", "a-zA-Z").replace("\\p{N}", "0-9"), re.ASCII).findall  # letters and numbers of ASCII
        return True, (lambda text: find(text.lower())) if "Lowercase" in steps else find

    def words(self, text: bytes, seen: dict[bytes, list[str | bytes]]) -> list[str | bytes]:
        """What the splitter makes of a text: words, and ids of special tokens. ``seen`` remembers what the library has split."""
        if not self.between_white:
            return self.library_words(text.decode())
        plain_parts = self.printable and not any(s in text for s in self.special_bytes)
        if plain_parts and PRINTABLE(text):
            return self.printable(text.decode())
        is_plain = lambda u: False
        if plain_parts:
            is_plain = (lambda u: bool(PRINTABLE(u))) if CONTROL(text) else bytes.isascii
        out: list[str | bytes] = []
        for plain, units in groupby(text.split(), is_plain):
            if plain:
                out += self.printable(b" ".join(units).decode())
                continue
            for unit in units:
                if unit not in seen:
                    seen[unit] = self.library_words(unit.decode())
                out += seen[unit]
        return out

    def library_words(self, text: str) -> list[str | bytes]:
        out: list[str | bytes] = []
        at = 0
        for match in self.special_at.finditer(text) if self.special_at else ():
            out += self.plain(text[at : match.start()])
            out.append(array("i", [self.special[match[0]]]).tobytes())
            at = match.end()
        return out + self.plain(text[at:])

    def plain(self, text: str) -> list[str]:
        if text and self.library.normalizer:
            text = self.library.normalizer.normalize_str(text)
        if not text:
            return []
        splitter = self.library.pre_tokenizer
        return [w for w, _ in splitter.pre_tokenize_str(text)] if splitter else [text]

    def symbols(self, word: str) -> list[int]:
        """Ids of the characters; those that the vocabulary lacks are dropped, as the library does without an unknown token."""
        found = [*map(self.vocab.get, word[:-1]), self.vocab.get(word[-1:] + self.end)]
        return found if None not in found else [i for i in found if i is not None]


class PairIndex:
    """Cells of the symbols of distinct words, and the positions of every pair by its rank.

    A token stands in the cell where it starts; the first and the last of its cells hold how many it has, so that both
    neighbours are found from there. A cell ``STOP`` lies between words.
    """

    STOP, GONE = -1, -2

    def __init__(self, rules: Merges):
        self.rules, self.cells, self.sizes = rules, [self.STOP], [1]
        self.words: list[str] = []
        self.starts: list[int] = []
        self.places: defaultdict[int, list[int]] = defaultdict(list)

    def add(self, word: str) -> None:
        symbols, ranks, places, start = self.rules.symbols(word), self.rules.ranks, self.places, len(self.cells)
        for at, pair in enumerate(zip(symbols, symbols[1:]), start):
            rank = ranks.get(pair)
            if rank is not None:
                places[rank].append(at)
        self.cells += symbols
        self.cells.append(self.STOP)
        self.sizes += [1] * (len(symbols) + 1)
        self.starts.append(start)
        self.words.append(word)

    def merge(self) -> None:
        """Apply the active ranks in ascending order until no pair has one."""
        ranks, rules, cells, sizes, places = self.rules.ranks, self.rules, self.cells, self.sizes, self.places
        active = list(places)
        heapq.heapify(active)

        def put(rank: int, at: int) -> None:
            if rank in places:
                places[rank].append(at)
            else:
                places[rank] = [at]
                heapq.heappush(active, rank)

        while active:
            rank = heapq.heappop(active)
            left, right = rules.pairs[rank]
            made, early, done = rules.made[rank], rank in rules.early, -1
            wait = []
            for at in sorted(places.pop(rank)):  # from the left, so of overlapping places the first is merged
                beside = at + sizes[at]
                if cells[at] != left or cells[beside] != right:
                    continue  # changed by an earlier merge
                if early:
                    word = bisect.bisect(self.starts, at)
                    if word == done:
                        wait.append(at)
                        continue
                    done = word
                size = sizes[at] + sizes[beside]
                cells[beside], cells[at] = self.GONE, made
                sizes[at] = sizes[at + size - 1] = size
                follows = cells[at + size]
                if follows >= 0 and (new := ranks.get((made, follows))) is not None:
                    put(new, at)
                if cells[at - 1] != self.STOP:
                    before = at - sizes[at - 1]
                    if (new := ranks.get((cells[before], made))) is not None:
                        put(new, before)
            for at in wait:
                put(rank, at)

    def ids(self) -> Iterator[tuple[str, bytes]]:
        """Words and their ids, four bytes an id."""
        ends = [*self.starts[1:], len(self.cells)]
        for word, start, end in zip(self.words, self.starts, ends):
            yield word, array("i", [i for i in self.cells[start : end - 1] if i >= 0]).tobytes()


class Encoder:
    """Ids of texts; words of one task are remembered up to a number of bytes."""

    def __init__(self, rules: Merges, symbols: int = SYMBOLS, remembered: int = REMEMBERED):
        self.rules, self.most, self.remembered = rules, symbols, remembered
        self.forget()

    def forget(self) -> None:
        special = (array("i", [i]).tobytes() for i in self.rules.special.values())
        self.known: dict[str | bytes, bytes] = {ids: ids for ids in special}
        self.seen: dict[bytes, list[str | bytes]] = {}
        self.size = self.seen_size = 0

    def learn(self, words: Iterable[str]) -> None:
        index = PairIndex(self.rules)
        for word in words:
            index.add(word)
            if len(index.cells) > self.most:
                self._finish(index)
                index = PairIndex(self.rules)
        self._finish(index)

    def _finish(self, index: PairIndex) -> None:
        index.merge()
        for word, ids in index.ids():
            self.known[word] = ids
            self.size += 190 + len(word) + len(ids)  # two objects and a place in the dictionary

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, four bytes an id."""
        if self.size > self.remembered:
            self.forget()
        before = len(self.seen)
        split = [self.rules.words(t, self.seen) for t in texts]
        self.seen_size += 300 * (len(self.seen) - before)
        if self.seen_size > self.remembered // 2:
            self.seen, self.seen_size = {}, 0
        new: set[str | bytes] = set()
        for words in split:
            new.update(words)
        self.learn(new.difference(self.known))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


def rules_of(path: str) -> Merges:
    """The file's rules, read once per worker: their size is that of the file."""
    cache = worker_cache("bpe")
    if path not in cache:
        cache[path] = Merges(path)
    return cache[path]


def groups(batches: Iterable[pa.RecordBatch], size: int = GROUP) -> Iterator[pa.RecordBatch]:
    """Batches of rows with about ``size`` bytes of text in their last column, however they came."""
    for batch in batches:
        offsets = [v.as_buffer().size for v in batch.columns[-1]]
        start = held = 0
        for i, n in enumerate(offsets):
            held += n
            if held >= size:
                yield batch.slice(start, i + 1 - start)
                start, held = i + 1, 0
        if start < batch.num_rows or not batch.num_rows:
            yield batch.slice(start)


def _ids_array(found: list[bytes]) -> pa.ListArray:
    offsets = pa.array([0, *accumulate(len(ids) // 4 for ids in found)], pa.int32())
    flat = b"".join(found)
    return pa.ListArray.from_arrays(offsets, pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)]))


def _encode(path: str, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rules_of(path))
        for batch in groups(batches):
            ids = _ids_array(encoder.encode([v.as_buffer().to_pybytes() for v in batch.column(1)]))
            columns = {"doc_id": batch.column(0), "ids": ids}
            if with_text:
                columns["decoded"] = decode_ids(ids, encoder.rules)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def decode_ids(ids: pa.ListArray, rules: Merges) -> pa.Array:
    """Text of each list of ids, null for null; ids that the file lacks give nothing."""
    if rules.library.decoder is not None:
        return pa.array([None if i is None else rules.library.decode(i, skip_special_tokens=False) for i in ids.to_pylist()], pa.string())
    flat = ids.flatten()
    tokens = pa.array([rules.names.get(i) for i in range(max(rules.names) + 1)], pa.string())
    inside = pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens)))
    found = tokens.take(pc.if_else(inside, flat, None))
    if found.null_count:
        return pa.array([None if i is None else " ".join(rules.names[x] for x in i if x in rules.names) for i in ids.to_pylist()], pa.string())
    offsets = pa.array([0, *accumulate(pc.fill_null(pc.list_value_length(ids), 0).to_pylist())], pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(offsets, found), " ")
    return pc.if_else(pc.is_null(ids), None, joined)


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = rules_of(path)
        for batch in batches:
            start = held = 0  # a few million ids at once, or one row
            for i, n in enumerate([*pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_pylist(), IDS]):
                held += n
                if held > IDS and i > start or i == batch.num_rows:
                    part = batch.slice(start, i - start)
                    yield pa.RecordBatch.from_arrays([*part.columns, decode_ids(part.column(1), rules)], [*batch.schema.names, "decoded"])
                    start, held = i, n

    return run


def encode(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """doc_id and ids of each row; ``with_text`` adds the text that the ids decode to, in the same pass."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (", decoded string" if with_text else "")
    return map_batches(docs.select("doc_id", text_or_empty().cast("binary").alias("text")), _encode(path, with_text), schema)


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the decoded text of each row of ``doc_id`` and ``ids``; unknown ids give nothing, null ids null."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows.select("doc_id", F.col("ids").cast("array<int>").alias("ids")), _decode(path), f"doc_id {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame) -> DataFrame:
    """Number and hashes of ids and decoded text."""
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )
