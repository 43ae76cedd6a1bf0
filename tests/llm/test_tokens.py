"""Counts and packed ids against the libraries on whole texts."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from partgraph.llm import packing, tokens

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
WORD = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " ", "  a  b \n\n c\t", "<|endoftext|> x<|endoftext|>", "l'été don't\r\n\tx", "a\xa0 b  c", "\x1c\x1d a\x85 b", "中文 字", "😀 " * 30, "x" * 3000, "a ! ?? 1.5 'll", "​ 　 z"]


def texts(count=60):
    rng = random.Random(1)
    words = ["the", "Ertion", "über", "don't", "x1", "!!", "...", "(a)", "\n", "  ", "<s>", "ñandú", "\t", "é.", "'s"]
    return ODD + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 900))) for _ in range(count)]


def library(path):
    if path.endswith(".model"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda t: model.encode(t)
    model = Tokenizer.from_file(path)
    return lambda t: model.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [BPE, PIECE, WORD])
@pytest.mark.parametrize("chunk,overlap", [(1 << 16, 512), (200, 20), (64, 3)])
def test_counts(documents, scratch, path, chunk, overlap):
    rows = list(enumerate(texts())) + [(None, "no id"), (7, "same id")]
    found = tokens.count_tokens(documents(rows), path, scratch, limit=50, chunk=chunk, overlap=overlap).collect()
    encode = library(path)
    expected = [(i, len((t or "").encode()), len(encode(t or "")), len(encode(t or "")) > 50) for i, t in rows]
    key = lambda r: (r[0] is None, r)
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)


def test_counts_of_nothing(documents, scratch):
    assert tokens.count_tokens(documents([]), PIECE, scratch).count() == 0


def check_packing(documents, rows, shard):
    found = packing.pack(documents(rows), BPE, shard=shard, with_ids=True).collect()
    encode = library(BPE)
    expected = sorted((str(i), encode(t or "") + [1]) for i, t in rows)
    by_doc, by_sequence = {}, {}
    for r in found:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_doc.setdefault(str(r.doc_id), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    whole = {}
    for i, ids in expected:
        whole.setdefault(i, []).append(ids)
    for i, pieces in by_doc.items():
        total = sum(len(ids) for ids in whole[i])
        assert sum(p.length for p in pieces) == total
        if len(whole[i]) == 1:
            pieces.sort(key=lambda p: p.start)
            assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in pieces]).tolist() == whole[i][0]
            assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
            assert {p.doc_tokens for p in pieces} == {total}
    assert set(by_doc) == set(whole)
    padded = 0
    for pieces in by_sequence.values():
        pieces.sort(key=lambda p: p.offset)
        ends = np.cumsum([p.length for p in pieces])
        assert [p.offset for p in pieces] == [0, *ends[:-1].tolist()] and ends[-1] <= 2048
        padded += int(ends[-1]) if ends[-1] & (ends[-1] - 1) == 0 else 2048
    used = sum(len(ids) for _, ids in expected)
    assert padded <= 1.01 * used


def test_packing(documents):
    rows = list(enumerate(texts(200))) + [(None, "no id"), (3, "same id")] + [(1000 + i, "copy " * 700) for i in range(300)]
    check_packing(documents, rows, 1 << 30)
    check_packing(documents, rows, 20_000)


def test_packing_of_little(documents):
    check_packing(documents, [(1, None)], 100)
    assert packing.pack(documents([]), BPE).count() == 0


def test_nnls():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.integers(0, 3, (12, 30)).astype(float), np.maximum(rng.normal(0, 2, 30), 0)
        found = packing.nnls(a, a @ x)
        assert found.min() >= 0 and np.linalg.norm(a @ found - a @ x) < 1e-3 * np.linalg.norm(a @ x)
