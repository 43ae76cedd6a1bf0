"""The pair index against the tokenizers library, on its own files and on small made-up ones."""

import hashlib
import json

import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from partgraph.llm import bpe
from partgraph.llm.queries import QUERIES

FILES = ["word_bpe_49k.json", "byte_bpe_50k.json"]
ODD = [
    "", " ", " ", "Hello <|endoftext|>World<|startoftext|><|endoftext|>", "don't WE'LL i'D 'S", "Áé ́x ǅ İ ΑΣ ΟΔΟΣ ß ﬁ", "x" * 5000,
    "ab\x00c\x1cd\x1fe\x7f f\x85g h", "１２ ² ٣ 4 55", "日本語テキスト 👩‍👩‍👧 🇩🇪", "a\tb\nc\r\nd\x0be\x0cf  g", "aaaa aaa aa a aaaaa", "﻿über�", "...!?--##",
    "İstanbul İ", "<|endoftext|", "q" * 3 + "é" * 4000,
]


def ids_of(encoder, texts):
    return [list(memoryview(i).cast("i")) for i in encoder.encode([t.encode() for t in texts])]


@pytest.fixture(scope="module", params=FILES)
def pair(request):
    path = public_tokenizers.path(request.param)
    return bpe.Merges(path), Tokenizer.from_file(path)


def test_odd_texts(pair):
    rules, library = pair
    assert ids_of(bpe.Encoder(rules), ODD) == [library.encode(t, add_special_tokens=False).ids for t in ODD]


def test_small_memory_and_index(pair):
    rules, library = pair
    texts = [t for _ in range(3) for t in ODD[:12]]
    encoder = bpe.Encoder(rules, symbols=8, remembered=500)
    found = [ids_of(encoder, texts[i : i + 5]) for i in range(0, len(texts), 5)]
    assert [x for f in found for x in f] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_any_text(pair, texts):
    rules, library = pair
    texts = [t.encode(errors="ignore").decode() for t in texts]
    assert ids_of(bpe.Encoder(rules), texts) == [library.encode(t, add_special_tokens=False).ids for t in texts]


def tiny(folder, merges, normal=None, splitter=None):
    """A file over a, b, c whose later rules may make what earlier ones use."""
    names = [*"abc", *dict.fromkeys("".join(m) for m in merges)]
    spec = {
        "version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": normal, "pre_tokenizer": splitter, "post_processor": None, "decoder": None,
        "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False,
                  "byte_fallback": False, "ignore_merges": False, "vocab": {n: i for i, n in enumerate(names)}, "merges": [list(m) for m in merges]},
    }
    path = folder / "tiny.json"
    path.write_text(json.dumps(spec))
    return str(path)


@pytest.mark.parametrize(
    "merges",
    [
        [("a", "b"), ("b", "c"), ("c", "ab"), ("bc", "a"), ("ab", "ab")],
        [("ab", "c"), ("a", "b"), ("c", "c"), ("abc", "cc"), ("a", "bcc"), ("b", "cc")],  # a rule before the one that makes its part
        [("aaa", "a"), ("a", "a"), ("aa", "a"), ("aa", "aa"), ("b", "aa")],
    ],
)
def test_rules_out_of_order(tmp_path, merges):
    path = tiny(tmp_path, merges)
    rules, library = bpe.Merges(path), Tokenizer.from_file(path)
    texts = ["".join("abc"[(n // 3**i) % 3] for i in range(7)) for n in range(3**7)] + ["a" * n for n in range(40)] + ["xaybz"]
    assert ids_of(bpe.Encoder(rules), texts) == [library.encode(t).ids for t in texts]


def test_refuses_other_models(tmp_path):
    path = tiny(tmp_path, [("a", "b")])
    spec = json.loads(open(path).read())
    spec["model"]["dropout"] = 0.1
    (tmp_path / "other.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError, match="plain BPE"):
        bpe.Merges(str(tmp_path / "other.json"))


@pytest.mark.parametrize("file", FILES)
def test_tables(documents, file):
    path = public_tokenizers.path(file)
    library = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, None), (None, "tie"), (3, ODD[3]), (99, "word " * 300_000)]
    found = bpe.decode(bpe.encode(documents(rows), path), path).collect()
    expected = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        expected.append((i, ids, library.decode(ids, skip_special_tokens=False)))
    key = lambda r: (r[0] is None, r[0], r[1])
    assert sorted(map(tuple, found), key=key) == sorted(expected, key=key)
    assert sorted(map(tuple, bpe.encode(documents(rows), path, with_text=True).collect()), key=key) == sorted(expected, key=key)
    assert bpe.decode(bpe.encode(documents([]), path), path).collect() == []


def test_null_and_unknown_ids(llm):
    path = public_tokenizers.path(FILES[0])
    rows = llm.createDataFrame([(1, None), (2, []), (3, [320, 10**6])], "doc_id long, ids array<long>")
    assert [(r.doc_id, r.decoded) for r in bpe.decode(rows, path).orderBy("doc_id").collect()] == [(1, None), (2, ""), (3, "a</w>")]


def test_query(llm):
    folder, library = "/root/testdata/sf0.001", Tokenizer.from_file(public_tokenizers.path(FILES[0]))
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    expected = []
    for row in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pylist():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        expected.append((row["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    found = QUERIES["op11_bpe_codec"](llm, folder)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, found.collect())) == sorted(expected)
