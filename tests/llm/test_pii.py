"""Spans against a plain reading of the patterns."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from partgraph.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = ["ä", "中", "😀", "é", "\x00", "\x01", "ſ", "K"]


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (2 * d > 9)
    return total % 10 == 0


def keeps(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind != "phone" or 9 <= len(digits) <= 15


def expected(text):
    spans = [
        (m.start(), rank, m.end(), kind)
        for rank, (kind, pattern) in enumerate(PATTERNS.items())
        for m in re.finditer(pattern, text)
        if keeps(kind, m[0])
    ]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    return [sum(s[3] == k for s in spans) for k in PATTERNS], hashlib.sha256(joined.encode()).hexdigest(), joined


def check(documents, texts):
    rows = {r.doc_id: r for r in pii.span_report(documents(list(enumerate(texts)))).collect()}
    assert len(rows) == len(texts)
    for i, text in enumerate(texts):
        counts, digest, joined = expected(text or "")
        assert [rows[i].n_email, rows[i].n_ip, rows[i].n_card, rows[i].n_phone] == counts, text
        assert rows[i].base_sha256 == digest, (text, joined, rows[i].spans)


PIECES = ["a.b@c.de", "x@y", "@", ".", "1.2.3.4", "256.1.1.1", "4041894974608795", "4041 8949 7460 8795", "-", " ", "+1 (988) 555-2485", "+", "(", "9", "12", "\n"]


def test_random_texts(documents):
    rng = random.Random(5)
    texts = ["".join(rng.choice(PIECES + ODD + list("ab0159")) for _ in range(rng.randrange(40))) for _ in range(400)]
    check(documents, texts)


def test_edges(documents):
    long = "word " * 30_000 + " a@b.co " * 300 + "1" * 5000
    check(documents, ["", None, "a@b.c_d@e.f", "001.2.3.4", "a" * 50_000, "x@" + "a." * 20_000 + "b", long, "1.2.3.4.5.6.7.8", "+1234567890 4041894974608795"])
    check(documents, [])


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="ab@.+-() 0123456789\n", max_size=60), min_size=40, max_size=80))
def test_generated(documents, texts):
    check(documents, texts)


def test_added_kinds_and_context(documents):
    texts = ["IBAN DE89370400440532013000 ok", "DE89370400440532013001", "my ssn 123-45-6789", "part 123-45-6789", "call 555-123-4567 now", "x 555-123-4567"]
    spans = [r.spans for r in pii.span_report(documents(list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert ["iban" in spans[0], "iban" in spans[1], "ssn" in spans[2], "ssn" in spans[3]] == [True, False, True, False]
    assert ["phone_local" in spans[4], "phone_local" in spans[5]] == [True, False]


def test_iban_before_capitals(documents):
    ibans = ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "NO9386011117947", "FR1420041010050500013M02606"]
    ends = [" BIC COBADEFF", " Please pay", " 12 EUR", " A", ".", " DE89370400440532013000", " ok"]
    texts = [f"REF AB12 {iban}{end}" for iban in ibans for end in ends] + ["DE89370400440532013000X", "DE89370400440532013001 BIC"]
    rows = pii.span_report(documents(list(enumerate(texts)))).orderBy("doc_id").collect()
    for i, (row, text) in enumerate(zip(rows, texts)):
        found = [tuple(map(int, s.split(":")[1:])) for s in row.spans.split(",") if s.startswith("iban")]
        values = [text[a:b] for a, b in found]
        assert values[:1] == (ibans[i // len(ends) : i // len(ends) + 1] if i < len(ibans) * len(ends) else []), (text, values)
        assert len(values) == (0 if i >= len(ibans) * len(ends) else 2 if text.endswith("3000") and i % len(ends) == 5 else 1)


def test_redact(documents):
    docs = documents([(1, "to a@b.de and 1.2.3.4!"), (2, None), (3, "ä +1 (988) 555-2485, 4041894974608795"), (None, "x"), (3, "same")])
    out = pii.redact(docs)
    assert out.columns == docs.columns
    texts = [(r.doc_id, r.text, r.n_chars) for r in out.collect()]
    assert (1, "to <EMAIL> and <IP>!", 20) in texts
    assert (2, None, None) in texts and (None, "x", 1) in texts and (3, "same", 4) in texts
    assert any(t == "ä <PHONE>, <CARD>" for _, t, _ in texts)


def test_secrets(documents):
    """A known prefix or a word near it proposes, mixed characters confirm."""
    hex40, key = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8", "AKIA" + "J5QZ7TN2WB4XK8LD"
    rows = [
        (1, f'to token = "{hex40}" then'), (2, f"commit {hex40} of the file"), (3, f"use {key} here"), (4, "token = " + "a1" * 20), (5, "secret: " + "averylongwordwithoutanydigits"),
        (6, f"é password={hex40[:24]}### x"), (7, "token " + "7" * 30), (8, f"x{key}"), (9, "Bearer " + "eyJhbGciOi9JIUzI1NiIsInR5cCI6Ikp" + " end"), (10, "token = " + hex40 * 3000),
    ]
    found = {r.doc_id: [s for s in r.spans.split(",") if s.startswith("secret")] for r in pii.span_report(documents(rows)).collect()}
    assert found == {
        1: ["secret_assigned:12:52"], 2: [], 3: ["secret:4:24"], 4: [], 5: [], 6: ["secret_assigned:11:35"], 7: [], 8: [],
        9: ["secret:7:39", "secret_assigned:7:39"], 10: ["secret_assigned:8:120008"],
    }
    masked = {r.doc_id: r.text for r in pii.redact(documents(rows)).collect()}
    assert masked[1] == 'to token = "<SECRET_ASSIGNED>" then' and masked[2] == rows[1][1] and masked[3] == "use <SECRET> here"
    assert masked[9] == "Bearer <SECRET> end"
