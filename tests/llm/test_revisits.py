"""Revisits against a plain walk over time."""

import random

import pytest

from partgraph.llm import revisits

SCHEMA = (
    "record_id long, kind string, url string, time long, headers map<string,string>, digest string, payload string, part int, response_id string"
)


def table(llm, rows):
    return llm.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


def brute(rows):
    usable = sorted((r for r in rows if None not in r[:4]), key=lambda r: (r[2], r[3], r[0], r[1] != "response"))
    out, last = {}, {}
    for record, kind, url, _, headers, digest, payload in usable:
        if kind == "response":
            last[url] = (record, headers or {}, digest, payload)
            continue
        headers, full = headers or {}, last.get(url)
        if not full:
            out[record] = (None, "missing", None, None)
            continue
        strip = lambda h: h.get("etag") and h["etag"].removeprefix("W/")
        pairs = [(strip(headers), strip(full[1])), (headers.get("last-modified"), full[1].get("last-modified")), (digest, full[2])]
        agree = next((a == b for a, b in pairs if a is not None and b is not None), True)
        merged = {**full[1], **{k: v for k, v in headers.items() if k in revisits.PERMITTED and v is not None}}
        out[record] = (full[0], "resolved", merged, full[3]) if agree else (full[0], "mismatch", None, None)
    return out


def made(seed, count):
    rng = random.Random(seed)
    url = lambda: "https://hot.example.com/a" if rng.random() < 0.4 else f"https://h{rng.randrange(8)}.example.com/{rng.randrange(30)}"
    headers = lambda: {
        k: v
        for k, v in (("etag", rng.choice(["W/", ""]) + rng.choice("ab")), ("last-modified", rng.choice("xy")), ("server", str(rng.randrange(9))), ("date", str(rng.randrange(99))))
        if rng.random() < 0.7
    }
    return [
        (i, rng.choice(["response", "revisit", "revisit", "revisit"]), url(), rng.randrange(200), headers() if rng.random() < 0.9 else None, rng.choice(["p", "q", None]), f"body {i}")
        for i in range(count)
    ]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_a_walk(llm, scratch, seed):
    rows = made(seed, 700)
    found = {r.record_id: (r.response_id, r.status, r.headers, r.payload) for r in revisits.resolve(table(llm, rows), scratch).collect()}
    assert found == brute(rows)


def test_odd_rows(llm, scratch):
    rows = [
        (1, "response", "http://A.example.com:80/x/?b=2&a=1&utm_source=f#top", 1, None, None, "one"),
        (2, "revisit", "https://a.example.com/x?a=1&b=2", 2, None, None, None),
        (3, "revisit", None, 2, None, None, None),
        (4, "revisit", "https://a.example.com/x?a=1&b=2", None, None, None, None),
        (None, "revisit", "https://a.example.com/x?a=1&b=2", 5, None, None, None),
        (6, None, "https://a.example.com/x?a=1&b=2", 5, None, None, None),
        (7, "revisit", "", 5, None, None, None),
        (2, "revisit", "https://a.example.com/x?a=1&b=2", 2, None, None, None),
        (8, "revisit", "https://a.example.com/x?a=1&b=2", 1, None, None, None),
    ]
    found = sorted(((r.record_id, r.response_id, r.status, r.payload) for r in revisits.resolve(table(llm, rows), scratch).collect()), key=str)
    expected = [(2, 1, "resolved", "one")] * 2 + [(3, None, "invalid", None), (4, None, "invalid", None), (None, None, "invalid", None)]
    assert found == sorted([*expected, (7, None, "missing", None), (8, 1, "resolved", "one")], key=str)


def test_empty_table(llm, scratch):
    assert revisits.resolve(table(llm, []), scratch).count() == 0


def test_repeated_ids(llm, scratch):
    """An id that names two records leads each revisit to the response of its own URL."""
    schema = "record_id long, kind string, url string, time long, headers map<string,string>, digest string, payload string"
    rows = [
        (1, "response", "http://a/x", 1, {}, "d", "of a"), (1, "response", "http://b/x", 1, {}, "d", "of b"), (1, "response", "http://b/x", 2, {}, "d", "of b later"),
        (2, "revisit", "http://a/x", 5, {}, "d", None), (2, "revisit", "http://b/x", 5, {}, "d", None), (2, "revisit", "http://c/x", 5, {}, "d", None),
        (2, "revisit", "http://a/x", 5, {}, "d", None), (None, "revisit", "http://a/x", 5, {}, "d", None),
    ]
    found = revisits.resolve(llm.createDataFrame(rows, schema), scratch).collect()
    assert sorted((str(r.record_id), r.url, r.status, str(r.payload)) for r in found) == [
        ("2", "http://a/x", "resolved", "of a"), ("2", "http://a/x", "resolved", "of a"), ("2", "http://b/x", "resolved", "of b later"),
        ("2", "http://c/x", "missing", "None"), ("None", "http://a/x", "invalid", "None"),
    ]
