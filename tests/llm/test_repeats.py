"""Repeated sentence spans against a plain reading."""

import random
import re

from partgraph.llm import repeats

SENTENCE = re.compile(r"\S[^\n]*?(?:[.!?]+(?=\s|$)|(?=\n|$))")


def runs_of(words, span, min_words, whole):
    """(first sentence, sentences) of each run."""
    for i in range(len(words)):
        for size in range(span, len(words) - i + 1):
            if sum(map(len, words[i : i + size])) >= min_words:
                yield i, size
                break
            if not whole:
                break
        if whole and len(words[i]) >= 20:
            yield i, 1


def brute(rows, span, min_words, whole=False):
    """Removed spans of each (id, text), which the order by id stands in for."""
    seen, out = {}, {}
    for doc_id, text in sorted(rows):
        places = [m.span() for m in SENTENCE.finditer(text)]
        words = [text[a:b].lower().split() for a, b in places]
        for i, size in runs_of(words, span, min_words, whole):
            key = tuple(map(tuple, words[i : i + size]))
            if key in seen:
                out.setdefault(doc_id, []).append((places[i][0], places[i + size - 1][1], seen[key]))
            else:
                seen[key] = doc_id
    merged = {}
    for doc_id, spans in out.items():
        joined = []
        for a, b, _ in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        merged[doc_id] = (",".join(f"{a}:{b}" for a, b in joined), sorted({f for *_, f in spans}))
    return merged


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice(["the", "cat", "Sät", "on", "a", "mat", "ü", "run", "3.5", "Mr."])
    pool = [" ".join(word() for _ in range(rng.randrange(1, 9))) + rng.choice([".", "!", "?!", ""]) for _ in range(40)]
    return [(i, "".join(rng.choice(pool) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randrange(12)))) for i in range(120)]


def test_against_brute_force(documents, scratch):
    for span, least in ((2, 4), (3, 1)):
        rows = corpus(span)
        found = {r.doc_id: (r.removed, r.first_doc_ids) for r in repeats.removed_spans(documents(rows), scratch, span, least).collect()}
        assert found == brute(rows, span, least)
        scratch.drop("first", "runs")


def test_query_against_brute_force(documents, scratch):
    """The settings that the registered query has."""
    rng = random.Random(11)
    words = ["one", "Two", "three", "ä", "so", "it", "goes"]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    pool = [line(rng.randrange(1, 5)) + "." for _ in range(30)] + [line(rng.randrange(18, 24)) + "!" for _ in range(12)]
    passages = [" ".join(rng.choice(pool) for _ in range(rng.randrange(1, 8))) for _ in range(30)]
    rows = [(i, "\n".join(rng.choice([*passages, *pool]) for _ in range(rng.randrange(6)))) for i in range(150)]
    found = {r.doc_id: (r.removed, r.first_doc_ids) for r in repeats.removed_spans(documents(rows), scratch, whole=True).collect()}
    assert found == brute(rows, repeats.SPAN, repeats.MIN_WORDS, True) and len(found) > 50


def test_texts_without_the_spans(documents, scratch):
    one, two = "One two three four. Five six seven eight.", "Alone here today is nobody at all. "
    docs = documents([(1, one), (2, two + one + " End."), (3, None), (None, ""), (5, one.upper()), (5, one.upper())])
    out = repeats.remove_repeats(docs, scratch)
    assert out.columns == docs.columns
    texts = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert texts == sorted([(1, one), (2, two + " End."), (3, None), (None, ""), (5, ""), (5, "")], key=str)


def test_short_lines_and_long_sentences(documents, scratch):
    verse = "\n".join(["Come.", "Go home.", "Why?", "No one knows.", "So it is.", "Yes."] * 3)
    long = "This one sentence goes on " + " ".join(f"and on {i}" for i in range(20)) + "."
    rows = [(1, "First is here.\n" + verse + "\nEnd a."), (2, "Next is there.\n" + verse.upper() + "\nEnd b."), (3, "One. " + long + " Two."), (4, "Six. " + long + " Ten."), (5, long), (6, "Go home.\nWhy?")]
    kept = {r.doc_id: r.text.split() for r in repeats.remove_repeats(documents(rows), scratch).collect()}
    assert kept[2] == "Next is there. End b.".split() and kept[4] == ["Six.", "Ten."] and kept[5] == []
    assert kept[3] == rows[2][1].split() and kept[6] == ["Go", "home.", "Why?"]
    assert kept[1][:9] == rows[0][1].split()[:9] and kept[1][-2:] == ["End", "a."]
    places = [(i, a) for i, a, *_ in repeats.runs(verse, 2, 8, True)]
    assert len(places) == len(set(places)) and len(places) > 10


def test_nothing_and_long_texts(documents, scratch):
    assert repeats.removed_spans(documents([]), scratch).count() == 0
    scratch.drop("first", "runs")
    long = "word " * 50_000 + ". " + "Same old line here. Another old line there.\n" * 2000
    (row,) = repeats.removed_spans(documents([(1, long)]), scratch).collect()
    assert row.first_doc_ids == [1] and row.n_runs >= 3990
