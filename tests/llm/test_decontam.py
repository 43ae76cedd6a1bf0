"""Leaks: planted verbatim, re-parameterised and look-alike passages."""

import random
import re

from partgraph.llm import decontam
from partgraph.llm.common import Scratch

ITEMS = "item_id long, text string, doc_id int, place string"
QUESTION = "A train with Alice leaves the station at 9 and covers 120 km in 3 hours. How far does the train of Alice go in 5 hours at that speed?"
PLAIN = "The quick brown fox of the old village jumps over a lazy dog that sleeps beside the warm stove all day long."


def items(llm, rows):
    return llm.createDataFrame([(i, t, 7, "x") for i, t in rows], ITEMS)


def found(llm, documents, docs, bench=((1, QUESTION), (2, PLAIN), (3, None), (4, "too short"), (2, PLAIN))):
    return {(r.doc_id, r.item_id) for r in decontam.leaks(documents(docs), items(llm, bench), Scratch(llm, "test")).collect()}


def test_planted(llm, documents):
    rng = random.Random(2)
    filler = lambda n: " ".join(rng.choice(["sun", "moon", "river", "bird", "stone"]) + str(rng.randrange(9)) for _ in range(n))
    other = QUESTION.replace("Alice", "Robert").replace("120", "1,350.5").replace("9", "7").replace(" 3 ", " 4 ").replace(" 5 ", " 11 ")
    mixed = other.replace("train of Robert", "train of Susan")  # one name in the question, two here
    docs = [
        (1, filler(13) + ". " + QUESTION + " " + filler(40)),
        (2, filler(200) + "\n" + other),
        (3, mixed),
        (4, filler(300)),
        (5, PLAIN.upper() + filler(3)),
        (6, " ".join(PLAIN.split()[6:]) + "\n" + filler(9)),
        (7, " ".join(PLAIN.split()[:9]) + " " + filler(90)),
        (8, None),
        (9, ""),
        (None, PLAIN),
        (11, "<p> <n> " + PLAIN.replace(" ", " \n ")),
    ]
    docs += [(100 + i, filler(i) + " " + PLAIN + " " + filler(50)) for i in range(12)] + [(1, docs[0][1])]
    expected = {(1, 1), (2, 1), (5, 2), (6, 2), (None, 2), (11, 2)} | {(100 + i, 2) for i in range(12)}
    assert found(llm, documents, docs) == expected
    kept = decontam.without_leaks(documents(docs), items(llm, [(1, QUESTION), (2, PLAIN)]), Scratch(llm, "test"))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "7", "8", "9"]
    assert kept.columns == documents([]).columns


def test_behind_percent_signs(llm, documents):
    front = "Some 5% of all, 7 % of most and 50% of 12 km in Ankara by İzmir were kept. " * 4
    share = "If 20% of the workers leave and 35 % of the others stay for 3 hours, how many % remain in the old mill then?"
    docs = [(1, front + PLAIN), (2, "word " + share), (3, share.replace("20%", "15%").replace("35 %", "40 percent"))]
    assert found(llm, documents, docs, [(2, PLAIN), (5, share)]) == {(1, 2), (2, 5), (3, 5)}
    forms = documents(docs).select(*(decontam.words(decontam.text_or_empty(), v).alias(f"w{v}") for v in (False, True))).collect()
    assert all(len(r.wFalse) == len(r.wTrue) for r in forms)


def test_short_items(llm, documents):
    bench = [(1, "What is the capital of France?"), (2, "Paris"), (3, "Add 5 to 7."), (4, "what is the capital of spain"), (5, "")]
    docs = [
        (1, "he asked What is the capital of France? It is PARIS."),
        (2, "what is the capital of France"),
        (3, "then Add 5 to 7. " * 3),
        (4, "then add 5 to 8 in Madrid"),
        (5, "the capital of France"),
        (6, "paris"),
        (7, ""),
        (8, None),
    ]
    assert found(llm, documents, docs, bench) == {(1, 1), (1, 2), (2, 1), (3, 3), (6, 2)}


def test_copies_full_of_values(llm, documents):
    sums = "Add 12 and 15 and 18 km, 21 km, 24 km, 3 hours, 5 hours, 17.5, 18, 19, 20 and 21."
    names = "Present were Alice, Bob, Carol, Dave, Erin, Frank, Grace, Heidi, Ivan, Judy, Mallory and Niaj."
    other = "Add 13 and 16 and 19 km, 22 km, 25 km, 4 hours, 6 hours, 18.5, 11, 10, 29 and 22."
    twice = QUESTION.replace("train of Alice", "train of Susan")
    docs = [(1, "so: " + sums + " Good."), (2, names), (3, other), (4, twice)]
    assert found(llm, documents, docs, [(1, sums), (2, names), (3, QUESTION)]) == {(1, 1), (2, 2), (4, 3)}


def test_names_of_other_length_and_one_conflict(llm, documents):
    item = "Every day the baker gives John Smith in New York four fresh loaves of bread and the butcher sends him 3 sausages before noon."
    moved = "One morning we saw the miller carry 12 sacks of flour over the old stone bridge while the rest of the village was still asleep."
    twelve = "a has 1 cup b has 2 cups c has 3 cups d has 4 cups e has 5 cups f has 6 cups g has 7 cups h has 8 cups and then a gives 1 cup and b gives 2 cups"
    other = twelve
    for i, value in enumerate("1 2 3 4 5 6 7 8".split()):
        other = other.replace(f" {value} ", f" {50 + i} ")
    docs = [
        (1, "so " + item.replace("John Smith", "Ann").replace("New York", "Paris").replace("3", "7")),
        (2, moved.replace("carry 12 sacks", "carry slowly and with great care 12 sacks")),
        (3, other.replace("b gives 51", "b gives 99")),
    ]
    assert found(llm, documents, docs, [(1, item), (2, moved), (3, twelve)]) == {(1, 1), (2, 2), (3, 3)}


def test_tables_of_numbers_meet_only_copies(llm, documents):
    """Blocks of nothing but numbers and units: no row for each pair of a document's and an item's."""
    rng = random.Random(5)
    table = lambda n: " ".join(f"{rng.randrange(10**6)} km {rng.randrange(10**6)}" for _ in range(n))
    bench = [(i, table(30)) for i in range(40)]
    docs = [(1, table(4000)), (2, table(50) + " " + bench[7][1] + " " + table(50)), (3, "so " + QUESTION + " " + table(300))]
    bench.append((99, QUESTION.replace("120", "240").replace("Alice", "Bob")))
    found_rows = decontam.candidates(documents(docs), items(llm, bench)).collect()
    assert len(found_rows) < 500
    assert found(llm, documents, docs, bench) == {(2, 7), (3, 99)}


def plain_leaks(docs, bench):
    """(document, item) of items that stand word for word in a text, by reading all of it."""
    plain = lambda t: " " + " ".join(re.findall(r"[a-z0-9]+", (t or "").lower())) + " "
    return {(d, i) for d, t in docs for i, b in bench if plain(b).strip() and plain(b) in plain(t)}


def test_against_brute_force(llm, documents):
    """Copies: all of them, and nothing else. Edited copies with one word in ten changed: nine of ten at least."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    some = lambda n: [str(rng.randrange(900)) if rng.random() < 0.1 else rng.choice(vocabulary) for _ in range(n)]
    bench = [(i, " ".join(some(rng.randrange(1, 45)))) for i in range(60)]
    docs, edited = [], set()
    for d in range(300):
        body = some(rng.randrange(0, 200))
        item, text = bench[rng.randrange(60)]
        words = text.split()
        if d % 3 == 1:
            body[len(body) // 2 : 0] = words
            body = some(9) + words + body
        if d % 3 == 2 and len(words) >= 20:
            changed = [rng.choice(vocabulary) if i % 12 == 11 else w for i, w in enumerate(words)]
            body += changed
            edited.add((d, item))
        docs.append((d, " ".join(body)))
    got, copies = found(llm, documents, docs, bench), plain_leaks(docs, bench)
    assert copies <= got and got <= copies | edited
    assert len(edited) > 30 and len(got & edited) >= 0.9 * len(edited)


def test_nothing(llm, documents):
    assert found(llm, documents, []) == set()
    assert found(llm, documents, [(1, PLAIN)], []) == set()
    assert found(llm, documents, [(1, "1 2 3 4 5 6 7 8 9 10 11 12")], [(1, "9 8 7 6 5 4 3 2 1 10 20 30")]) == set()


def test_long_text(llm, documents):
    long = "word " * 100_000 + PLAIN + " word" * 1000
    assert found(llm, documents, [(1, long)]) == {(1, 2)}
