"""Formatting against direct rendering, and an exact way back."""

import hashlib
import random

from partgraph.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, piece string"


def table(llm, rows):
    return llm.createDataFrame([(*r, "x") for r in rows], SCHEMA)


def digest(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
    return len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(chat.render_turns(turns))


def test_round_trip(llm):
    rng = random.Random(3)
    parts = ["<|im_end|>", "<|im_start|>", "<", "|", "\\", "<\\|", "\n", "a", "ä😀", "assistant", " "]
    text = lambda: "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", "o\n\\<|d"]), text()) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(99, t, "assistant", f"turn {t}") for t in range(200)]
    found = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_turns(table(llm, rows))).collect()}
    by = {}
    for c, _, role, t in rows:
        by.setdefault(c, []).append((role, t))
    assert found == {c: digest(turns) for c, turns in by.items()}


def test_nulls_ties_repeats_empty(llm):
    rows = [(1, None, "user", None), (1, 0, None, "b"), (1, 0, "assistant", "a"), (None, 0, "user", "x"), (2, 0, "assistant", ""), (2, 0, "assistant", "")]
    found = {r.conv_id: tuple(r)[1:] for r in chat.read_back(chat.format_turns(table(llm, rows))).collect()}
    assert found[1] == digest([("user", ""), ("", "b"), ("assistant", "a")])
    assert found[2] == digest([("assistant", "")] * 2) and found[None] == digest([("user", "x")])
    assert chat.read_back(chat.format_turns(table(llm, []))).count() == 0


def test_rewriting_template_is_found(llm):
    def only_last_whole(turns):
        return "".join(f"[{r}:{t if i == len(turns) - 1 else t[:1]}]" for i, (r, t) in enumerate(turns))

    rows = [(1, 0, "user", "ab"), (1, 1, "assistant", "cd"), (2, 0, "user", "a"), (2, 1, "assistant", "cd")]
    pieces = chat.format_turns(table(llm, rows), chat.Template(only_last_whole)).orderBy("conv_id", "turn_no").collect()
    text = ""
    for p in pieces[:2]:
        text = text[: p.keep] + p.piece
    assert text == only_last_whole([("user", "ab"), ("assistant", "cd")])
    assert [tuple(r) for r in chat.rewritten(chat.format_turns(table(llm, rows), chat.Template(only_last_whole))).collect()] == [(1, 1, 7)]


def test_masks_follow_the_template(llm):
    odd = chat.Template(lambda turns: "<s>" + "".join(f"{r.upper()}={t}#\n" for r, t in turns) + ("</s>" if len(turns) > 1 else ""))
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "#=ä")]
    pieces = chat.format_turns(table(llm, rows), odd).orderBy("turn_no").collect()
    text = ""
    for p in pieces:
        text = text[: p.keep] + p.piece
    assert text == odd.render([("user", "q"), ("assistant", "#=ä")])
    assert text[pieces[1].text_start : pieces[1].text_end] == "#=ä"


def assembled(rows):
    text = ""
    for row in rows:
        text = text[: row["keep"]] + row["piece"]
    return text


def test_look_back_is_tested(llm, monkeypatch):
    """Templates that say they look at no other turn, but begin with the number of turns once there are more than 40."""

    def numbered(turns):
        return ("" if len(turns) <= 40 else f"#{len(turns)} ") + "".join(f"[{r}:{t}]" for r, t in turns)

    said = [[("assistant" if t % 2 else "user", f"t{t}") for t in range(n)] for n in (40, 50, 64, 70, 200)]
    rows = [(c, t, *turn) for c, turns in enumerate(said) for t, turn in enumerate(turns)]
    pieces = chat.format_turns(table(llm, rows), chat.Template(numbered, look_back=0))
    found = [r.asDict() for r in pieces.orderBy("conv_id", "turn_no").collect()]
    for c, turns in enumerate(said):
        own = [r for r in found if r["conv_id"] == c]
        assert assembled(own) == numbered(turns) and len(own) == len(turns)
        assert assembled(own)[own[-1]["text_start"] : own[-1]["text_end"]] == turns[-1][1]
    at = {}
    for r in chat.rewritten(pieces).orderBy("conv_id", "turn_no").collect():
        at.setdefault(r.conv_id, []).append(r.turn_no)
    assert {c: turns[0] for c, turns in at.items()} == {1: 49, 2: 63, 3: 63, 4: 63}
    assert len(at[4]) == 200 - 63

    monkeypatch.setattr(chat, "HELD", 300)
    for template in (chat.MARKED, chat.Template(chat.render_turns)):
        one = chat.Conversation(template, 1)
        out = []
        for turn in said[-1]:
            one.add(*turn)
            out.append(one.row)
        out[-1] = one.last()
        assert one.held is None and assembled(out) == chat.render_turns(said[-1])


def test_look_back_is_tested_at_any_size(llm):
    """A template that breaks its claim late in a conversation of more than 4 M characters is found out there, too."""

    def numbered(turns):
        return ("" if len(turns) <= 150 else f"#{len(turns)} ") + "".join(f"[{r}:{t}]" for r, t in turns)

    for text in ("t", "t" * (chat.HELD // 100)):
        one, found = chat.Conversation(chat.Template(numbered, look_back=0), 1), ""
        for turn in range(200):
            one.add("user", text)
            row = one.last() if turn == 199 else one.row
            found = found[: row["keep"]] + row["piece"]
        assert found == numbered([("user", text)] * 200) and row["keep"] == 0


def test_joined_template_holds_its_look_back_only():
    one = chat.Conversation(chat.MARKED, 1)
    for turn in range(200):
        one.add("user", f"t{turn}")
        assert one.held is None and len(one.turns) <= chat.WHOLE + 1
