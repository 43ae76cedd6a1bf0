"""Chat formatting with the template as a black box: prefixes of turns are rendered one after the other.

A template is a function from a list of turns to text. Comparing the rendering of k turns with that of k - 1 gives the
place of turn k; where the shorter one is not a beginning of the longer, the template rewrites history,
which is reported with the place up to which both agree. Rendering the last turn with two other texts shows which part
of its span is its text. The loss mask covers the text of each assistant turn.

Rows are dealt by conversation, sorted and streamed: a task holds one conversation's prefix at a time. Of a template that is ``joined``
from turns it holds no more than the look-back, so a conversation of any length takes bounded memory. Of others it holds the whole conversation:
that one looks back no further than it says is tested. At 64, 128, ... turns, and at the end, whatever the conversation's size, all turns are
rendered at once. Where that is not what stands so far, the rewrite is reported there, and the rest of the conversation is rendered from its whole prefix.

Turns go by turn, then role, then text. Null turn numbers come first; null role and text are empty; rows
without a conversation id form one conversation; repeated rows are turns of their own. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partgraph.llm.common import map_batches, text_or_empty

#: A turn is (role, text).
Turn = tuple[str, str]
#: Prefixes of up to so many turns are rendered whole even if the template looks back less far.
WHOLE = 32
#: Characters of pieces that a task holds before it hands them on.
HELD = 1 << 22
LEARNT_ROLE = "assistant"
# The control strings of the template.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


@dataclass(frozen=True)
class Template:
    """``render`` makes text of turns. ``look_back``: a turn's text depends on no more turns before it; None: on any.

    ``joined``: ``render`` itself joins what it makes of each turn and the ``look_back`` before it, so there is nothing to test.
    """

    render: Callable[[list[Turn]], str]
    look_back: int | None = None
    joined: bool = False


def escape(text: str) -> str:
    """No ``<|`` is left: one more backslash stands between the two characters."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """Also free of line ends, which close the role."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def render_turns(turns: list[Turn]) -> str:
    return "".join(f"{OPEN}{escape_role(role)}\n{escape(text)}{CLOSE}\n" for role, text in turns)


MARKED = Template(render_turns, look_back=0, joined=True)
PIECES = "conv_id long, turn_no long, start long, keep long, text_start long, text_end long, loss boolean, piece string"
ARROW = pa.schema(
    [("conv_id", pa.int64()), ("turn_no", pa.int64()), ("start", pa.int64()), ("keep", pa.int64()), ("text_start", pa.int64())]
    + [("text_end", pa.int64()), ("loss", pa.bool_()), ("piece", pa.string())]
)


def shared_front(a: str, b: str) -> int:
    return len(os.path.commonprefix([a, b]))


def text_place(template: Template, before: list[Turn], role: str, whole: str) -> tuple[int, int]:
    """Where the last turn's text stands in ``whole``: between what two other texts leave the same."""
    one, two = (template.render([*before, (role, probe)]) for probe in ("A", "B"))
    front = shared_front(one, two)
    back = shared_front(one[::-1], two[::-1])
    return front, max(front, len(whole) - back)


class Conversation:
    """Pieces of one conversation, turn by turn. ``keep``: characters of the text so far that still stand before the piece."""

    def __init__(self, template: Template, conv_id: int | None):
        self.template, self.conv_id, self.look_back = template, conv_id, template.look_back
        self.turns: list[Turn] = []  # those that the next one is rendered behind
        self.before, self.count = template.render([]), 0
        self.length = len(self.before)
        self.row: dict = {}  # of the last turn
        self.held: list[Turn] | None = None if self.look_back is None or template.joined else []
        self.pieces = [self.before]  # what the held turns became

    def add(self, role: str, text: str) -> None:
        whole = self.template.render([*self.turns, (role, text)])
        shared = len(self.before) if whole.startswith(self.before) else shared_front(self.before, whole)
        front, back = text_place(self.template, self.turns, role, whole)
        base = self.length - len(self.before)  # what the turns no longer held had rendered to
        lead = shared if self.count else 0
        start = base + lead
        self.row = {
            "conv_id": self.conv_id,
            "turn_no": self.count,
            "start": start,
            "keep": start,
            "text_start": base + front,
            "text_end": base + back,
            "loss": role == LEARNT_ROLE,
            "piece": whole[lead:],
        }
        if self.held is not None:
            self.held.append((role, text))
            if start < self.length:
                self.pieces = ["".join(self.pieces)[:start]]
            self.pieces.append(whole[lead:])
        self.turns.append((role, text))
        self.before, self.length, self.count = whole, base + len(whole), self.count + 1
        if self.count & (self.count - 1) == 0:
            self.test()
        if self.look_back is not None and len(self.turns) > max(WHOLE, self.look_back):
            self.turns = self.turns[len(self.turns) - self.look_back :] if self.look_back else []
            self.before = self.template.render(self.turns)

    def test(self) -> None:
        """Render all turns at once; if that is not what stands so far, the last row rewrites it and the look-back no longer counts."""
        if self.held is None or len(self.held) == len(self.turns):
            return
        whole, so_far = self.template.render(self.held), "".join(self.pieces)
        if whole == so_far:
            return
        keep = shared_front(so_far[: self.row["keep"]], whole)
        *earlier, (role, _) = self.held
        front, back = text_place(self.template, earlier, role, whole)
        self.row |= {"start": keep, "keep": keep, "text_start": front, "text_end": back, "piece": whole[keep:]}
        self.turns, self.before, self.length = self.held, whole, len(whole)
        self.look_back, self.held, self.pieces = None, None, []

    def last(self) -> dict:
        """The last turn's row, once no other follows."""
        self.test()
        return self.row


def _format(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rows, size = None, [], 0
        for batch in batches:
            for conv_id, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                same = current is not None and current.conv_id == conv_id
                if current is not None:
                    rows.append(current.row if same else current.last())
                    size += len(rows[-1]["piece"])
                if not same:
                    current = Conversation(template, conv_id)
                current.add(role, text)
                if len(rows) >= 1000 or size > HELD:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                    rows, size = [], 0
        if current is not None:
            rows.append(current.last())
        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return run


def format_turns(turns: DataFrame, template: Template = MARKED) -> DataFrame:
    """One row per turn, in order within its conversation: the characters it adds, where they and the turn's text stand.

    A conversation's formatted text is made by taking each row's piece after the first ``keep`` characters of the
    text so far. ``keep`` is less than the length so far only where the template rewrote history.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        text_or_empty("role").alias("role"),
        text_or_empty().alias("text"),
        F.col("turn").cast("long").alias("turn"),
    )
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(placed.select("conv_id", "role", "text"), _format(template), PIECES)


def rewritten(pieces: DataFrame) -> DataFrame:
    """Turns at which a template changed what it had rendered for the turns before."""
    joined = pieces.select("conv_id", "turn_no", "keep", (F.col("keep") + F.length("piece")).alias("length"))
    earlier = joined.select("conv_id", (F.col("turn_no") + 1).alias("turn_no"), F.col("length").alias("length_before"))
    pairs = joined.join(earlier.withColumnRenamed("conv_id", "id"), (F.col("conv_id").eqNullSafe(F.col("id"))) & (joined.turn_no == earlier.turn_no))
    return pairs.where("keep < length_before").select("conv_id", joined.turn_no, F.col("keep").alias("agree_until"))


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
READ_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
    + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)
TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.S)


class Reader:
    """Reads formatted text of MARKED back as it comes in, and the loss mask over it."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.turns, self.chars, self.loss_chars, self.open = conv_id, 0, 0, 0, ""
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, row: dict) -> None:
        if row["keep"] != self.chars:
            raise ValueError(f"conversation {self.conv_id} was rewritten at turn {row['turn_no']}")
        self.open += row["piece"]
        self.chars += len(row["piece"])
        at = 0
        for match in TURN.finditer(self.open):
            self.turns += 1
            self.all.update(f"{unescape_role(match[1])}\n{unescape(match[2])}\n".encode())
            at = match.end()
        self.open = self.open[at:]
        if row["loss"]:
            masked = unescape(row["piece"][row["text_start"] - row["start"] : row["text_end"] - row["start"]])
            self.loss_chars += len(masked)
            self.loss.update(masked.encode())

    def result(self) -> dict:
        if self.open:
            raise ValueError(f"conversation {self.conv_id} ends inside a turn")
        return {
            "conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current, out = None, []
    for batch in batches:
        for row in batch.to_pylist():
            if current is None or current.conv_id != row["conv_id"]:
                if current:
                    out.append(current.result())
                current = Reader(row["conv_id"])
            current.add(row)
        if len(out) >= 1000:
            yield pa.RecordBatch.from_pylist(out, schema=READ_ARROW)
            out = []
    if current:
        out.append(current.result())
    yield pa.RecordBatch.from_pylist(out, schema=READ_ARROW)


def read_back(pieces: DataFrame) -> DataFrame:
    """Digest of each conversation as parsed from ``format_turns``'s output, which must not be dealt anew before."""
    return map_batches(pieces, _read_back, READ)
