"""Chat formatting: a finite-state machine over roles checks the turn order and
a declarative template turns each turn into text segments with loss flags.

Each turn becomes three segments: an opening mark, the escaped text, a closing
mark; only an assistant's text is under the loss mask. Control strings inside a
text (and backslashes) get a backslash in front, so a text that contains marks
of the template can't be taken for them and every text is read back exactly.
``read_back`` parses the formatted text of each turn again and knows nothing of
the rows it came from.

One shuffle by conversation; a partition is sorted by (conversation, turn) and
streamed, with one turn in memory at a time, so a conversation with a third of
all rows needs time but not memory.

Defined cases: null text is empty; null role is the empty role; roles the
template doesn't know use its ``other`` entry, which carries the role's name; a
null conv_id is a conversation of its own; equal turn numbers are ordered by
role, then text; a turn the machine has no transition for is formatted all the
same with ``in_order`` false; an empty table gives an empty result; other
columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Marks of each role as (opening, closing, text under the loss).
TEMPLATE = {
    "roles": {
        "system": ("[SYS] ", " [/SYS]", False),
        "user": ("[INST] ", " [/INST]", False),
        "assistant": ("[ANS] ", " </s>", True),
    },
    "other": ("[TURN] {role} [SAYS] ", " [/TURN]", False),
}
# State after each role; "start" begins every conversation.
TRANSITIONS = {
    ("start", "system"): "system",
    ("start", "user"): "user",
    ("system", "user"): "user",
    ("user", "assistant"): "assistant",
    ("assistant", "user"): "user",
}


class Marks:
    """The control strings of a template, with escaping and parsing."""

    def __init__(self, template: dict):
        self.template = template
        entries = [*template["roles"].values(), template["other"]]
        controls = sorted({m for e in entries for part in e[:2] for m in part.replace("{role}", " ").split()},
                          key=lambda m: (-len(m), m))
        either = "|".join(map(re.escape, controls))
        self._escape = re.compile(rf"\\|{either}")
        self._unescape = re.compile(r"\\(.)", re.DOTALL)
        self._control = re.compile(rf"\\.|({either})", re.DOTALL)
        self._by_open = {e[0]: (role, e) for role, e in template["roles"].items()}

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        opening, closing, loss = self.template["roles"].get(role, self.template["other"])
        return [(opening.replace("{role}", self.escape(role)), False), (self.escape(text), loss), (closing, False)]

    def parse(self, formatted: str) -> tuple[str, str]:
        """(role, text) of one formatted turn."""
        for opening, (role, (_, closing, _)) in self._by_open.items():
            if formatted.startswith(opening):
                break
        else:
            begin, end = self.template["other"][0].split("{role}")
            closing = self.template["other"][1]
            says = next(m for m in self._control.finditer(formatted, len(begin)) if m[1])
            opening = formatted[:says.start() - (len(end) - len(end.lstrip()))] + end
            role = self.unescape(opening[len(begin):len(opening) - len(end)])
        marks = [m for m in self._control.finditer(formatted, len(opening)) if m[1]]
        if len(marks) != 1 or not formatted.endswith(closing):
            raise ValueError(f"not a formatted turn: {formatted[:80]!r}")
        return role, self.unescape(formatted[len(opening):len(formatted) - len(closing)])


FORMATTED = ("conv_id long, position long, in_order boolean, "
             "segments array<struct<text:string,loss:boolean>>")


def format_conversations(conversations: DataFrame, template: dict = TEMPLATE,
                         transitions: dict = TRANSITIONS) -> DataFrame:
    """One row per turn: conv_id, position (from 0), in_order, segments. Rows of
    a conversation are in one partition, in order."""
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = Marks(template)
        conv, position, state = object(), 0, "start"
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "role", "text")]
            out = []
            for c, role, text in zip(*columns):
                if c != conv:
                    conv, position, state = c, 0, "start"
                next_state = transitions.get((state, role))
                out.append({"conv_id": c, "position": position, "in_order": next_state is not None,
                            "segments": [{"text": t, "loss": x} for t, x in marks.segments(role, text)]})
                position, state = position + 1, next_state or role
            yield pa.RecordBatch.from_pylist(out, schema=_FORMATTED)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


_FORMATTED = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("in_order", pa.bool_()),
                        ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())])))])
_DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
                     ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
                     ("in_order", pa.bool_())])


class _Conversation:
    """Running digest of one conversation."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars, self.in_order = conv_id, 0, 0, 0, True
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, marks: Marks, segments: list[dict], in_order: bool) -> None:
        formatted = "".join(s["text"] for s in segments)
        role, text = marks.parse(formatted)
        self.turns, self.chars, self.in_order = self.turns + 1, self.chars + len(formatted), self.in_order and in_order
        self.all.update(f"{role}\n{text}\n".encode())
        learnt = marks.unescape("".join(s["text"] for s in segments if s["loss"]))
        self.loss_chars += len(learnt)
        self.loss.update(learnt.encode())

    def row(self) -> dict:
        return {"conv_id": self.conv_id, "n_turns": self.turns, "turns_sha256": self.all.hexdigest(),
                "loss_chars": self.loss_chars, "loss_sha256": self.loss.hexdigest(),
                "formatted_chars": self.chars, "in_order": self.in_order}


def read_back(formatted: DataFrame, template: dict = TEMPLATE) -> DataFrame:
    """Digest of every conversation, parsed from ``format_conversations``'s
    output (whose partitioning and order it relies on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, now = Marks(template), None
        for batch in batches:
            done = []
            for conv_id, in_order, segments in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "in_order", "segments"))):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(marks, segments, in_order)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=_DIGEST)
        if now is not None:
            yield pa.RecordBatch.from_pylist([now.row()], schema=_DIGEST)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                     "loss_sha256 string, formatted_chars long, in_order boolean")
