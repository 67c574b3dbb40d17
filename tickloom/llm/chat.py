"""Chat text from turns: a finite-state machine over roles and a declarative template.

The template says for each role what opens and closes a turn, whether its text
counts for the loss, and which roles it may follow.  Turns of a conversation
run through the machine in order and leave as segments (opening, text, closing)
with a loss flag each.  A conversation is never held as a whole: rows arrive
sorted and only the machine's state is kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "~"


@dataclass(frozen=True)
class Turn:
    opening: str
    closing: str
    loss: bool = False
    after: tuple[str, ...] = ()     # roles (or "start") this one may follow


@dataclass(frozen=True)
class Template:
    turns: dict[str, Turn]
    other: Turn                     # roles the template does not know; "{role}" stands for the escaped name
    begin: str
    controls: tuple[str, ...]       # strings that texts may not hold unescaped
    final: tuple[str, ...] = ("assistant",)
    escape: str = field(default=ESCAPE)

    def escaped(self, text: str) -> str:
        """Doubles the escape character, then puts one behind the first character of every control string."""
        text = text.replace(self.escape, self.escape * 2)
        for control in self.controls:
            text = text.replace(control, control[0] + self.escape + control[1:])
        return text

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text)

    def turn(self, role: str) -> tuple[str, str, bool]:
        if known := self.turns.get(role):
            return known.opening, known.closing, known.loss
        return self.other.opening.replace("{role}", self.escaped(role)), self.other.closing, self.other.loss


INSTRUCT = Template(
    turns={
        "system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n", after=("start",)),
        "user": Turn("[INST] ", " [/INST]", after=("start", "system", "assistant")),
        "assistant": Turn(" ", " </s>", loss=True, after=("user",)),
    },
    other=Turn("[ROLE]{role}[/ROLE] ", " </s>"),
    begin="<s>",
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]"),
)

SEGMENTS = "conv_id long, segment long, turn long, role string, part string, text string, loss boolean, in_order boolean"


def segments(turns: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """One row per segment: conv_id, segment, turn (both counted from 0), role, part, text, loss, in_order.

    ``turns`` has conv_id, turn, role, text.  Rows are taken by turn (equal
    turns by role, then text; a null turn first).  Null roles and texts are
    empty strings; null conv_ids are one conversation.  ``in_order`` is false
    from the first turn on that the machine refuses; such conversations are
    formatted all the same.  Roles the template does not know never fit.
    """
    ordered = (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, fits, nth, place = object(), "start", True, 0, 0
        for batch in batches:
            out: list[tuple] = []
            for conv_id, role, text in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True):
                if conv_id != conv:
                    conv, state, fits, nth, place = conv_id, "start", True, 0, 0
                known = template.turns.get(role)
                fits = fits and known is not None and state in known.after
                opening, closing, loss = template.turn(role)
                lead = template.begin if nth == 0 else ""
                for part, words, counts in (("open", lead + opening, False), ("text", template.escaped(text), loss), ("close", closing, False)):
                    out.append((conv_id, place, nth, role, part, words, counts, fits))
                    place += 1
                state, nth = role, nth + 1
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in SEGMENTS.split(", ")])

    return ordered.mapInArrow(emit, SEGMENTS)


def digests(formatted: DataFrame, template: Template = INSTRUCT) -> DataFrame:
    """Per conversation, from its segments: turns, loss text and formatted length; ``valid`` if the machine took it."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "segment")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held = None, None
        for batch in batches:
            done: list[list] = []
            for conv_id, role, part, text, loss, fits in zip(*[batch.column(c).to_pylist() for c in ("conv_id", "role", "part", "text", "loss", "in_order")], strict=True):
                if held is None or conv_id != conv:
                    if held is not None:
                        done.append(_closed(conv, held, template))
                    conv, held = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True, ""]
                held[4] += len(text)
                if part == "text":
                    plain = template.unescaped(text)
                    held[0] += 1
                    held[1].update(f"{role}\n{plain}\n".encode())
                    held[5], held[6] = held[5] and fits, role
                if loss:
                    plain = template.unescaped(text)
                    held[2] += len(plain)
                    held[3].update(plain.encode())
            if done:
                yield _batch(done)
        if held is not None:
            yield _batch([_closed(conv, held, template)])

    return ordered.mapInArrow(digest, DIGESTS)


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _closed(conv, held: list, template: Template) -> list:
    n, turns, loss_chars, loss, chars, fits, last = held
    return [conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, fits and last in template.final]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in DIGESTS.split(", ")])
