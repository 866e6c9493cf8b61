"""Chat formatting by a finite-state machine over roles and a declarative template.

A conversation's rows, by turn, become text segments, each with a flag that
says whether a model learns from it. The template names the mark before and
after each role's text and the roles whose text counts. Control strings inside
texts are escaped, so the marks are the only ones left and the output can be
read back exactly.

A task sees a conversation's rows in order and keeps only its state, so a
conversation of any length needs no more memory.

Cases: a null text or role is the empty one. Rows of a conversation that share
a turn are ordered by role and text, nulls first; repeated rows are turns of
their own. Rows with a null conv_id form one conversation. Roles that the
template lacks get general marks that carry the role. An empty table gives no
segments. Turn orders that the machine rejects are still formatted, and marked
as not valid. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


@dataclass(frozen=True)
class Template:
    """Marks around each role's text, roles under the loss, and the turn orders that are valid."""

    marks: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")})
    other: tuple[str, str, str] = ("[ROLE]", "[TEXT]", "[/ROLE]")
    learned: frozenset = frozenset({"assistant"})
    follows: dict[str, frozenset] = field(default_factory=lambda: {"": frozenset({"system", "user"}), "system": frozenset({"user"}), "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})
    accepting: frozenset = frozenset({"assistant"})

    @property
    def controls(self) -> list[str]:
        return sorted({*self.other, *(m for pair in self.marks.values() for m in pair)}, key=lambda m: (-len(m), m))


def escape(text: str, pattern: re.Pattern) -> str:
    """Doubles backslashes and puts one after the first character of each control string."""
    return pattern.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _pattern(template: Template) -> re.Pattern:
    return re.compile("|".join(map(re.escape, template.controls)))


def segments_of(role: str, text: str, template: Template, pattern: re.Pattern) -> list[tuple[str, bool]]:
    if role in template.marks:
        before, after = template.marks[role]
        return [(before, False), (escape(text, pattern), role in template.learned), (after, False)]
    opened, between, closed = template.other
    return [(opened, False), (escape(role, pattern), False), (between, False), (escape(text, pattern), role in template.learned), (closed, False)]


SEGMENTS = "conv_id long, segment long, text string, loss boolean, valid boolean"


def _formatter(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, nothing = _pattern(template), object()
        conv, state, ok, k = nothing, "", True, 0
        names = ["conv_id", "segment", "text", "loss", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.bool_()]
        rows: list[tuple] = []

        def close():
            if conv is not nothing:
                rows.append((conv, k, "", False, ok and state in template.accepting))

        for batch in common.slices(batches):
            for conv_id, role, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True):
                if conv_id != conv:
                    close()
                    conv, state, ok, k = conv_id, "", True, 0
                ok = ok and role in template.follows.get(state, ())
                state = role
                for part, loss in segments_of(role, text, template, pattern):
                    rows.append((conv, k, part, loss, None))
                    k += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []
        close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return run


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """Segments of each conversation in order; its last one is empty and says whether the turn order is valid."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_formatter(template or Template()), SEGMENTS)


def _reader(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begins = {m[0]: r for r, m in template.marks.items()}
        ends = {m[1] for m in template.marks.values()} | {template.other[2]}
        opened, between, _ = template.other
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        rows: list[tuple] = []
        turns = all_turns = loss = role = text = inside = None

        def restart():
            nonlocal turns, loss, all_turns, role, text, inside
            turns, loss, all_turns = hashlib.sha256(), hashlib.sha256(), [0, 0, 0]
            role, text, inside = "", "", ""

        restart()
        for batch in common.slices(batches):
            for conv_id, part, learned, valid in zip(*(batch[c].to_pylist() for c in ("conv_id", "text", "loss", "valid")), strict=True):
                all_turns[2] += len(part)
                if valid is not None:
                    rows.append((conv_id, all_turns[0], turns.hexdigest(), all_turns[1], loss.hexdigest(), all_turns[2], valid))
                    restart()
                elif part in begins:
                    role, text, inside = begins[part], "", "text"
                elif part == opened:
                    role, text, inside = "", "", "role"
                elif part == between:
                    inside = "text"
                elif part in ends:
                    turns.update(f"{role}\n{text}\n".encode())
                    all_turns[0] += 1
                    inside = ""
                elif inside == "role":
                    role = unescape(part)
                else:
                    text = unescape(part)
                    if learned:
                        loss.update(text.encode())
                        all_turns[1] += len(text)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                rows = []

    return run


def read_back(segments: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation, what its segments say: turns, text under the loss, and size. Segments may come in any order, as from files."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
    rows = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    return rows.mapInArrow(_reader(template or Template()), schema)


def parse(formatted: str, template: Template | None = None) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation, from its text alone."""
    template = template or Template()
    begins = {m[0]: r for r, m in template.marks.items()}
    out, at, role, opened = [], 0, "", ""
    for m in _pattern(template).finditer(formatted):
        mark = m[0]
        if mark in begins:
            role, opened = begins[mark], mark
        elif mark == template.other[1]:
            role = unescape(formatted[at : m.start()])
        elif mark != template.other[0]:
            out.append((role, unescape(formatted[at : m.start()])))
        at = m.end()
    return out
