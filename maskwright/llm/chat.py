"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A turn becomes three segments: its opening mark, its text with control strings escaped, its closing mark. Only a text
segment of a role with loss is under the loss mask. Escaping puts the escape character before itself and before the
first character of each control string, so reading back is one left-to-right pass and exact for any text.

Rows go by (conversation, turn, role, text): ties are ordered, repeated rows are turns of their own. Null texts and roles
are empty, null conversations are one conversation, null turns come first. A role the template doesn't know gets the
template's mark for other roles and makes the turn invalid. Conversations are streamed row by row through one sorted
shuffle: none is ever held as a whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import prepare


@dataclass(frozen=True)
class Role:
    mark: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """marks: start + role's mark + between, text, end. next_roles: the machine; a state is the last turn's role, "" the start."""

    start: str = "### "
    between: str = ": "
    end: str = " </turn>\n"
    escape: str = "\\"
    control: tuple[str, ...] = ("###", "</turn>")
    other: str = "Role "
    roles: dict[str, Role] = field(default_factory=lambda: {"system": Role("System"), "user": Role("User"), "assistant": Role("Assistant", loss=True)})
    next_roles: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def opening(self, role: str) -> str:
        known = self.roles.get(role)
        return self.start + (known.mark if known else self.other + self.escaped(role, self.between)) + self.between

    def escaped(self, text: str, *also: str) -> str:
        starts = "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in (*self.control, *also))
        return re.sub(f"{re.escape(self.escape)}|{starts}", lambda m: self.escape + m.group(), text)

    def unescaped(self, text: str) -> str:
        return re.sub(f"{re.escape(self.escape)}(.)", lambda m: m.group(1), text, flags=re.DOTALL)

    def reader(self) -> re.Pattern:
        """One turn as formatted: groups mark and text, both still escaped."""
        body = lambda stop: f"((?:[^{re.escape(self.escape)}]|{re.escape(self.escape)}.)*?){re.escape(stop)}"
        return re.compile(re.escape(self.start) + body(self.between) + body(self.end), re.DOTALL)

    def allows(self, state: str, role: str) -> bool:
        return role in self.next_roles.get(state, ())


SEGMENTS = [("segment", T.LongType()), ("role", T.StringType()), ("text", T.StringType()), ("loss", T.BooleanType()), ("valid", T.BooleanType())]


def format_conversations(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """rows(conv_id, turn, role, text) -> (conv_id, segment, role, text, loss, valid), in order within each partition.

    valid: whether the machine allows this turn's role after the turn before.
    """
    template = template or Template()
    prepare(rows.sparkSession)
    kind = rows.schema["conv_id"].dataType
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t in SEGMENTS)])
    dealt = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = dealt.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n = object(), "", 0
        for batch in batches:
            out: list[list] = [[] for _ in schema.names]
            for c, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if c != conv:
                    conv, state, n = c, "", 0
                loss = role in template.roles and template.roles[role].loss
                ok = template.allows(state, role)
                for part, flag in ((template.opening(role), False), (template.escaped(text), loss), (template.end, False)):
                    for column, v in zip(out, (c, n, role, part, flag, ok), strict=True):
                        column.append(v)
                    n += 1
                state = role
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field("conv_id").type), *(pa.array(x, t) for x, t in zip(out[1:], (pa.int64(), pa.string(), pa.string(), pa.bool_(), pa.bool_()), strict=True))], names=schema.names)

    return dealt.mapInArrow(run, schema)


def read_back(segments: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, valid) from the output of format_conversations.

    Only segments' texts and loss flags are read: turns are parsed from the text, as a consumer of the output would.
    Segments may come in any order, as from a table; in_order spares the sort right after format_conversations, whose
    rows are in order.
    """
    template = template or Template()
    if not in_order:
        prepare(segments.sparkSession)
        segments = segments.repartition("conv_id").sortWithinPartitions("conv_id", "segment")
    kind = segments.schema["conv_id"].dataType
    kinds = [("n_turns", T.LongType(), pa.int64()), ("turns_sha256", T.StringType(), pa.string()), ("loss_chars", T.LongType(), pa.int64()), ("loss_sha256", T.StringType(), pa.string()), ("formatted_chars", T.LongType(), pa.int64()), ("valid", T.BooleanType(), pa.bool_())]
    schema = T.StructType([T.StructField("conv_id", kind), *(T.StructField(n, t) for n, t, _ in kinds)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, names = template.reader(), {r.mark: n for n, r in template.roles.items()}
        none = object()
        conv, id_type = none, pa.null()
        rest, n, turns, loss, loss_chars, chars, valid = "", 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True
        done: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * len(schema.names)
            made = pa.RecordBatch.from_arrays([pa.array(columns[0], id_type), *(pa.array(c, k[2]) for c, k in zip(columns[1:], kinds, strict=True))], names=schema.names)
            done.clear()
            return made

        for batch in batches:
            id_type = batch.schema.field("conv_id").type
            for c, text, flag, ok in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "text", "loss", "valid")), strict=True):
                if conv is none or c != conv:
                    if conv is not none:
                        done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
                    conv, rest, n, turns, loss, loss_chars, chars, valid = c, "", 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True
                rest, chars, valid = rest + text, chars + len(text), valid and ok
                if flag:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                if text == template.end and (m := turn.fullmatch(rest)):
                    mark = m.group(1)
                    role = names[mark] if mark in names else template.unescaped(mark.removeprefix(template.other))
                    turns.update(f"{role}\n{template.unescaped(m.group(2))}\n".encode())
                    rest, n = "", n + 1
            if done:
                yield batch_of()
        if conv is not none:
            done.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))
            yield batch_of()

    return segments.mapInArrow(run, schema)
