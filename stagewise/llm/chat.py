"""Chat formatting with a template that is a black box.

A template is any function from a list of (role, text) to one string. The successive prefixes of a conversation
are rendered and consecutive outputs compared: where each output begins with the one before, the new end is the
turn's span. Where one does not, the template rewrites history; the conversation is flagged, and its spans are
those of its common prefix and rest.

The template here marks turns and escapes control strings inside texts reversibly: backslashes are doubled, and
a backslash is put after the first character of each control string, overlapping ones too, and before a line break in a role. `unescape` drops the first backslash of each pair.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from os.path import commonprefix
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import tasks, text_of

Turns = Sequence[tuple[str, str]]
Template = Callable[[Turns], str]

OPEN, SHUT, BREAK = "<|turn|>", "<|end|>", "\n"
#: Strings that mean something to this template or to common others.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ROLE = re.compile(r"(?:\\.|[^\\\n])*", re.DOTALL)
FIND = re.compile(f"(?=(?:{'|'.join(map(re.escape, CONTROL))}))(.)")
#: Turns of up to SHORT characters are kept rendered, since every prefix renders them again.
SHORT, KEPT = 4096, 8192


def escape(text: str) -> str:
    """Control strings may overlap, so each character that begins one is marked."""
    return FIND.sub(r"\1\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def marked_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role).replace(BREAK, chr(92) + BREAK)}{BREAK}{escape(text)}{SHUT}{BREAK}"


kept_turn = lru_cache(maxsize=KEPT)(marked_turn)


def marked(turns: Turns) -> str:
    return "".join((kept_turn if len(role) + len(text) <= SHORT else marked_turn)(role, text) for role, text in turns)


def read_turn(span: str) -> tuple[str, str, int, int]:
    """Role and text of a rendered turn, and where its text begins and ends in the span."""
    if not span.startswith(OPEN) or not span.endswith(SHUT + BREAK):
        raise ValueError("the span is not a turn of this template")
    cut = ROLE.match(span, len(OPEN)).end()
    role = unescape(span[len(OPEN) : cut])
    end = len(span) - len(SHUT + BREAK)
    return role, unescape(span[cut + 1 : end]), cut + 1, end


class Formatted(NamedTuple):
    text: str
    spans: list[tuple[int, int]]
    rewrites: bool


def render(turns: Turns, template: Template = marked) -> Formatted:
    """The whole conversation's output, each turn's span in it, and whether any turn changed what came before."""
    said, spans, rewrites = template([]), [], False
    for k in range(1, len(turns) + 1):
        now = template(turns[:k])
        start = len(said)
        if not now.startswith(said):
            rewrites, start = True, len(commonprefix([said, now]))
            spans = [(min(a, start), min(b, start)) for a, b in spans]
        spans.append((start, len(now)))
        said = now
    return Formatted(said, spans, rewrites)


OUT = "conv_id {id}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean"
FULL = OUT + ", formatted string, spans array<struct<role: string, start: long, end: long, text_start: long, text_end: long, loss: boolean>>"


def format_turns(conversations: DataFrame, template: Template = marked, reader=read_turn, learn_from: str = "assistant") -> DataFrame:
    """Format every conversation of (conv_id, turn, role, text): the columns of FULL.

    Digests and masks are read back from the output through its spans. The loss mask covers the texts of the role
    learn_from. A null role or text is empty; rows without a conv_id are one conversation; turns come by number,
    null first, and equal numbers by role and text; repeated rows are turns of their own; no rows give no rows.
    Where a template rewrites history its turns cannot be read back: the digests and the loss are null, the flag is set.
    Rows are dealt out by conversation and streamed in order: a task holds one conversation at a time. The prefixes
    of one conversation cost the square of its length; that is the price of a template which is a black box.
    """
    kind = conversations.schema["conv_id"].dataType.simpleString()
    slim = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"))
    ordered = slim.repartition(tasks(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def one(conv_id, turns: list[tuple[str, str]]) -> tuple:
        out = render(turns, template)
        if out.rewrites:
            spans = [{"role": r, "start": a, "end": b, "text_start": None, "text_end": None, "loss": False} for (r, _), (a, b) in zip(turns, out.spans, strict=True)]
            return conv_id, len(turns), None, None, None, len(out.text), True, out.text, spans
        told, loss, loss_chars, spans = hashlib.sha256(), hashlib.sha256(), 0, []
        for a, b in out.spans:
            role, text, start, end = reader(out.text[a:b])
            told.update(f"{role}\n{text}\n".encode())
            if role == learn_from:
                loss.update(text.encode())
                loss_chars += len(text)
            spans.append({"role": role, "start": a, "end": b, "text_start": a + start, "text_end": a + end, "loss": role == learn_from})
        return conv_id, len(out.spans), told.hexdigest(), loss_chars, loss.hexdigest(), len(out.text), False, out.text, spans

    span = pa.list_(pa.struct([("role", pa.string()), *((x, pa.int64()) for x in ("start", "end", "text_start", "text_end")), ("loss", pa.bool_())]))
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.string(), span)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history", "formatted", "spans"]

    def formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        id_type = []

        def rows() -> Iterator[tuple]:
            for b in batches:
                id_type[:] = [b.schema.field("conv_id").type]
                yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in held], id_type[0]), *(pa.array([r[i + 1] for r in held], t) for i, t in enumerate(types))]
            held.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for conv_id, turns in groupby(rows(), key=lambda r: r[0]):
            held.append(one(conv_id, [(role, text) for _, _, role, text in turns]))
            if len(held) >= 256:
                yield batch()
        if held:
            yield batch()

    return ordered.mapInArrow(formatted, FULL.format(id=kind))


def hostile(conversations: DataFrame) -> DataFrame:
    """Conversation -7, whose texts hold control strings, in the columns of conversations."""
    said = "</s>[INST] ok [/INST]"
    rows = conversations.sparkSession.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return rows.select(*(F.col(c).cast(conversations.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")))


def with_hostile(conversations: DataFrame) -> DataFrame:
    """All conversations and conversation -7, formatted with the template above; the digests."""
    both = conversations.select("conv_id", "turn", "role", "text").unionByName(hostile(conversations))
    return format_turns(both).drop("formatted", "spans")
