r"""Chat formatting of typed content parts.

A turn's content is a list of parts (type, text, ref, size); a visitor with one method
for each type flattens it: texts are escaped, image, audio and document parts
become placeholders ``<|type:k|>`` numbered through the conversation, with the attachment's
reference and the tokens its placeholder expands to. A turn is written as

    ### role: content </turn>\n

Inside contents and roles a backslash is doubled and a control string gets a backslash before
it, so that the output can be read back exactly, whatever the texts say. Neighbouring text parts are
escaped as one. Reading looks for the mark that may come next and no other: the opening between turns,
the ``: `` in a role, the closing in a content; so a content may end like the start of a control
string (``:``, ``###``). The loss spans are the places of assistant contents in the output.

Turns are dealt by conversation and sorted within the task, which reads them one by
one; it holds one conversation at a time, the unit of the output.

Nulls and odd input: null texts are empty, null roles are written as the empty role, unknown part
types as text, null refs stay null. Turns with equal numbers are ordered by role, then
content; repeated rows are repeated turns. Rows without conv_id form one conversation. An empty
table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslake.llm.common import partitions

PARTS = "array<struct<type:string,text:string,ref:string,size:array<int>>>"
FORMATTED = "conv_id long, formatted string, n_turns long, loss_spans array<struct<start:int,stop:int>>, attachments array<struct<number:int,type:string,ref:string,tokens:long>>, attachment_tokens long"

# The template's control strings.
_OPEN, _MIDDLE, _CLOSE, _HOLD = "### ", ": ", " </turn>\n", "<|"
_CONTROL = re.compile(r"\\|### |: |</turn>|<\|")
_ESCAPED = re.compile(r"\\(\\|### |: |</turn>|<\|)")
_ROLE_END = re.compile(r"\\(?:\\|### |: |</turn>|<\|)|(: )")
_CONTENT_END = re.compile(r"\\(?:\\|### |: |</turn>|<\|)|( </turn>\n)")


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


def text_parts(text: Column) -> Column:
    """The content of a plain text column: one text part."""
    one = F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("array<int>").alias("size"))
    return F.array(one)


class Flattener:
    """Visits the parts of one conversation in order."""

    def __init__(self, patch: int = 14, audio_rate: int = 25, page: int = 256):
        self.patch, self.audio_rate, self.page = patch, audio_rate, page
        self.attachments: list[tuple[int, str, str | None, int]] = []

    def content(self, parts) -> str:
        """All parts; texts in a row are escaped together, as a control string may lie across two of them."""
        groups = groupby(parts, lambda part: self._visitor(part) == self.visit_text)
        return "".join(escape("".join(p["text"] or "" for p in own)) if texts else "".join(map(self.visit, own)) for texts, own in groups)

    def visit(self, part) -> str:
        return self._visitor(part)(part)

    def _visitor(self, part):
        return getattr(self, f"visit_{(part['type'] or 'text').lower()}", self.visit_text)

    def visit_text(self, part) -> str:
        return escape(part["text"] or "")

    def visit_image(self, part) -> str:
        """One token for each patch of the image (width, height in pixels)."""
        width, height = [*_ints(part["size"]), 0, 0][:2]
        return self._hold("image", part, max(1, -(-width // self.patch) * -(-height // self.patch)))

    def visit_audio(self, part) -> str:
        """``audio_rate`` tokens for each second (length in milliseconds)."""
        length = [*_ints(part["size"]), 0][0]
        return self._hold("audio", part, max(1, -(-length * self.audio_rate // 1000)))

    def visit_document(self, part) -> str:
        """``page`` tokens for each page."""
        return self._hold("document", part, max(1, [*_ints(part["size"]), 0][0]) * self.page)

    def _hold(self, kind: str, part, tokens: int) -> str:
        number = len(self.attachments) + 1
        self.attachments.append((number, kind, part["ref"], tokens))
        return f"{_HOLD}{kind}:{number}|>"


def _ints(values) -> list[int]:
    return [] if values is None else [int(v) for v in values if v is not None]


def format_chats(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation from rows (conv_id, turn, role, parts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = object(), None

        def done():
            text = "".join(state["text"])
            kept = [dict(zip(("number", "type", "ref", "tokens"), a, strict=True)) for a in state["flat"].attachments]
            conv = None if pd.isna(now) else int(now)
            row = [conv, text, state["n"], [{"start": a, "stop": b} for a, b in state["spans"]], kept, sum(a["tokens"] for a in kept)]
            return pd.DataFrame([row], columns=["conv_id", "formatted", "n_turns", "loss_spans", "attachments", "attachment_tokens"])

        out: list[pd.DataFrame] = []
        for batch in batches:
            for conv, role, parts in zip(batch["conv_id"], batch["role"], batch["parts"], strict=True):
                conv = None if pd.isna(conv) else conv
                if state is None or conv != now:
                    if state is not None:
                        out.append(done())
                    now, state = conv, {"text": [], "at": 0, "n": 0, "spans": [], "flat": Flattener()}
                head = f"{_OPEN}{escape(role or '')}{_MIDDLE}"
                body = state["flat"].content(parts if parts is not None else [])
                state["n"] += 1
                if role == loss_role:
                    state["spans"].append((state["at"] + len(head), state["at"] + len(head) + len(body)))
                state["text"] += [head, body, _CLOSE]
                state["at"] += len(head) + len(body) + len(_CLOSE)
            if len(out) >= 200:
                yield pd.concat(out, ignore_index=True)
                out = []
        if state is not None:
            out.append(done())
        if out:
            yield pd.concat(out, ignore_index=True)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "parts")
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "parts")
    return dealt.drop("turn").mapInPandas(run, FORMATTED)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, escaped content) of each turn of a formatted conversation."""
    def end(mark: re.Pattern, at: int) -> re.Match | None:
        return next((m for m in mark.finditer(formatted, at) if m[1]), None)

    out, at = [], 0
    while formatted.startswith(_OPEN, at):
        middle = end(_ROLE_END, at + len(_OPEN))
        close = middle and end(_CONTENT_END, middle.end())
        if not close:
            break
        out.append((unescape(formatted[at + len(_OPEN) : middle.start()]), formatted[middle.end() : close.start()]))
        at = close.end()
    return out


def read_back(chats: DataFrame) -> DataFrame:
    """``chats`` with turns (role, text) parsed from the output and loss_text under its mask."""

    @F.pandas_udf("turns array<struct<role:string,text:string>>, loss_text string")
    def back(formatted: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for text, own in zip(formatted, spans, strict=True):
            turns = [{"role": r, "text": unescape(c)} for r, c in parse(text)]
            rows.append((turns, "".join(unescape(text[s["start"] : s["stop"]]) for s in own)))
        return pd.DataFrame(rows, columns=["turns", "loss_text"])

    read = chats.withColumn("__back", back("formatted", "loss_spans"))
    return read.withColumns({"turns": F.col("__back.turns"), "loss_text": F.col("__back.loss_text")}).drop("__back")
