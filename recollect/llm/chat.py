"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) to a string. Successive prefixes of a conversation are
rendered and each output compared with the one before: what was appended is the new turn's span. Inside it,
a stand-in text of a character found nowhere else shows where the template puts the text. A template whose output
for more turns does not begin with its output for fewer rewrites history; its spans are then located in the full
rendering. Every prefix is rendered, whatever the number of turns.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import prepare

Turns = list[tuple[str, str]]
Template = Callable[[Turns], str]
Span = tuple[int, int, int, int]  # of the turn and of its text, in code points

#: Control strings of the marked template: what opens and closes the turns of each role.
MARKS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("<<ROLE>>", "<</ROLE>>", "<</TURN>>")
_CONTROL = [m for pair in MARKS.values() for m in pair] + list(OTHER)
_ESCAPED = re.compile("\\\\|" + "|".join(map(re.escape, _CONTROL)))
_BACK = re.compile(r"\\(\\|)")
_OPENS = re.compile("|".join(re.escape(m) for m in [*(a for a, _ in MARKS.values()), OTHER[0]]))


def escape(text: str) -> str:
    """Double each backslash and put one inside each control string, behind its first character."""
    return _ESCAPED.sub(lambda m: "\\\\" if m[0] == "\\" else m[0][0] + "\\" + m[0][1:], text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def marked(turns: Turns) -> str:
    """The production template: each turn between its role's control strings, which no escaped text contains."""
    out = []
    for role, text in turns:
        if role in MARKS:
            out.append(MARKS[role][0] + escape(text) + MARKS[role][1])
        else:
            out.append(OTHER[0] + escape(role) + OTHER[1] + escape(text) + OTHER[2])
    return "".join(out)


def read_back(formatted: str) -> Turns:
    """The turns of a marked() rendering."""
    closes, turns, at = dict(MARKS.values()), [], 0
    roles = {a: r for r, (a, _) in MARKS.items()}
    while at < len(formatted):
        m = _OPENS.match(formatted, at)
        if not m:
            raise ValueError(f"no turn opens at {at}")
        role, begin = roles.get(m[0]), m.end()
        if role is None:
            end = formatted.index(OTHER[1], begin)
            role, begin, close = unescape(formatted[begin:end]), end + len(OTHER[1]), OTHER[2]
        else:
            close = closes[m[0]]
        end = formatted.index(close, begin)
        turns.append((role, unescape(formatted[begin:end])))
        at = end + len(close)
    return turns


def _common(a: str, b: str) -> int:
    """Length of the longest common prefix."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[:mid] == b[:mid] else (lo, mid - 1)
    return lo


def _other(text: str) -> str:
    """A character that text does not have."""
    return next(c for c in map(chr, range(0xE000, 0x110000)) if c not in text)


def _text_place(shown: str, changed: str) -> tuple[int, int]:
    """Characters before and after what differs between two renderings that share no character inside it."""
    head = _common(shown, changed)
    return head, min(_common(shown[::-1], changed[::-1]), len(shown) - head)


def locate(render: Template, turns: Turns) -> tuple[str, list[Span], bool]:
    """The rendering of all turns, each turn's span and whether the template rewrites history.

    Every prefix is rendered twice: as it is, and with a stand-in for its last text.
    """
    full, spans, old = render(turns), [], render([])
    for k, (role, _) in enumerate(turns):
        new = full if k + 1 == len(turns) else render(turns[: k + 1])
        changed = render([*turns[:k], (role, _other(new))])
        if not new.startswith(old) or not changed.startswith(old):
            return full, _located_in_full(render, full, turns), True
        at = len(old)
        head, tail = _text_place(new[at:], changed[at:])
        spans.append((at, len(new), at + head, len(new) - tail))
        old = new
    return full, spans, False


def _located_in_full(render: Template, full: str, turns: Turns) -> list[Span]:
    spans, other = [], _other(full)
    for k, (role, _) in enumerate(turns):
        head, tail = _text_place(full, render([*turns[:k], (role, other), *turns[k + 1 :]]))
        spans.append((head, len(full) - tail, head, len(full) - tail))
    return spans


def format_chats(rows: DataFrame, render: Template = marked, learn_from: tuple[str, ...] = ("assistant",), conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_col, formatted, turns, rewrites_history): a row for each conversation.

    turns is array<struct<role, start, end, text_start, text_end, learn>>, offsets in code points of
    `formatted`; learn marks the texts under the loss mask, those of roles in `learn_from`. Turns are ordered
    by turn_col (nulls first), ties by role and text; repeated rows are turns of their own; null roles and
    texts are empty. Rows of null conv_col form one conversation. Other columns are not read. A conversation
    is one record and so is formatted in one task.
    """
    prepare(rows.sparkSession)
    turn = F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    grouped = rows.select(F.col(conv_col).alias("conv"), turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns")).withColumn("conv", F.col("conv").cast("string"))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for conv, turns in zip(x["conv"], x["turns"], strict=True):
                pairs = [(t["role"], t["text"]) for t in turns]
                full, spans, rewrites = locate(render, pairs)
                marks = [{"role": r, "start": a, "end": b, "text_start": c, "text_end": d, "learn": r in learn_from} for (r, _), (a, b, c, d) in zip(pairs, spans, strict=True)]
                out.append((conv, full, marks, rewrites))
            yield pd.DataFrame(out, columns=["conv", "formatted", "turns", "rewrites_history"])

    kind = dict(rows.dtypes)[conv_col]
    turns_type = "array<struct<role: string, start: bigint, end: bigint, text_start: bigint, text_end: bigint, learn: boolean>>"
    out = grouped.mapInPandas(batches, f"conv string, formatted string, turns {turns_type}, rewrites_history boolean")
    return out.select(F.col("conv").cast(kind).alias(conv_col), "formatted", "turns", "rewrites_history")
