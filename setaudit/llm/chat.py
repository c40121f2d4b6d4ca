"""Chat formatting with a grammar that survives the round trip."""

from __future__ import annotations

import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc

BEGIN, END = "<|turn|>", "<|end|>\n"
_PLAIN = re.compile(r"[A-Za-z0-9_-]+\Z")
_MARK = re.compile(r"<(\\*)\|")
_MARKED = re.compile(r"<\\(\\*)\|")

Turn = tuple[str | None, str | None]


def escape(content: str) -> str:
    """One backslash more in each <| or <\\...|, so that no marker is left; ``unescape`` takes it away."""
    return _MARK.sub(r"<\\\1|", content)


def unescape(content: str) -> str:
    return _MARKED.sub(r"<\1|", content)


def _role(role: str | None) -> str:
    if role is None:
        return "~"
    return role if _PLAIN.match(role) else "=" + quote(role, safe="")


def render(turns: list[Turn], escaped: set[int]) -> str:
    """Each turn is <|turn|>role, !e if escaped or !n if null, a line feed, the content, and <|end|> with a line feed."""
    out = []
    for k, (role, content) in enumerate(turns):
        flag = "!n" if content is None else "!e" if k in escaped else ""
        body = "" if content is None else escape(content) if k in escaped else content
        out.append(f"{BEGIN}{_role(role)}{flag}\n{body}{END}")
    return "".join(out)


def parse(text: str) -> list[Turn]:
    """The turns of a rendered text, as far as it follows the grammar: what can't be read ends the list."""
    turns: list[Turn] = []
    at = 0
    while text.startswith(BEGIN, at):
        line = text.find("\n", at)
        end = text.find(END, line + 1)
        if line < 0 or end < 0:
            break
        head, content = text[at + len(BEGIN) : line], text[line + 1 : end]
        role, _, flag = head.partition("!")
        role = None if role == "~" else unquote(role[1:]) if role.startswith("=") else role
        turns.append((role, None if flag == "n" else unescape(content) if flag == "e" else content))
        at = end + len(END)
    return turns


def formatted(turns: list[Turn]) -> tuple[str, int]:
    """(text, escaped turns): rendered, parsed and compared until it reads back as the same turns; the first turn
    that doesn't is escaped before the next try."""
    escaped: set[int] = set()
    while True:
        text = render(turns, escaped)
        back = parse(text)
        if back == turns:
            return text, len(escaped)
        wrong = next((k for k, t in enumerate(turns) if k >= len(back) or back[k] != t), len(turns) - 1)
        if wrong in escaped:
            raise ValueError(f"turn {wrong} can't be formatted")
        escaped.add(wrong)


def _format(batches):
    for batch in batches:
        rows = [formatted([(t["role"], t["text"]) for t in turns]) for turns in batch.column("turns").to_pylist()]
        n = batch.column("turns").value_lengths().cast(pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), n, pa.array([r[1] for r in rows], pa.int64()), pa.array([r[0] for r in rows], pa.string())], names=["conv_id", "turns", "escaped", "rendered"])


def chat_format(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns, escaped, rendered) of every conversation, its turns in the order of turn, role, text.

    Rendered text always parses back to the same roles and contents: a turn whose content holds the end marker is
    escaped, a role that isn't a plain word is percent-encoded, and null roles and texts have marks of their own, so
    they stay apart from empty ones. A null turn number comes first. Rows without conv_id belong to no conversation and are one of
    a single turn each, so they never meet in one task; a conversation, however long, is one row of the result and so one value.
    Repeated rows are repeated turns, turns of equal number come in the order of role and text; an empty table gives no rows, long texts are kept whole, and other columns
    aren't read.
    """
    tc.ship(conversations.sparkSession)
    rows = conversations.select(tc.long_id("conv_id").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    turn = F.struct("turn", "role", "text")
    grouped = rows.where("conv_id is not null").groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    grouped = grouped.unionByName(rows.where("conv_id is null").select("conv_id", F.array(turn).alias("turns")))
    return grouped.mapInArrow(_format, "conv_id long, turns long, escaped long, rendered string")
