"""Scalar expressions; all run inside the JVM."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]+"  # what Python's str.split() takes for white space


def normalised(c: Column | str) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), WS, " "))  # only plain spaces are left at the ends


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")).rlike(r"[^\s\x1c-\x1f\x85\p{Z}]")


def stripped(c: Column | str) -> Column:
    """The text without white space at its ends, as Python's str.strip() has it."""
    return F.regexp_replace(c, rf"^{WS}|{WS}$", "")


def passes(score: Column, threshold: float) -> Column:
    """NaN fails, which Spark alone would call larger than any threshold, and so does null, which it becomes on its way from pandas."""
    return F.when(score.isNull() | F.isnan(score), False).otherwise(score >= F.lit(threshold))


def last_number(text: Column | str, marker: str = r"(?:ANSWER:|####)", strict: bool = False) -> Column:
    """The number after the last marker, thousands separators and a dollar sign allowed. Without one: null, or strict an error.

    A null text is null either way: there was no reply to read.
    """
    text = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(text, F.lit(marker + r"\s*\$?(-?[0-9][0-9,]*(?:\.[0-9]+)?)"), 1)
    got = F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit("")).cast("double")
    if not strict:
        return got
    return F.when(text.isNull() | got.isNotNull(), got).otherwise(F.raise_error(F.concat(F.lit("no number in the reply that ends: "), F.right(text, F.lit(160)))).cast("double"))


_BLOCK = r"(?is)<(think|thinking|reasoning|thought)>.*?</\1>"
_OPEN = r"(?is)<(think|thinking|reasoning|thought)>"


def verdict(text: Column | str) -> Column:
    """True for PASS, false for FAIL after reasoning blocks are taken out; null for anything else, cut-off blocks included."""
    rest = F.upper(F.trim(F.regexp_replace(F.regexp_replace(text, _BLOCK, ""), WS, " ")))
    word = F.regexp_replace(rest, r"^[^A-Z]+|[^A-Z]+$", "")
    return F.when(F.regexp_replace(text, _BLOCK, "").rlike(_OPEN), None).when(word == "PASS", True).when(word == "FAIL", False)


def request_key(**parts: Column) -> Column:
    """SHA-256 over the named parts of a request, in the order of their names; a null differs from an empty text."""
    cells = [F.concat(F.lit(f"{k}="), F.coalesce(F.to_json(F.struct(parts[k].cast("string").alias("v"))), F.lit("{}"))) for k in sorted(parts)]
    return F.sha2(reduce(lambda a, b: F.concat(a, F.lit("\n"), b), cells), 256)


ANSWER_PARTS = ("model", "system", "input", "temperature", "seed", "repeat")
JUDGE_PARTS = ("judge_model", "case", "system", "prompt", "temperature", "seed", "repeat")


def _identity(kind: str, backend: str, known: tuple[str, ...], parts: dict[str, Column]) -> Column:
    if set(parts) != set(known):
        raise ValueError(f"the identity of a request of kind '{kind}' takes {', '.join(known)}; got {', '.join(sorted(parts)) or 'nothing'}")
    return request_key(kind=F.lit(kind), backend=F.lit(backend), **parts)


def answer_key(backend: str, **parts: Column) -> Column:
    """Key of a generated answer. Every part that can change it must be given: ANSWER_PARTS."""
    return _identity("answer", backend, ANSWER_PARTS, parts)


def judge_key(backend: str, **parts: Column) -> Column:
    """Key of a verdict on an answer. Every part that can change it must be given: JUDGE_PARTS."""
    return _identity("judge", backend, JUDGE_PARTS, parts)


def prompt(template: str, **values: Column) -> Column:
    """The template with each {name} replaced by its column, null by nothing; what a column holds isn't looked at for names."""
    parts = re.split(r"\{(\w+)\}", template)
    cells = [F.coalesce(values[p].cast("string"), F.lit("")) if k % 2 and p in values else F.lit("{" + p + "}" if k % 2 else p) for k, p in enumerate(parts)]
    return F.concat(*cells)
