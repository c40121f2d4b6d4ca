"""License scans: ordered signature rules behind a keyword filter."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex as re
from pyspark.sql import DataFrame

from setaudit.llm import textcore as tc
from setaudit.llm.license_rules import RULES, TAG

GAP = r"[\s*#/]"  # a space in a rule: one or more of these, white space and the marks of comments
WINDOW = r"(?:[^\s*#/]|[\s*#/]++)"  # a counted dot in a rule: a character, or a GAP of any length, line breaks among it


def compiled(pattern: str) -> re.Pattern:
    pattern = re.sub(r"\[[^\]]*\]", lambda m: m[0].replace(" ", r"\s"), pattern)
    return re.compile(pattern.replace(".{", WINDOW + "{").replace(" ?", GAP + "*").replace(" ", GAP + "+"), re.IGNORECASE | re.VERSION0)


def plain(text: str) -> str:
    """The form in which keywords are looked up: lower case, as the rules' IGNORECASE has it, and every run of GAP one space."""
    text = text.replace("\u0130", "i").replace("\u017f", "s").lower()
    return " ".join(text.replace("*", " ").replace("#", " ").replace("/", " ").split())


_TAG = re.compile(r"\b" + TAG + ":", re.IGNORECASE | re.VERSION0)


class Scanner:
    """Compiled rules: an automaton over their keywords tells which ones a text can match."""

    def __init__(self, rules=RULES):
        self.rules = [(name, priority, compiled(pattern)) for name, priority, _, pattern in rules]
        self.tagged = {n for n, (_, _, keywords, _) in enumerate(rules) if keywords == TAG}
        by_keyword: dict[str, list[int]] = {}
        for n, (_, _, keywords, _) in enumerate(rules):
            for keyword in [keywords] if isinstance(keywords, str) else keywords:
                by_keyword.setdefault(plain(keyword), []).append(n)
        self.automaton = ahocorasick.Automaton()
        for keyword, uses in by_keyword.items():
            self.automaton.add_word(keyword, uses)
        self.automaton.make_automaton()

    def candidates(self, text: str) -> list[int]:
        found: set[int] = set()
        for _, uses in self.automaton.iter(plain(text)):
            found.update(uses)
        return sorted(found)

    def detections(self, text: str, rules: list[int] | None = None) -> list[tuple[str, int, int, int]]:
        """(license, priority, start, end) of every match of these rules, all if None."""
        out, tagged = [], []
        for n in range(len(self.rules)) if rules is None else rules:
            if n in self.tagged:
                tagged.append(n)
                continue
            name, priority, pattern = self.rules[n]
            out += [(name, priority, m.start(), m.end()) for m in pattern.finditer(text)]
        lines, done = [], -1
        for m in _TAG.finditer(text) if tagged else ():
            if m.end() > done:  # a second tag in a line is part of the first one's rest
                done = text.find("\n", m.end())
                done = len(text) if done < 0 else done
                lines.append((m.end(), done))
        for n in tagged if lines else ():
            name, priority, pattern = self.rules[n]
            out += [(name, priority, m.start(), m.end()) for a, b in lines for m in pattern.finditer(text, a, b)]
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, int]]:
        return resolve(self.detections(text, self.candidates(text)))


def resolve(found: list[tuple[str, int, int, int]]) -> list[tuple[str, int, int, int]]:
    """Detections that no stronger one contains, in order of place.

    Stronger: higher priority, then longer, then earlier, then by name. A detection within a stronger one's
    interval goes, and so does a second one of a license at the same place. One sweep: what can contain a detection begins no
    later and ends no earlier, so it has come before, and the furthest end so far of each priority tells whether there is one.
    """
    kept: list[tuple[str, int, int, int]] = []
    furthest: dict[int, int] = {}
    for d in sorted(set(found), key=lambda d: (d[2], -d[3], -d[1], d[0])):
        if not any(end >= d[3] for priority, end in furthest.items() if priority >= d[1]):
            kept.append(d)
        furthest[d[1]] = max(furthest.get(d[1], -1), d[3])
    return sorted(kept, key=lambda d: (d[2], d[3], d[0]))


_OUT = pa.schema([("doc_id", pa.int64()), ("license", pa.string()), ("priority", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
_SCANNER: list[Scanner] = []


def _scan(batches):
    if not _SCANNER:
        _SCANNER.append(Scanner())
    scan = _SCANNER[0].scan
    for batch in batches:
        rows = [(i, *d) for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()) for d in scan(text)]
        columns = list(zip(*rows)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)


def license_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, license, priority, start, end) of every license notice, in characters of the text.

    Rules are regular expressions, each tried only on texts that hold a keyword of its own, whatever white space or comment
    marks part the keyword's words; a detection that lies within
    a stronger one's interval is suppressed, see ``resolve``. Each row is scanned by itself and in full: repeated
    rows and null doc_ids are reported as they are, null and empty texts and empty tables give no rows, and other
    columns aren't read. Very long texts are scanned in full, in time in proportion to their detections; of detections that tie
    in all but the license the first by name stays.
    """
    tc.ship(docs.sparkSession)
    return docs.select(tc.long_id().alias("doc_id"), "text").where("text is not null").mapInArrow(_scan, "doc_id long, license string, priority int, start int, end int")
