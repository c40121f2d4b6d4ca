"""Benchmark decontamination: approximate occurrences of test items, by pigeonhole pieces and Myers' algorithm."""

from __future__ import annotations


import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc

ERROR_RATE = 0.05  # edits allowed, as a share of an item's normalised length
WHOLE_WORDS = 8  # items of fewer normalised characters, which are parts of many words, match as whole words only
CHUNK_CHARS = 4_000_000  # item text that one automaton holds; a larger benchmark takes several passes over the documents

_NORMAL = np.arange(256, dtype=np.uint8)
for _b in range(128):
    if not chr(_b).isalnum():
        _NORMAL[_b] = 32


def normalised(text: pa.Array) -> list[str]:
    """Lower-cased texts in which each run of ASCII characters that aren't alphanumeric is one space, none at the ends."""
    out: list[str] = []
    raw, off, _ = tc.text_buffers(pc.utf8_lower(text))
    for i, j in tc.slices(off):
        lo = off[i]
        b = _NORMAL[raw[lo : off[j]]]
        space = b == 32
        first = np.zeros(len(b) + 1, bool)
        first[off[i : j + 1] - lo] = True
        keep = ~space
        keep[1:] |= ~space[:-1] & ~first[1:-1]
        kept = np.concatenate([[0], np.cumsum(keep)])[off[i : j + 1] - lo]
        b = b[keep].tobytes()
        out += [b[x:y].decode().strip(" ") for x, y in zip(kept[:-1], kept[1:])]
    return out


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """The item cut in budget + 1 pieces of nearly equal length, with their offsets."""
    cuts = [len(item) * k // (budget + 1) for k in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]


def myers(item: str, text: str, budget: int) -> list[tuple[int, int]]:
    """(end, distance) of every substring end of text where the item matches with at most ``budget`` edits.

    Myers' bit-parallel automaton: one big integer for each column of the edit matrix.
    """
    m = len(item)
    peq: dict[str, int] = {}
    for k, c in enumerate(item):
        peq[c] = peq.get(c, 0) | (1 << k)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, out = mask, 0, m, []
    for at, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & mask, (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        if score <= budget:
            out.append((at + 1, score))
    return out


class Matcher:
    """An automaton over the pieces of some items."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.same = [], []
        seen: dict[str, int] = {}
        wanted: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            if not text:
                continue
            if text in seen:  # equal items are looked for once
                self.same[seen[text]].append(item_id)
                continue
            n, budget = len(self.items), int(len(text) * rate)
            seen[text] = n
            self.items.append((text, budget))
            self.same.append([item_id])
            for offset, piece in [(-1, f" {text} ")] if len(text) < WHOLE_WORDS else pieces(text, budget):
                wanted.setdefault(piece, []).append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in wanted.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if wanted:
            self.automaton.make_automaton()

    def matches(self, text: str) -> list[tuple[int, int, int]]:
        """(item_id, distance, end) of the best match of each item that the text holds, the leftmost of equal ones."""
        if not self.items or not text:
            return []
        windows: dict[int, list[tuple[int, int]]] = {}
        best: dict[int, tuple[int, int]] = {}
        for last, (size, uses) in self.automaton.iter(f" {text} "):  # places are one off in the padded text
            for n, offset in uses:
                item, budget = self.items[n]
                begin = last - size - offset
                if offset < 0:
                    best.setdefault(n, (0, begin + len(item)))
                    continue
                windows.setdefault(n, []).append((max(0, begin - budget), min(len(text), begin + len(item) + budget)))
        for n, spans in windows.items():
            item, budget = self.items[n]
            for lo, hi in united(spans):
                found = [(distance, lo + end) for end, distance in myers(item, text[lo:hi], budget)]
                if found and (n not in best or min(found) < best[n]):
                    best[n] = min(found)
                if n in best and best[n][0] == 0:  # no later one can be nearer, and the leftmost counts
                    break
        return [(i, *best[n]) for n in sorted(best) for i in self.same[n]]


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans in order, those that overlap as one: a text that hits an item's pieces again and again is gone through once."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("end", pa.int32())])


def _search(matcher):
    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(i, *m) for i, text in zip(ids, normalised(batch.column("text"))) for m in matcher.value.matches(text)]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _OUT)], schema=_OUT)

    return run


def _chunks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """Items, normalised, in chunks that one automaton can hold; a chunk is fetched by its own query. No item: one empty chunk."""
    rows = benchmark.select(tc.long_id("item_id").alias("item_id"), "text").where("item_id is not null and text is not null")
    total = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(-(-total // CHUNK_CHARS)) or 1
    for k in range(n):
        got = rows.where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).distinct().orderBy("item_id", "text").toPandas()
        yield list(zip(got["item_id"].tolist(), normalised(pa.array(got["text"], pa.string()))))


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """(doc_id, item_id, distance, end): the best match of each benchmark item in each document that holds it.

    Both are compared lower-cased, with every run of ASCII characters but letters and digits as one space. An item
    of m such characters may have floor(rate * m) edits. Cut in one piece more than that, it has a piece without
    an edit in any match, so exact hits of pieces miss nothing; around each hit Myers' algorithm finds the least
    distance of the item to any substring. Items of fewer than 8 such characters have no edit to spare and match as whole
    words only. ``end`` is where the match ends in the normalised document, the leftmost place of equal distances.

    Rows without doc_id or text, and items without id, text or a letter, match nothing;
    empty tables give no rows. Equal items are each reported, repeated rows count once, very long documents are
    read in full, and other columns aren't read. A benchmark of more than 4 million characters is searched for
    in as many passes as it has such chunks.
    """
    spark: SparkSession = docs.sparkSession
    tc.ship(spark)
    base = docs.select(tc.long_id().alias("doc_id"), "text").where("doc_id is not null and text is not null")
    out = None
    for items in _chunks(benchmark):
        matcher = spark.sparkContext.broadcast(_Lazy(items, rate))
        part = base.mapInArrow(_search(matcher), "doc_id long, item_id long, distance int, end int")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("doc_id", "item_id").agg(F.min(F.struct("distance", "end")).alias("m")).select("doc_id", "item_id", "m.distance", "m.end")


def _clean(matcher, text_at: int):
    def run(batches):
        for batch in batches:
            held = [bool(t) and bool(matcher.value.matches(t)) for t in normalised(batch.column(text_at).fill_null(""))]
            yield batch.filter(pa.array([not h for h in held], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The rows of docs that hold no benchmark item, see ``contaminated``; each row is judged by its own text, without a shuffle.

    Rows without text stay, rows without doc_id are judged like others, repeated rows stay or go together. Columns keep their names,
    order and values, whatever they are called; an empty table stays one.
    """
    spark = docs.sparkSession
    tc.ship(spark)
    for items in _chunks(benchmark):
        docs = docs.mapInArrow(_clean(spark.sparkContext.broadcast(_Lazy(items, rate)), docs.columns.index("text")), docs.schema)
    return docs


class _Lazy:
    """Items that become an automaton where they are used first in a process."""

    def __init__(self, items: list[tuple[int, str]], rate: float):
        self.items, self.rate, self.made = items, rate, None

    def __getstate__(self):
        return (self.items, self.rate)

    def __setstate__(self, state):
        self.items, self.rate, self.made = *state, None

    def matches(self, text: str):
        if self.made is None:
            self.made = Matcher(self.items, self.rate)
        return self.made.matches(text)
