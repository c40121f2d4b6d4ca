"""Edit-aware token counts: a segment tree over each document's pre-tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.tokens import MOST_CACHED, TOKENIZERS, Encoder, encoder

EDITS = "array<struct<start:int,remove:int,insert:string>>"
FAN = 32  # pieces of a leaf, and nodes of a node; up to twice as many after edits


class Counts:
    """Token counts of pieces, each encoded once while cached."""

    def __init__(self, enc: Encoder):
        self.enc, self.cache = enc, {}

    def miss(self, piece: str) -> int:
        n = len(self.enc.encoding.encode_ordinary(piece))
        if len(self.cache) >= MOST_CACHED:
            self.cache.clear()
        if len(piece) < 40:
            self.cache[piece] = n
        return n

    def of(self, pieces: list[str]) -> list[int]:
        get, miss = self.cache.get, self.miss
        return [get(p) or miss(p) for p in pieces]


class _Node:
    """A subtree with the characters and tokens of all that it holds: at the bottom pieces and their counts, above that nodes."""

    __slots__ = ("chars", "tokens", "kids", "counts")

    def __init__(self, chars: int, tokens: int, kids: list, counts: list[int] | None):
        self.chars, self.tokens, self.kids, self.counts = chars, tokens, kids, counts


def _leaves(pieces: list[str], counts: list[int]) -> list[_Node]:
    if not pieces:
        return []
    at = np.arange(0, len(pieces), FAN)
    chars = np.add.reduceat(np.fromiter(map(len, pieces), np.int64, len(pieces)), at).tolist()
    tokens = np.add.reduceat(np.array(counts, np.int64), at).tolist()
    return [_Node(c, t, pieces[i : i + FAN], counts[i : i + FAN]) for i, c, t in zip(at.tolist(), chars, tokens)]


def _over(kids: list[_Node]) -> _Node:
    return _Node(sum(k.chars for k in kids), sum(k.tokens for k in kids), kids, None)


def _parted(kids: list[_Node]) -> list[_Node]:
    return [_over(kids[i : i + FAN]) for i in range(0, len(kids), FAN)]


class TokenTree:
    """Characters and tokens of a text by pre-token, summed up a tree of wide nodes.

    Pieces are what the encoder's pattern always cuts apart. An edit takes out the pieces that it touches, the one before them
    (whose end depends on what follows) and the one that holds the next character, and puts the pieces of the new
    text in their place, each a leaf of its own: only those are encoded again, sums change on the paths to them, and nodes
    that have become too wide are parted, so however many edits there are, each costs as much as it touches.
    """

    def __init__(self, text: str, counts: Counts):
        self.counts = counts
        pieces = Encoder.pieces(text)
        self.encoded = len(pieces)
        self._grow(_leaves(pieces, counts.of(pieces)))

    def _grow(self, nodes: list[_Node]) -> None:
        while len(nodes) > 1:
            nodes = _parted(nodes)
        self.root = nodes[0] if nodes else _Node(0, 0, [], [])
        while self.root.counts is None and len(self.root.kids) == 1:
            self.root = self.root.kids[0]

    @property
    def tokens(self) -> int:
        return self.root.tokens

    @property
    def chars(self) -> int:
        return self.root.chars

    def locate(self, pos: int) -> tuple[int, int]:
        """(first character, length) of the piece that holds the character."""
        node, begin = self.root, 0
        while node.counts is None:
            for kid in node.kids:
                if pos < begin + kid.chars:
                    break
                begin += kid.chars
            node = kid
        for piece in node.kids:
            if pos < begin + len(piece):
                break
            begin += len(piece)
        return begin, len(piece)

    def _texts(self, node: _Node, lo: int, hi: int, out: list[str]) -> None:
        at = 0
        for kid in node.kids:
            size = len(kid) if node.counts is not None else kid.chars
            if at < hi and at + size > lo:
                if node.counts is not None:
                    out.append(kid)
                else:
                    self._texts(kid, lo - at, hi - at, out)
            at += size

    def _splice(self, node: _Node, lo: int, hi: int, pieces: list[str], counts: list[int]) -> list[_Node]:
        """The nodes that take this one's place when its pieces from lo to hi, both of them bounds of pieces, make way for others."""
        at = 0
        if node.counts is not None:
            i = j = 0
            for k, piece in enumerate(node.kids):
                i += at < lo
                j += at < hi
                at += len(piece)
            own, of = node.kids[:i] + pieces + node.kids[j:], node.counts[:i] + counts + node.counts[j:]
            return _leaves(own, of) if len(own) > 2 * FAN else [_Node(sum(map(len, own)), sum(of), own, of)] if own else []
        kids, placed = [], False
        for k, kid in enumerate(node.kids):
            end = at + kid.chars
            if not placed and (lo < end or k == len(node.kids) - 1):
                placed = True
                kids += self._splice(kid, lo - at, min(hi - at, kid.chars), pieces, counts)
            elif placed and at < hi:
                if end > hi:
                    kids += self._splice(kid, 0, hi - at, [], [])
            else:
                kids.append(kid)
            at = end
        return _parted(kids) if len(kids) > 2 * FAN else [_over(kids)] if kids else []

    def edit(self, start: int, remove: int, insert: str) -> int:
        """Replace ``remove`` characters from ``start`` on; returns how many pieces were encoded."""
        total = self.chars
        start = min(max(start, 0), total)
        stop = min(max(start + remove, start), total)
        begin = end = 0
        if total:
            begin, _ = self.locate(max(0, start - 1))
            if begin:
                begin, _ = self.locate(begin - 1)
            last, size = self.locate(min(stop, total - 1))
            end = last + size
        old: list[str] = []
        self._texts(self.root, begin, end, old)
        text = "".join(old)
        pieces = Encoder.pieces(text[: start - begin] + insert + text[stop - begin :])
        self._grow(self._splice(self.root, begin, end, pieces, self.counts.of(pieces)))
        return len(pieces)

    def text(self) -> str:
        out: list[str] = []
        self._texts(self.root, 0, self.chars, out)
        return "".join(out)


_COLUMNS = ["doc_id", "tokens_before", "tokens_after", "chars_after", "pieces", "encoded"]


def _apply(folder: str):
    def run(batches):
        counts = Counts(encoder(folder))
        for batch in batches:
            out = []
            for text, edits in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist()):
                tree = TokenTree(text or "", counts)
                before, again = tree.tokens, 0
                for e in edits or []:
                    if e is not None and e["start"] is not None:
                        again += tree.edit(e["start"], e["remove"] or 0, e["insert"] or "")
                out.append((before, tree.tokens, tree.chars, tree.encoded, again))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in (zip(*out) if out else [[]] * 5))], names=_COLUMNS)

    return run


def edited_counts(docs: DataFrame, tokenizers: str = TOKENIZERS) -> DataFrame:
    """(doc_id, tokens_before, tokens_after, chars_after, pieces, encoded) of every row of docs(doc_id, text, edits).

    ``edits`` is an array of (start, remove, insert) in the order they apply, each in characters of the text as the
    ones before left it; places beyond the text mean its end. ``pieces`` counts the pre-tokens of the whole text,
    ``encoded`` those that edits had encoded again.

    A null text is an empty one, null edits and edits without start do nothing, and a null remove or insert is 0 or
    empty. Each row has its own tree: repeated rows and null doc_ids stay, very long texts are read in full, an
    empty table gives no rows, and other columns aren't read.
    """
    tc.ship(docs.sparkSession)
    return docs.select(tc.long_id().alias("doc_id"), "text", F.col("edits").cast(EDITS).alias("edits")).mapInArrow(_apply(tokenizers), ", ".join(f"{c} long" for c in _COLUMNS))


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs(doc_id, text) with the edits of a table edits(doc_id, seq, start, remove, insert), in the order of seq.

    Edits of equal seq come in the order of their start, remove and insert, nulls first; repeated edits apply as often as they are there, and
    to every row of their doc_id. Edits of absent or null doc_ids go unused, rows without edits have null ones, long texts
    stay whole, empty tables give rows without edits or no rows, and other columns aren't read.
    """
    listed = edits.groupBy(tc.long_id().alias("__id")).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "remove", "insert"))).alias("e"))
    joined = docs.select("doc_id", "text").join(listed, docs["doc_id"].cast("long") == listed["__id"], "left")
    return joined.select("doc_id", "text", F.transform("e", lambda e: F.struct(e["start"].cast("int").alias("start"), e["remove"].cast("int").alias("remove"), e["insert"].alias("insert"))).alias("edits"))


def standard_edits(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, edits) with three edits each, at a quarter, half and three quarters of the text: a deletion, an insertion, a replacement.

    Places follow from the length of the whole text, however long; a null or empty text is edited at 0. Every row has its edits, repeated rows and null
    doc_ids too, an empty table stays one, and other columns aren't read.
    """
    n = F.coalesce(F.length("text"), F.lit(0))
    one = lambda start, remove, insert: F.struct(start.cast("int").alias("start"), F.lit(remove).alias("remove"), F.lit(insert).alias("insert"))
    edits = F.array(one(F.floor(n / 4), 7, ""), one(F.floor(n / 2), 0, " revised"), one(F.floor(n * 3 / 4), 5, "2024,\n"))
    return docs.select("doc_id", "text", edits.alias("edits"))
