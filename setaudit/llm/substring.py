"""Substring dedup: passages that occur in several documents, by FM-indexes over shards of candidate text."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.fmindex import FMIndex
from setaudit.runtime import free

LEAST_WORDS = 50  # length of the shortest passage reported
GRAM = 12  # words of a fingerprint
PER_SHARD = 6_000  # pieces of a shard on average
MOST_PIECES = 5_000  # pieces around one gram that go to an index; what surrounds a more frequent gram is compared window by window
BLOCK = 12_000  # pieces of one index; a shard with more is a chain of indexes, each of which sees every query

_FP = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("pos", pa.int32()), ("fp", pa.int64())])


def sampled(h: np.ndarray, bounds: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(word positions, fingerprints): in every ``least`` words of a document the rightmost least gram hash.

    Equal passages of that length have equal choices, so a passage that repeats shares a fingerprint at each
    of its windows: leaving out text without shared fingerprints loses nothing.
    """
    w = least - gram + 1
    g = tc.grams(h, gram)
    if len(g) < w:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    low = np.uint64((1 << 24) - 1)
    key = (g & ~low) | (low - np.arange(len(g), dtype=np.uint64) % (low + np.uint64(1)))
    best, span = key, 1
    while span * 2 <= w:
        best = np.minimum(best[:-span], best[span:])
        span *= 2
    if span < w:
        best = np.minimum(best[: len(best) - (w - span)], best[w - span :])
    start = np.arange(len(best))
    doc = np.searchsorted(bounds, start, "right") - 1
    inside = start + least <= bounds[doc + 1]
    at = start[inside]
    slot = (low - (best[inside] & low)).astype(np.int64)
    pos = at + (slot - at) % (1 << 24)
    pos = pos[np.concatenate([[True], pos[1:] != pos[:-1]])] if len(pos) else pos
    return pos, g[pos]


def _fingerprints(least: int, gram: int):
    def run(batches):
        for batch in batches:
            raw, off, _ = tc.text_buffers(batch.column("text"))
            ids, th = (batch.column(c).to_numpy() for c in ("doc_id", "th"))
            for i, j in tc.slices(off):
                w = tc.Words(raw, off[i : j + 1])
                pos, fp = sampled(w.hashes(), w.bounds, least, gram)
                if len(pos):
                    d = np.searchsorted(w.bounds, pos, "right") - 1
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][d]), pa.array(th[i:j][d]), pa.array((pos - w.bounds[d]).astype(np.int32)), pa.array(fp.view(np.int64))], schema=_FP)

    return run


def _pieces(least: int, gram: int):
    """For each candidate fingerprint the words around it that passages holding it can reach within ``least``. For a hot one
    (words null) the hash and place of each passage of that length that holds it, once however many hot ones it holds."""

    def run(batches):
        for batch in batches:
            raw, off, _ = tc.text_buffers(batch.column("text"))
            ids, th = (batch.column(c).to_numpy() for c in ("doc_id", "th"))
            cand = batch.column("cand")
            for i, j in tc.slices(off):
                w = tc.Words(raw, off[i : j + 1])
                h = w.hashes()
                words = (h >> np.uint64(32)).astype(np.uint32)
                part = cand.slice(i, j - i)
                flat, lists = part.flatten(), part.value_lengths().to_numpy(zero_copy_only=False)
                d = np.repeat(np.arange(j - i), lists)
                pos = flat.field("pos").to_numpy().astype(np.int64) + w.bounds[d]
                fp, hot = flat.field("fp").to_numpy(), flat.field("hot").to_numpy(zero_copy_only=False)
                lo = np.maximum(w.bounds[d], pos - (least - gram))
                hi = np.minimum(w.bounds[d + 1], pos + least)
                few = np.flatnonzero(~hot)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(few), bool)), pa.array(fp[few]), pa.array(ids[i:j][d[few]]), pa.array(th[i:j][d[few]]), pa.array((lo - w.bounds[d])[few].astype(np.int32)), pa.array([words[a:b].tobytes() for a, b in zip(lo[few], hi[few])], pa.binary())],
                    names=_PIECE,
                )
                if hot.any():
                    last = np.minimum(pos, w.bounds[d + 1] - least)
                    some = hot & (lo <= last)
                    mark = np.zeros(len(w) + 1, np.int64)
                    np.add.at(mark, lo[some], 1)
                    np.add.at(mark, last[some] + 1, -1)
                    at = np.flatnonzero(np.cumsum(mark)[:-1] > 0)
                    own = np.searchsorted(w.bounds, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.ones(len(at), bool)), pa.array(tc.grams(h, least)[at].view(np.int64)), pa.array(ids[i:j][own]), pa.array(th[i:j][own]), pa.array((at - w.bounds[own]).astype(np.int32)), pa.nulls(len(at), pa.binary())],
                        names=_PIECE,
                    )

    return run


_PIECE = ["hot", "fp", "doc_id", "th", "start", "words"]
_STRETCH = [("start_word", pa.int32()), ("end_word", pa.int32())]
_HIT = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), *_STRETCH])


def shard_hits(doc: np.ndarray, start: np.ndarray, words: list[bytes], least: int, earlier: bool, block: int = BLOCK, text: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, end) of the stretches of each piece whose passages other (or smaller) documents hold. text: a number for each text, doc by default."""
    text = doc if text is None else text
    code, content = pd.factorize(np.array(words, dtype=object))
    low, high = np.full(len(content), np.iinfo(np.int64).max), np.full(len(content), np.iinfo(np.int64).min)
    np.minimum.at(low, code, doc)
    np.maximum.at(high, code, doc)
    size = np.array([len(c) // 4 for c in content])
    whole = (doc != low[code]) if earlier else (low != high)[code]
    whole &= size[code] >= least
    out = [(text[whole], start[whole], start[whole] + size[code[whole]])]
    ask = np.flatnonzero((size >= least) & (np.ones(len(content), bool) if earlier else low == high))
    owner = low if earlier else np.where(low == high, low, -1)
    bounds = np.concatenate([[0], np.cumsum(size)])
    raw = np.frombuffer(b"".join(content), np.uint32)
    reach = np.zeros(len(raw) + 1, np.int32)
    asked = np.concatenate([np.arange(bounds[a], bounds[a + 1]) for a in ask]) if len(ask) else np.zeros(0, np.int64)
    ask_bounds = np.concatenate([[0], np.cumsum(size[ask])])
    for a in range(0, len(content), block):
        b = min(a + block, len(content))
        own = raw[bounds[a] : bounds[b]]
        vocabulary, symbols = np.unique(own, return_inverse=True)
        index = FMIndex(symbols, bounds[a : b + 1] - bounds[a], owner[a:b], len(vocabulary), earlier)
        at = np.minimum(np.searchsorted(vocabulary, raw[asked]), len(vocabulary) - 1)
        found = index.statistics(np.where(vocabulary[at] == raw[asked], at, -1), ask_bounds, low[ask])
        reach[asked] = np.maximum(reach[asked], found)
        del index
    # union of [i, i + reach[i]) where long enough, for the pieces' first holders
    i = np.flatnonzero(reach >= least)
    mark = np.zeros(len(raw) + 1, np.int32)
    np.add.at(mark, i, 1)
    np.add.at(mark, i + reach[i], -1)
    # pieces follow one another, so a stretch that ends at a piece's end and the next one's stay apart by piece
    cover = np.cumsum(mark)[:-1] > 0
    piece = np.repeat(np.arange(len(content)), size)
    edge = np.ones(len(raw) + 1, bool)
    edge[1:-1] = (cover[1:] != cover[:-1]) | (piece[1:] != piece[:-1])
    cuts = np.flatnonzero(edge)
    s, e = cuts[:-1], cuts[1:]
    keep = cover[s]
    s, e = s[keep], e[keep]
    p = piece[s]
    # every row of the first holder that has this piece
    first = np.flatnonzero(doc == low[code])
    first = first[np.argsort(code[first], kind="stable")]
    lo, hi = np.searchsorted(code[first], p, "left"), np.searchsorted(code[first], p, "right")
    n = hi - lo
    row = first[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    out.append((text[row], start[row] + np.repeat(s - bounds[p], n), start[row] + np.repeat(e - bounds[p], n)))
    d, s, e = (np.concatenate(x) for x in zip(*out))
    return merged(d, s, e)


def merged(d: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of overlapping stretches of each document; stretches that only touch stay apart."""
    if not len(d):
        return d, s, e
    order = np.lexsort((e, s, d))
    d, s, e = d[order], s[order], e[order]
    new = np.concatenate([[True], d[1:] != d[:-1]])
    group = np.cumsum(new) - 1
    far = np.int64(e.max()) + 1
    reach = np.maximum.accumulate(e + group * far) - group * far  # the furthest end so far within the document
    split = new.copy()
    split[1:] |= s[1:] >= reach[:-1]
    at = np.flatnonzero(split)
    return d[at], s[at], np.maximum.reduceat(e, at)


def _shard(least: int, earlier: bool):
    def run(t: pa.Table) -> pa.Table:
        doc, th = t.column("doc_id").to_numpy(), t.column("th").to_numpy()
        of, first = np.unique(np.stack([doc, th]), axis=1, return_inverse=True)
        n, s, e = shard_hits(doc, t.column("start").to_numpy().astype(np.int64), t.column("words").to_pylist(), least, earlier, text=first.ravel())
        return pa.Table.from_arrays([pa.array(of[0, n], pa.int64()), pa.array(of[1, n], pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema=_HIT)

    return run


def _join_stretches(keys: list[str]):
    def run(batches):
        for batch in batches:
            lists = batch.column("hits")
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            row, s, e = merged(row, *(flat.field(c).to_numpy().astype(np.int64) for c, _ in _STRETCH))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(pa.array(row)) for k in keys), pa.array(s, pa.int32()), pa.array(e, pa.int32())], names=[*keys, "start_word", "end_word"])

    return run


def _located(docs: DataFrame, least: int, earlier: bool, most: int, keys: list[str]) -> DataFrame:
    """(keys, start_word, end_word) of the repeated stretches; keys: doc_id, and th (the text's hash) to tell texts of one doc_id apart."""
    spark = docs.sparkSession
    tc.ship(spark)
    gram = min(GRAM, least)
    base = docs.select(tc.long_id().alias("doc_id"), "text").where("doc_id is not null and text is not null").withColumn("th", F.xxhash64("text"))
    fps = tc.table(base.mapInArrow(_fingerprints(least, gram), "doc_id long, th long, pos int, fp long"), "fingerprints")
    shared = fps.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b").select("fp", (F.col("n") > most).alias("hot"))
    cand = fps.join(shared, "fp").groupBy("doc_id", "th").agg(F.collect_set(F.struct("pos", "fp", "hot")).alias("cand"))  # a set: a row that is there r times has its grams once
    pieces = tc.table(base.join(cand, ["doc_id", "th"]).select("doc_id", "th", "text", "cand").mapInArrow(_pieces(least, gram), "hot boolean, fp long, doc_id long, th long, start int, words binary"), "pieces")
    tc.drop(fps)
    n = pieces.agg(F.count_if(~F.col("hot")).alias("few"), F.count_if("hot").alias("hot")).first()
    shards = max(1, -(-n["few"] // PER_SHARD))
    placed = pieces.where("not hot").select(F.pmod(F.xxhash64("fp"), F.lit(shards)).alias("shard"), "doc_id", "th", "start", "words")
    spread = placed.repartition(max(1, min(shards, 8 * tc.partitions(spark))), "shard")
    hits = spread.groupBy("shard").applyInArrow(_shard(least, earlier), "doc_id long, th long, start_word int, end_word int")
    if n["hot"]:
        windows = pieces.where("hot").select("fp", "doc_id", "th", "start")
        twice = windows.groupBy("fp").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("fp", "a")
        held = windows.join(twice, "fp")
        held = held.where("doc_id > a") if earlier else held
        hits = hits.unionByName(held.select("doc_id", "th", F.col("start").alias("start_word"), (F.col("start") + least).cast("int").alias("end_word")))
    listed = hits.groupBy(*keys).agg(F.collect_list(F.struct("start_word", "end_word")).alias("hits"))
    return listed.mapInArrow(_join_stretches(keys), ", ".join(f"{k} long" for k in keys) + ", start_word int, end_word int")


def repeated_passages(docs: DataFrame, least: int = LEAST_WORDS, earlier: bool = False, most: int = MOST_PIECES) -> DataFrame:
    """(doc_id, start_word, end_word): stretches of each document made of passages that other documents hold too.

    Words are runs of anything but ASCII white space, compared as they stand. A stretch is the union of
    overlapping passages of at least ``least`` words that each occur word for word in a document with another
    doc_id (earlier=True: with a smaller one, so that the first copy stays unreported); end_word is exclusive.
    A passage that only repeats within its own document isn't reported.

    A sampled gram in every ``least`` words tells which text can match at all; pieces around shared grams are
    sharded by gram, so all text that shares one meets in one shard, whatever the size of the corpus. Each shard
    has an FM-index through which its pieces are streamed. A gram that more than ``most`` pieces share (a banner, a licence,
    a document with countless copies) would be a shard without bound; each passage of ``least`` words that holds it is
    compared by a 64-bit hash instead, in an aggregation that combines before it shuffles. Both ways report the same stretches.
    Elsewhere words are compared by 32-bit hashes next to an equal 64-bit gram hash.

    Rows without doc_id or text take no part; rows of one doc_id are one document, and its stretches are those of
    any of its texts. Documents of fewer than ``least`` words and empty tables give no rows, a very long document
    is read in full, repeated rows count once, and other columns aren't read.
    """
    return _located(docs, least, earlier, most, ["doc_id"])


def without_repeats(docs: DataFrame, least: int = LEAST_WORDS, most: int = MOST_PIECES) -> DataFrame:
    """docs with each passage of ``least`` words or more only in the document of the smallest doc_id, cut from all others.

    Each text of a doc_id has its own stretches. See ``without_passages`` for what becomes of a document.
    """
    return without_passages(docs, _located(docs, least, True, most, ["doc_id", "th"]))


def _without(text_at: int, hits_at: int):
    def run(batches):
        for batch in batches:
            raw, off, valid = tc.text_buffers(batch.column(text_at))
            lists = batch.column(hits_at)
            n = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = lists.flatten()
            start, end = (flat.field(c).to_numpy() for c, _ in _STRETCH)
            at, texts = np.concatenate([[0], np.cumsum(n)]), []
            for k in range(len(batch)):
                text = raw[off[k] : off[k + 1]]
                w = tc.Words(raw, off[k : k + 2])
                begins = np.concatenate([w.starts, [len(text)]])
                keep = np.ones(len(text), bool)
                for s, e in zip(start[at[k] : at[k + 1]], end[at[k] : at[k + 1]]):
                    keep[begins[min(s, len(w))] : begins[min(e, len(w))]] = False
                texts.append(text[keep].tobytes().decode())
            columns = [pa.array(texts, pa.string(), mask=~valid) if c == text_at else batch.column(c) for c in range(batch.num_columns) if c != hits_at]
            yield pa.RecordBatch.from_arrays(columns, names=[f.name for c, f in enumerate(batch.schema) if c != hits_at])

    return run


def without_passages(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """docs with each reported stretch taken out of ``text`` and n_chars, where there is one, counted again.

    hits(doc_id, start_word, end_word), or with th, the hash of the text that a stretch is of. Documents of which nothing but
    white space is left go; all others stay, those without doc_id, text or stretch as they are, repeated rows too. Columns keep
    their names, order and values, whatever they are called; an empty table stays one.
    """
    own, text, listing = free(docs.columns, "__id", "__th", "__hits")
    by_text = "th" in hits.columns
    keys = [F.col("doc_id").alias(own)] + ([F.col("th").alias(text)] if by_text else [])
    listed = hits.groupBy(*keys).agg(F.collect_list(F.struct("start_word", "end_word")).alias(listing))
    same_row = docs["doc_id"].cast("long") == listed[own]
    if by_text:
        same_row = same_row & (F.xxhash64(docs["text"]) == listed[text])
    held = docs.join(listed, same_row, "left").select(*[docs[f"`{c}`"] for c in docs.columns], listed[listing])
    same = held.where(F.col(listing).isNull()).drop(listing)
    other = held.where(F.col(listing).isNotNull())
    left = other.mapInArrow(_without(docs.columns.index("text"), len(docs.columns)), docs.schema).where(r"text rlike '\\S'")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return same.unionByName(left)
