"""SimHash near-duplicates: every pair within the radius is found, tile against tile, by blocks of bits where tables are large."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.graph import components, forest
from setaudit.runtime import free

RADIUS = 24  # of 128 bits: unrelated documents differ in 60 bits or so, light edits in 20 at most
LEAST_BYTES = 4  # shorter words without a digit are mostly function words, which unrelated documents share
TILE = 16_384
PLAIN = 1 << 17  # signatures that are all compared with each other; with more, only those alike in one of 8 blocks of bits
WIDE = 1 << 20  # signatures of a tile that is gone through by blocks
MOST_TILES = 512  # beyond this many, tiles grow instead, so the plan of tile pairs stays small

_SPREAD = np.ascontiguousarray(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)).view(np.uint64).ravel()
_LANE = 255  # words that 8-bit counters hold


def signatures_of(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """((n, 2) uint64 signatures, (n,) whether the document has any word) of lower-cased UTF-8 documents."""
    n = len(offsets) - 1
    out, some = np.zeros((n, 2), np.uint64), np.zeros(n, bool)
    for i, j in tc.slices(offsets):
        w = tc.Words(raw, offsets[i : j + 1], "alnum")
        if not len(w):
            continue
        h, d = w.hashes(), w.doc_of()
        digits = np.concatenate([[0], np.cumsum((w.buf >= 48) & (w.buf <= 57))])
        long = ((w.ends - w.starts) >= LEAST_BYTES) | (digits[w.ends] > digits[w.starts])
        has_long = np.bincount(d[long], minlength=j - i) > 0
        use = long | ~has_long[d]
        key = np.sort((d[use].astype(np.uint64) << np.uint64(44)) | (h[use] >> np.uint64(20)))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        d = (key >> np.uint64(44)).astype(np.int64)
        f = tc.mix(key & np.uint64((1 << 44) - 1))
        bits = np.concatenate([f.view(np.uint8).reshape(-1, 8), tc.mix(f ^ np.uint64(0x5851F42D4C957F2D)).view(np.uint8).reshape(-1, 8)], axis=1)
        bounds = np.searchsorted(d, np.arange(j - i + 1))
        size = np.diff(bounds)
        some[i:j] = size > 0
        # segments of at most 255 words, so that byte lanes can't overflow
        per = -(-size // _LANE)
        seg_doc = np.repeat(np.arange(j - i), per)
        nth = np.arange(len(seg_doc)) - np.repeat(np.cumsum(per) - per, per)
        starts = bounds[seg_doc] + nth * _LANE
        lanes = np.add.reduceat(_SPREAD[bits], starts, axis=0).view(np.uint8).reshape(len(starts), 128)
        counts = tc.segment_sums(lanes.astype(np.int64), np.concatenate([[0], np.cumsum(per)]))
        out[i:j] = np.packbits(2 * counts > size[:, None], axis=1).view(np.uint64)
    return out, some


_SIG = pa.schema([("doc_id", pa.int64()), ("th", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])


def _signature_batches(batches):
    for batch in batches:
        raw, offsets, _ = tc.text_buffers(pc.utf8_lower(batch.column("text")))
        sig, some = signatures_of(raw, offsets)
        s = sig.view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("th"), pa.array(s[:, 0], mask=~some), pa.array(s[:, 1], mask=~some)], schema=_SIG)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, th, s0, s1): a hash of each text and its 128 bits, which are null where it has no word or isn't there."""
    tc.ship(docs.sparkSession)
    return docs.select(tc.long_id().alias("doc_id"), F.xxhash64("text").alias("th"), "text").mapInArrow(_signature_batches, "doc_id long, th long, s0 long, s1 long")


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool):
    """Index pairs within the radius of two (n, 2) arrays sorted by population count; for same, i < j only."""
    pa_, pb = np.bitwise_count(a).sum(1).astype(np.int64), np.bitwise_count(b).sum(1).astype(np.int64)
    b0, b1 = np.ascontiguousarray(b[:, 0]), np.ascontiguousarray(b[:, 1])
    step = 16
    for i in range(0, len(a), step):
        j = min(len(a), i + step)
        lo = int(np.searchsorted(pb, pa_[i] - radius, "left"))
        hi = int(np.searchsorted(pb, pa_[j - 1] + radius, "right"))
        if same:
            lo = max(lo, i)
        if lo >= hi:
            continue
        apart = np.bitwise_count(a[i:j, :1] ^ b0[lo:hi])
        apart += np.bitwise_count(a[i:j, 1:] ^ b1[lo:hi])
        near = apart <= radius
        if near.any():
            x, y = np.nonzero(near)
            x, y = x + i, y + lo
            if same:
                x, y = x[x < y], y[x < y]
            yield x, y


BLOCKS = 8  # of 16 bits each
HELD = 1 << 17  # distances held at once


def reaches(radius: int) -> list[int]:
    """Bits that each block may differ in. Were each block of a pair apart by more than that, the pair would be apart by more than
    the radius, so a pair within it is within reach in some block. A block of reach -1 needn't be looked at."""
    each, more = divmod(radius + 1, BLOCKS)
    return [each - (k >= more) for k in range(BLOCKS)]


def candidates(a: np.ndarray, b: np.ndarray, reach: int, same: bool):
    """Indices into a and into b, which hold 16 bits of each signature, whose every pair differs in at most reach bits: all such pairs, once each.
    For same, a is b, and a pair comes in one of its orders; equal values come in both, and with themselves."""
    masks = np.arange(1 << 16)
    masks = masks[np.bitwise_count(masks) <= reach]
    by_a, by_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    begin = np.searchsorted(b[by_b], np.arange((1 << 16) + 1))
    size = np.diff(begin)
    value, first = np.unique(a[by_a], return_index=True)
    last = np.append(first[1:], len(a))
    for v, i, j in zip(value.astype(np.int64).tolist(), first.tolist(), last.tolist()):
        other = masks ^ v
        if same:
            other = other[other >= v]
        n = size[other]
        end = np.cumsum(n)
        if end.size and end[-1]:
            yield by_a[i:j], by_b[np.repeat(begin[other] - (end - n), n) + np.arange(end[-1])]


def _alike(a: np.ndarray, b: np.ndarray, radius: int, block: int, same: bool):
    """The pairs of ``_close`` that are within reach in one block, a and b in any order."""
    a0, a1, b0, b1 = (np.ascontiguousarray(x[:, k]) for x in (a, b) for k in (0, 1))
    bits = lambda x: np.ascontiguousarray(x).view(np.uint16).reshape(-1, BLOCKS)[:, block]
    for left, right in candidates(bits(a), bits(b), reaches(radius)[block], same):
        for k in range(0, len(right), HELD):
            some = right[k : k + HELD]
            r0, r1 = b0[some], b1[some]
            step = max(1, HELD // len(some))
            for i in range(0, len(left), step):
                own = left[i : i + step]
                apart = np.bitwise_count(a0[own, None] ^ r0)
                apart += np.bitwise_count(a1[own, None] ^ r1)
                near = np.flatnonzero(apart <= radius)
                if len(near):
                    x, y = own[near // len(some)], some[near % len(some)]
                    yield (x[x != y], y[x != y]) if same else (x, y)


def tile_edges(rep: np.ndarray, sig: np.ndarray, side: np.ndarray, radius: int, block: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what the close pairs of one tile pair join: each node with its component's smallest one.

    With a block, of the pairs within reach in that block alone; all blocks together have all pairs.
    """
    order = np.lexsort((rep, np.bitwise_count(sig).sum(1)))
    rep, sig, side = rep[order], sig[order], side[order]
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = not len(right)
    if same:
        right = left
    ea, eb, held = [], [], 0
    label = np.arange(len(rep))
    for x, y in _close(sig[left], sig[right], radius, same) if block < 0 else _alike(sig[left], sig[right], radius, block, same):
        ea.append(left[x])
        eb.append(right[y])
        held += len(x)
        if held > 1 << 20:  # keeps memory flat where thousands of copies form millions of pairs
            label = forest(len(rep), np.concatenate([*ea, np.arange(len(rep))]), np.concatenate([*eb, label]))
            ea, eb, held = [], [], 0
    label = forest(len(rep), np.concatenate([*ea, np.arange(len(rep))]), np.concatenate([*eb, label]))
    moved = np.flatnonzero(label != np.arange(len(rep)))
    return rep[moved], rep[label[moved]]


_EDGE = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _tile_pair(radius: int):
    def run(t: pa.Table) -> pa.Table:
        sig = np.stack([t.column(c).to_numpy().astype(np.int64) for c in ("s0", "s1")], axis=1).view(np.uint64)
        a, b = tile_edges(t.column("rep").to_numpy(), sig, t.column("side").to_numpy(), radius, t.column("block")[0].as_py())
        return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_EDGE)

    return run


def tiles(counts: dict[int, int], most: int) -> list[tuple[int, int, int, int]]:
    """(first tile, tiles, lowest, highest population count) for runs of counts: a large count is split in several tiles."""
    runs, at, lo, held = [], 0, None, 0
    for p in sorted(counts):
        if lo is not None and held + counts[p] > most:
            k = -(-held // most)
            runs.append((at, k, lo, prev))
            at, lo, held = at + k, None, 0
        lo, held, prev = (p if lo is None else lo), held + counts[p], p
    if lo is not None:
        runs.append((at, -(-held // most), lo, prev))
    return runs


def _links(uniq: DataFrame, radius: int, plain: int = PLAIN) -> DataFrame:
    """(node, root) for the nodes of uniq(node, s0, s1, ...) that lie within the radius of another, roots left out.

    Up to ``plain`` nodes all pairs are compared. With more, each tile pair is a task for each block, which compares what is alike in the block.
    """
    spark = uniq.sparkSession
    counted = uniq.select("node", "s0", "s1", (F.bit_count("s0") + F.bit_count("s1")).alias("pop"))
    counts = {r["pop"]: r["n"] for r in counted.groupBy("pop").agg(F.count("*").alias("n")).collect()}  # 129 rows at most
    total = sum(counts.values())
    blocks = [-1] if total <= plain else [k for k, reach in enumerate(reaches(radius)) if reach >= 0]
    runs = tiles(counts, max(TILE if total <= plain else WIDE, -(-total // MOST_TILES)))
    of_tile = [(t, lo, hi) for at, k, lo, hi in runs for t in range(at, at + k)]
    pairs = [(n, i, j, k) for n, (i, j, k) in enumerate((i, j, k) for i, lo, hi in of_tile for j, lo2, hi2 in of_tile if i <= j and lo2 - hi <= radius for k in blocks)]
    if not pairs:
        return spark.createDataFrame([], "node long, root long")
    run_of = F.broadcast(spark.createDataFrame([(p, at, k) for at, k, lo, hi in runs for p in counts if lo <= p <= hi], "pop int, at int, k int"))
    placed = counted.join(run_of, "pop").select("s0", "s1", F.col("node").alias("rep"), (F.col("at") + F.pmod(F.xxhash64("s0", "s1"), F.col("k")).cast("int")).alias("tile"))
    plan = F.broadcast(spark.createDataFrame(pairs, "pair int, i int, j int, block int"))
    left = placed.join(plan, F.col("tile") == F.col("i")).select("pair", "block", "s0", "s1", "rep", F.lit(0).alias("side"))
    right = placed.join(plan.where("i < j"), F.col("tile") == F.col("j")).select("pair", "block", "s0", "s1", "rep", F.lit(1).alias("side"))
    spread = left.unionByName(right).repartition(min(len(pairs) * (4 if len(blocks) > 1 else 1), 4 * tc.partitions(spark)), "pair")
    return components(spread.groupBy("pair").applyInArrow(_tile_pair(radius), "a long, b long"), "a", "b")


def _grouped(sig: DataFrame, radius: int) -> DataFrame:
    """(s0, s1, lead, top, size) of each signature: the (doc_id, th) that its group comes down to, the group's largest doc_id and
    its number of texts. sig: (doc_id, th, s0, s1) without nulls, a row a text."""
    # numbered once they are written, so a signature's number is the same wherever it is read; doc_ids wouldn't do, as one may have several texts
    uniq = tc.cut(sig.groupBy("s0", "s1").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.max("doc_id").alias("top"), F.count("*").alias("size")).withColumn("node", F.monotonically_increasing_id()))
    member = uniq.join(_links(uniq, radius), "node", "left").withColumn("root", F.coalesce("root", "node"))
    group = member.groupBy("root").agg(F.min("rep").alias("lead"), F.max("top").alias("top"), F.sum("size").alias("size"))
    return member.select("s0", "s1", "root").join(group, "root").drop("root")


def simhash_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, group_id, kept) of every document that has a near-duplicate; one of each group is kept.

    Documents whose 128-bit SimHash differs in at most ``radius`` bits are near-duplicates, and groups are the
    connected components of that relation; group_id is the smallest doc_id, which is the one kept. Features are
    the distinct lower-cased words of at least four bytes or with a digit, or all words where there is no such word, so case,
    punctuation, order and repetition don't matter. No pair of distinct signatures within the radius is left out: tiles are
    runs of population counts, and a tile pair whose counts differ by more than the radius is skipped, which
    loses nothing since population counts differ by no more than the distance. Up to ``PLAIN`` distinct signatures all
    are compared; with more, those that differ in at most ``reaches`` bits in one of 8 blocks of 16 bits, as every pair
    within the radius does. There is no bound on how many share a block: they are all compared, a part at a time.

    Rows without text, without a word or without doc_id have no group and aren't returned; an empty table gives
    no rows. A very long text counts in full. Repeated rows are one document; texts of one doc_id that differ in signature are judged
    apart, each with a row of its own, of which one at most is kept in a group. Ties and copies share a group however many there are, and other
    columns aren't read.
    """
    sig = tc.table(signatures(docs).where("doc_id is not null and s0 is not null").distinct(), "simhash")
    group = _grouped(sig, radius).where("lead.doc_id < top")
    kept = (F.col("doc_id") == F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))
    return sig.join(group, ["s0", "s1"]).select("doc_id", F.col("lead.doc_id").alias("group_id"), kept.alias("kept")).distinct()


MOST_BROADCAST = 1_000_000  # (doc_id, hash) pairs of rows that go; more are joined by shuffle


def without_near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each group of ``simhash_groups``: of the smallest doc_id, and of its texts in the group that of the least hash.

    Rows are dropped, not doc_ids: another text of a doc_id stays if it leads its own group. Of rows that repeat both doc_id and
    text one stays. Rows without doc_id, text or words have no group and stay as they are, very long texts count in full. Columns keep
    their names, order and values, whatever they are called; an empty table stays one.

    Texts aren't shuffled where the rows to drop fit in a broadcast, whose size is looked at first.
    """
    sig = signatures(docs).where("doc_id is not null and s0 is not null").groupBy("doc_id", "th", "s0", "s1").agg(F.count("*").alias("rows"))
    sig = tc.table(sig, "simhash")
    group = _grouped(sig, radius).where("size > 1").select("s0", "s1", "lead")
    gone = tc.cut(sig.join(group, ["s0", "s1"]).where((F.col("doc_id") != F.col("lead.doc_id")) | (F.col("th") != F.col("lead.th"))).select("doc_id", "th"))
    own, text, row = free(docs.columns, "__id", "__th", "__row")
    keyed = docs.select("*", tc.long_id().alias(own), F.xxhash64("text").alias(text))

    def matched(keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys
        return keyed.join(keys, (keyed[own] == keys["doc_id"]) & (keyed[text] == keys["th"]), how)

    left = matched(gone, "left_anti")
    twice = tc.cut(sig.where("rows > 1").select("doc_id", "th").join(gone, ["doc_id", "th"], "left_anti"))
    if twice.limit(1).count():
        columns = [F.col(f"`{c}`") for c in docs.columns]
        one = matched(twice, "left_semi").groupBy(own, text).agg(F.first(F.struct(*columns)).alias(row)).select(*[F.col(row).getField(c).alias(c) for c in docs.columns])
        keyed = left
        return matched(twice, "left_anti").select(*columns).unionByName(one)
    return left.drop(own, text)
