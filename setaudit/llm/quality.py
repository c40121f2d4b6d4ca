"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc

MOST_LABELLED = 20_000  # labelled rows used for fitting, chosen by hash of doc_id; the only bound in this module
BUCKETS = 1 << 18
SUPPORT = 5  # documents a word must occur in before its log-odds count

_UPPER, _DIGIT, _SPACE, _PUNCT, _HIGH, _SYMBOL = (np.zeros(256, bool) for _ in range(6))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_HIGH[128:] = True
for _c in b"#$%&*|<>{}[]=~^_\\":
    _SYMBOL[_c] = True
_BANG = np.zeros(256, bool)
_BANG[33] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_CLASSES = np.stack([_UPPER, _DIGIT, _SPACE, _PUNCT, _HIGH, _SYMBOL, _BANG, _LINE]).astype(np.uint64)
_LANES = (_CLASSES[:, :].T << (np.arange(8, dtype=np.uint64) * np.uint64(8))).sum(axis=1, dtype=np.uint64)  # byte -> 8 counters in byte lanes

NAMES = [
    "log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "punct", "high", "symbol", "bang", "line",
    "distinct", "adjacent", "distinct4", "short", "long", "per_line", "odds_max", "odds_mean", "odds_high", "odds_rate",
]


def _byte_counts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(documents, 8) counts of each byte class, 255 bytes at a time so that lanes can't overflow."""
    n, size = len(off) - 1, np.diff(off)
    per = -(-size // 255)
    total = np.zeros((n, 8), np.int64)
    if not per.sum():
        return total
    doc = np.repeat(np.arange(n), per)
    starts = off[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * 255
    lanes = np.add.reduceat(_LANES[buf], starts).view(np.uint8).reshape(-1, 8)
    return tc.segment_sums(lanes.astype(np.int64), np.concatenate([[0], np.cumsum(per)]))


def _distinct(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    key = np.sort((d.astype(np.uint64) << np.uint64(44)) | (h >> np.uint64(20)))
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    return np.bincount((key[first] >> np.uint64(44)).astype(np.int64), minlength=n)


def statistics(text: pa.Array, odds: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """((n, features) float32, words per document) of whole texts; odds: toxic log-odds by word bucket, zeros if None."""
    raw, off, _ = tc.text_buffers(text)
    low, low_off, _ = tc.text_buffers(pc.utf8_lower(text))
    n = len(off) - 1
    out, words = np.zeros((n, len(NAMES)), np.float32), np.zeros(n, np.int64)
    odds = np.zeros(BUCKETS, np.float32) if odds is None else odds
    for i, j in tc.slices(low_off):
        m, o = j - i, off[i : j + 1]
        size = np.maximum(np.diff(o), 1)
        w = tc.Words(low, low_off[i : j + 1], "alnum")
        h, d, count = w.hashes(), w.doc_of(), np.diff(w.bounds)
        least = np.maximum(count, 1)
        length = w.ends - w.starts
        x = out[i:j]
        x[:, 0], x[:, 1] = np.log1p(np.diff(o)), np.log1p(count)
        x[:, 2] = np.bincount(d, length, m) / least
        x[:, 3:11] = _byte_counts(raw[o[0] : o[-1]], o - o[0]) / size[:, None]
        x[:, 11] = _distinct(h, d, m) / least
        if len(h):
            same = np.zeros(len(h), bool)
            same[1:] = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
            x[:, 12] = np.bincount(d, same, m) / least
            g = tc.grams(h, 4)
            whole = d[: len(g)] == d[len(h) - len(g) :]
            gd = d[: len(g)][whole]
            x[:, 13] = (_distinct(g[whole], gd, m) + 1) / (np.bincount(gd, minlength=m) + 1)
            x[:, 14], x[:, 15] = np.bincount(d, length <= 2, m) / least, np.bincount(d, length >= 12, m) / least
            x[:, 16] = count / (1 + x[:, 10] * size)
            s = odds[(h >> np.uint64(46)).astype(np.int64)]
            full = np.flatnonzero(count)
            x[full, 17] = np.maximum.reduceat(s, w.bounds[full])
            x[:, 18] = np.bincount(d, s, m) / least
            high = np.bincount(d, s > 2, m)
            x[:, 19], x[:, 20] = high, high / least
        words[i:j] = count
    return out, words


@dataclass
class Trees:
    """Complete trees of one depth, flattened: node n has children 2n+1 and 2n+2."""

    cuts: list[np.ndarray]
    feature: np.ndarray  # (trees, inner nodes)
    above: np.ndarray  # (trees, inner nodes): right if the bin is larger
    leaf: np.ndarray  # (trees, leaves)
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1).astype(np.uint8)

    def margin(self, x: np.ndarray) -> np.ndarray:
        b, out = self.bins(x), np.full(len(x), self.base)
        row = np.arange(len(x))
        depth = int(np.log2(self.leaf.shape[1])) if len(self.leaf) else 0
        for f, a, leaf in zip(self.feature, self.above, self.leaf):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (b[row, f[node]] > a[node])
            out += leaf[node - (len(leaf) - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 64, ridge: float = 1.0, least: int = 10) -> Trees:
    """Boosted trees for the logistic loss. With no row or one class the model is the constant base rate."""
    n = len(y)
    share = (y.sum() + 0.5) / (n + 1)
    base = float(np.log(share / (1 - share)))
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for k in range(x.shape[1])]
    model = Trees(cuts, np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth - 1), np.int64), np.zeros((0, 2**depth)), base)
    if n == 0 or y.min() == y.max():
        return model
    b = model.bins(x).astype(np.int64)
    k = x.shape[1]
    flat = b + np.arange(k) * bins
    margin = np.full(n, base)
    features, aboves, leaves = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        node = np.zeros(n, np.int64)
        feature, above = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, 255, np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (k * bins) + flat).ravel()
            hist = [np.bincount(key, np.repeat(v, k), width * k * bins).reshape(width, k, bins) for v in (g, h, np.ones(n))]
            gl, hl, nl = (np.cumsum(v, axis=2) for v in hist)
            gt, ht, nt = (v[:, :, -1:] for v in (gl, hl, nl))
            gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
            gain[(nl < least) | (nt - nl < least)] = 0
            best = gain.reshape(width, -1).argmax(axis=1)
            found = gain.reshape(width, -1)[np.arange(width), best] > 1e-9
            feature[first : first + width] = np.where(found, best // bins, 0)
            above[first : first + width] = np.where(found, best % bins, 255)
            node = 2 * node + 1 + (b[np.arange(n), feature[node]] > above[node])
        at = node - (2**depth - 1)
        value = -rate * np.bincount(at, g, 2**depth) / (np.bincount(at, h, 2**depth) + ridge)
        margin += value[at]
        features.append(feature)
        aboves.append(above)
        leaves.append(value)
    model.feature, model.above, model.leaf = np.array(features), np.array(aboves), np.array(leaves)
    return model


@dataclass
class Model:
    odds: np.ndarray
    quality: Trees
    toxic: Trees

    def score(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good quality), P(toxic), words) of each document."""
        x, words = statistics(text, self.odds)
        return self.quality.probability(x), self.toxic.probability(x), words


def _word_counts(batches):
    """(bucket, toxic and other documents that hold a word of the bucket) over a partition."""
    count = np.zeros((2, BUCKETS), np.int32)
    for batch in batches:
        raw, off, _ = tc.text_buffers(pc.utf8_lower(batch.column("text")))
        toxic = batch.column("toxic").to_numpy(zero_copy_only=False) > 0
        for i, j in tc.slices(off):
            w = tc.Words(raw, off[i : j + 1], "alnum")
            key = np.unique(w.doc_of() * BUCKETS + (w.hashes() >> np.uint64(46)).astype(np.int64))
            np.add.at(count, (toxic[i:j][key // BUCKETS].astype(int), key % BUCKETS), 1)
    some = np.flatnonzero(count.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[1, some].astype(np.int64)), pa.array(count[0, some].astype(np.int64))], names=["bucket", "toxic", "other"])


def _features(odds):
    def run(batches):
        for batch in batches:
            x, _ = statistics(batch.column("text"), odds.value)
            yield pa.RecordBatch.from_arrays([batch.column("quality"), batch.column("toxic"), pa.array([r.tobytes() for r in x], pa.binary())], names=["quality", "toxic", "x"])

    return run


def fit_model(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> Model:
    """Fit on at most ``most`` labelled rows: half of them for the words' log-odds, the other half for the trees.

    A label row without doc_id, quality or toxic is left out; of several for one doc_id the worst counts.
    """
    spark = docs.sparkSession
    tc.ship(spark)
    sample = (
        labels.select(tc.long_id().alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and quality is not null and toxic is not null")
        .groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    )
    texts = docs.select(tc.long_id().alias("doc_id"), "text").where("text is not null")
    sample = tc.table(texts.join(F.broadcast(sample), "doc_id"), "labelled")
    half = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2))
    lexicon = sample.where(half == 0).select("text", "toxic").mapInArrow(_word_counts, "bucket long, toxic long, other long")
    rows = lexicon.groupBy("bucket").agg(F.sum("toxic").alias("t"), F.sum("other").alias("o")).where(f"t + o >= {SUPPORT}").toPandas()
    totals = sample.where(half == 0).agg(F.count_if(F.col("toxic") > 0), F.count_if(F.col("toxic") <= 0)).first()
    odds = np.zeros(BUCKETS, np.float32)
    t, o = rows["t"].to_numpy(float), rows["o"].to_numpy(float)
    odds[rows["bucket"].to_numpy(int)] = np.log((t + 0.5) / (totals[0] + 1)) - np.log((o + 0.5) / (totals[1] + 1))
    shared = spark.sparkContext.broadcast(odds)
    got = sample.where(half == 1).select("quality", "toxic", "text").mapInArrow(_features(shared), "quality int, toxic int, x binary").toPandas()
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(len(got), len(NAMES))
    order = np.lexsort(x.T)  # rows come in no fixed order; the fit must not depend on it
    x = x[order]
    return Model(odds, fit(x, (got["quality"].to_numpy()[order] > 0).astype(float)), fit(x, (got["toxic"].to_numpy()[order] > 0).astype(float)))


def _scores(model):
    def run(batches):
        for batch in batches:
            text = batch.column("text")
            quality, toxic, words = model.value.score(text)
            none = words == 0
            keep = (quality >= 0.5) & (toxic < 0.5) & ~none
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(quality, mask=none), pa.array(toxic, mask=none), pa.array(keep)], names=["doc_id", "p_quality", "p_toxic", "keep"])

    return run


def quality_scores(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, p_quality, p_toxic, keep) of every row of docs; kept are those of good quality that aren't toxic.

    A document without any word (null, empty or only punctuation) has null probabilities and isn't kept. Rows
    are scored one by one: repeated rows, equal scores and null doc_ids stay as they are, and other columns
    aren't read. With no usable label both models are constants that keep nothing out for toxicity; with one
    class alone, that class is predicted.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, most))
    return docs.select(tc.long_id().alias("doc_id"), "text").mapInArrow(_scores(model), "doc_id long, p_quality double, p_toxic double, keep boolean")


def _keep(model, text_at: int):
    def run(batches):
        for batch in batches:
            quality, toxic, words = model.value.score(batch.column(text_at))
            yield batch.filter(pa.array((quality >= 0.5) & (toxic < 0.5) & (words > 0)))

    return run


def quality_stage(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """The rows of docs that quality_scores keeps, with all their columns."""
    model = docs.sparkSession.sparkContext.broadcast(fit_model(docs, labels, most))
    return docs.mapInArrow(_keep(model, docs.columns.index("text")), docs.schema)
