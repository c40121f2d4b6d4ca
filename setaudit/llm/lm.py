"""LM scoring: a small causal self-attention model over subword ids, trained on the corpus and applied to all of it."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.tokens import TOKENIZERS, batch_encoder, encoder

WINDOW, STRIDE = 32, 24  # tokens of a context window, and between windows when scoring: all but the first share 8 tokens
WIDTH, CLASSES, ROWS = 16, 64, 4096  # of vectors, output classes, embedding rows
SHARES = (1 / 16, 3 / 16, 3 / 4)  # of the windows, by rounds of training: each window has its round, chosen by hash, and is trained on in it
BATCH = 128  # windows of a step, or that are scored at once: their arrays stay in the cache
RATE = 0.03
BOS, PAD = 0, 1  # embedding rows

_TOKENS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


class Vocabulary:
    """Embedding row, class and probability within the class of every token id, from counts over the whole corpus.

    Classes are runs of the frequency order of about equal mass; frequent ids have embedding rows of their own and
    the rest share some.
    """

    def __init__(self, counts: np.ndarray):
        size = len(counts)
        order = np.argsort(-counts, kind="stable")
        mass = (counts[order] + 1.0) / (counts.sum() + size)
        before = np.cumsum(mass) - mass
        cls = np.minimum((before * CLASSES).astype(np.int64), CLASSES - 1)
        self.cls = np.empty(size, np.int16)
        self.cls[order] = cls
        total = np.bincount(cls, mass, CLASSES)
        self.log_in = np.empty(size, np.float32)
        self.log_in[order] = np.log(mass / total[cls])
        self.log_unigram = np.empty(size, np.float32)
        self.log_unigram[order] = np.log(mass)
        self.row = np.empty(size, np.int32)
        own = ROWS - 2 - 256
        self.row[order] = np.where(np.arange(size) < own, np.arange(size), own + order % 256) + 2


def initial(seed: int = 11) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    new = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    return {"emb": new(ROWS, WIDTH), "pos": new(WINDOW, WIDTH), "q": new(WIDTH, WIDTH), "k": new(WIDTH, WIDTH), "v": new(WIDTH, WIDTH), "o": new(WIDTH, WIDTH), "out": new(WIDTH, CLASSES), "bias": np.zeros(CLASSES, np.float32)}


_MASK = np.where(np.arange(WINDOW)[:, None] >= np.arange(WINDOW)[None, :], 0, -1e9).astype(np.float32)


def _softmax(s: np.ndarray) -> np.ndarray:
    s -= s.max(axis=-1, keepdims=True)
    np.exp(s, out=s)
    s /= s.sum(axis=-1, keepdims=True)
    return s


def _exp_sums(s: np.ndarray, bias: np.ndarray | None = None) -> np.ndarray:
    """Turns s into its exponentials, and returns the sums over the last axis of those of s + bias, at most 20 each way. These are capped at e**60, so no sum overflows."""
    cap = 60 if bias is None else 60 - bias
    if s.max(initial=-np.inf) > np.min(cap):  # hardly ever, and the largest is found faster than the cap is applied
        np.minimum(s, cap, out=s)
    np.exp(s, out=s)
    each = np.ones(s.shape[-1], s.dtype) if bias is None else np.exp(bias)
    return (_flat(s) @ each + s.dtype.type(1e-30)).reshape(*s.shape[:-1], 1)


def _left(bias: np.ndarray, logits: np.ndarray) -> np.ndarray:
    """The bias, for the exponentials to be multiplied by; a large one is added to the logits instead, and none is left."""
    if np.abs(bias).max() <= 20:
        return bias
    logits += bias
    return np.zeros_like(bias)


def _flat(m: np.ndarray) -> np.ndarray:
    return m.reshape(-1, m.shape[-1])


def _products(w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Queries' matrix times keys', scaled, and values' times the output's: with one head as wide as the model neither keys nor values are needed."""
    return w["q"] @ w["k"].T * w["q"].dtype.type(1 / np.sqrt(WIDTH)), w["v"] @ w["o"]


def _forward(w: dict[str, np.ndarray], rows: np.ndarray, first: int):
    """What the backward pass needs, the logits of the next token's class but for their bias, for positions from ``first`` on, at the end."""
    x = w["emb"].take(rows, axis=0)
    x += w["pos"]
    own = np.ascontiguousarray(x[:, first:])
    qk, vo = _products(w)
    q = (_flat(own) @ qk).reshape(own.shape)
    a = q @ x.transpose(0, 2, 1)
    a += _MASK[first:]
    a /= _exp_sums(a)
    c = a @ x
    h = _flat(c) @ vo
    h += _flat(own)
    return x, q, a, c, h, h @ w["out"]


def class_log_probs(w: dict[str, np.ndarray], rows: np.ndarray, first: int = 0) -> np.ndarray:
    """(windows, WINDOW - first, classes) log-probabilities of the next token's class, for positions from ``first`` on."""
    logits = _forward(w, rows, first)[-1] + w["bias"]
    return (logits - np.log(_exp_sums(logits.copy()))).reshape(len(rows), -1, CLASSES)


def target_log_probs(w: dict[str, np.ndarray], rows: np.ndarray, target: np.ndarray, first: int = 0) -> np.ndarray:
    """The log-probabilities of one class a position; those of negative targets mean nothing."""
    logits = _forward(w, rows, first)[-1]
    cls = np.maximum(target.ravel(), 0)
    bias = _left(w["bias"], logits)
    at = logits.ravel().take(np.arange(0, logits.size, CLASSES) + cls) + bias[cls]
    return (np.minimum(at, 60) - np.log(_exp_sums(logits, bias)[:, 0])).reshape(target.shape)


def gradients(w: dict[str, np.ndarray], rows: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean loss, gradients) over the positions whose target class isn't negative."""
    loss, g, row, d = _backward(w, rows, target)
    g["emb"] = np.zeros_like(w["emb"])
    g["emb"][row] = d
    return loss, g


def _backward(w: dict[str, np.ndarray], rows: np.ndarray, target: np.ndarray):
    """(mean loss, gradients but for the embedding's, embedding rows met, their gradients).

    Factors of a position or of a class are applied to the narrow arrays and to the weights, not to all classes of all positions.
    """
    x, q, a, c, h, p = _forward(w, rows, 0)
    qk, vo = _products(w)
    target = target.ravel()
    some = np.flatnonzero(target >= 0)
    cls = target[some]
    n = max(1, len(some))
    bias = _left(w["bias"], p)
    total, of_bias = _exp_sums(p, bias), np.exp(bias)
    flat, at, own = p.reshape(-1), some * CLASSES + cls, total[some, 0]
    right = flat.take(at)
    loss = float(-np.log(right * of_bias[cls] / own).sum()) / n
    flat[at] = right - own / of_bias[cls]
    share = np.zeros_like(total)
    share[some, 0] = 1 / (own * own.dtype.type(n))
    g = {"out": (p.T @ (h * share)).T * of_bias, "bias": (share.T @ p)[0] * of_bias}
    dh = p @ (w["out"] * of_bias).T
    dh *= share
    of_vo = _flat(c).T @ dh
    g["v"], g["o"] = of_vo @ w["o"].T, w["v"].T @ of_vo
    dc = (dh @ vo.T).reshape(c.shape)
    ds = dc @ x.transpose(0, 2, 1)
    ds -= np.einsum("bij,bij->bi", dc, c)[:, :, None]  # the sum of a * ds over what is attended to
    ds *= a
    dq = _flat(ds @ x)
    of_qk = _flat(x).T @ dq * x.dtype.type(1 / np.sqrt(WIDTH))
    g["q"], g["k"] = of_qk @ w["k"], of_qk.T @ w["q"]
    dx = dq @ qk.T
    dx += dh
    dx += _flat(a.transpose(0, 2, 1) @ dc)
    dx += _flat(ds.transpose(0, 2, 1) @ q)
    g["pos"] = dx.reshape(x.shape).sum(axis=0)
    own = rows.ravel().astype(np.uint16)
    order = np.argsort(own, kind="stable")
    row = own[order]
    first = np.flatnonzero(np.diff(row.astype(np.int32), prepend=-1))
    return loss, g, row[first], np.add.reduceat(dx.take(order, axis=0), first, axis=0)


class Adam:
    """Adam whose embedding rows move only in the steps that meet them; the other weights become parts of one array."""

    def __init__(self, w: dict[str, np.ndarray], rate: float = RATE):
        self.w, self.rate, self.t = w, rate, 0
        self.small = [k for k in w if k != "emb"]
        self.flat = np.concatenate([w[k].ravel() for k in self.small])
        cuts = np.cumsum([w[k].size for k in self.small])[:-1]
        w.update((k, part.reshape(w[k].shape)) for k, part in zip(self.small, np.split(self.flat, cuts)))
        (self.flat_m, self.m), (self.flat_s, self.s) = ((np.zeros_like(self.flat), np.zeros_like(w["emb"])) for _ in range(2))

    def step(self, g: dict[str, np.ndarray], row: np.ndarray, d: np.ndarray) -> None:
        self.t += 1
        rate = float(self.rate * (1 - 0.99**self.t) ** 0.5 / (1 - 0.9**self.t))
        own = np.concatenate([g[k].ravel() for k in self.small])
        self.flat -= self._moved(self.flat_m, self.flat_s, own, rate)
        m, s = self.m.take(row, axis=0), self.s.take(row, axis=0)
        self.w["emb"][row] -= self._moved(m, s, d, rate)
        self.m[row], self.s[row] = m, s

    @staticmethod
    def _moved(m: np.ndarray, s: np.ndarray, g: np.ndarray, rate: float) -> np.ndarray:
        """By how much the weights go down; m and s are brought up to date."""
        m += 0.1 * (g - m)
        s += 0.01 * (g * g - s)
        return rate * m / (np.sqrt(s) + 1e-8)


def windows(n: np.ndarray, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(document, first position) of every window of documents with n tokens: each token is scored by one of them."""
    per = np.where(n > 0, 1 + -(-np.maximum(n - WINDOW, 0) // stride), 0)
    doc = np.repeat(np.arange(len(n)), per)
    return doc, (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)) * stride


def laid_out(ids: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, voc: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(input rows, index of the token each position predicts or -1) of some windows over concatenated documents."""
    begin = np.cumsum(n) - n
    index = (begin[doc] + start)[:, None] + np.arange(WINDOW)
    rows = voc.row.take(ids.take(index - 1, mode="clip"))
    rows[start == 0, 0] = BOS
    beyond = index >= (begin + n)[doc][:, None]
    if beyond.any():
        rows[beyond], index[beyond] = PAD, -1
    return rows, index


def score(w: dict[str, np.ndarray], voc: Vocabulary, ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Log-probability of each token of concatenated documents of n tokens."""
    out = np.zeros(len(ids), np.float32)
    cls = voc.cls[ids]
    doc, start = windows(n)
    for first, which in ((0, np.flatnonzero(start == 0)), (WINDOW - STRIDE, np.flatnonzero(start > 0))):
        for i in range(0, len(which), BATCH):
            part = which[i : i + BATCH]
            rows, index = laid_out(ids, n, doc[part], start[part], voc)
            index = index[:, first:]
            lp = target_log_probs(w, rows, cls.take(index, mode="clip"), first)
            some = index >= 0
            out[index[some]] = lp[some]
    out += voc.log_in[ids]
    return out


def _keep_freed() -> None:
    """Has the C library keep up to 128 MB of what arrays leave, where it would give the pages back and get them anew step by step; only with glibc."""
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError, TypeError):
        return
    mallopt(-3, 1 << 25)  # M_MMAP_THRESHOLD
    mallopt(-1, 1 << 27)  # M_TRIM_THRESHOLD


def _encode(folder: str):
    def run(batches):
        _keep_freed()
        enc = batch_encoder(folder)
        for batch in batches:
            raw, off, valid = tc.text_buffers(batch.column("text"))
            ids, n = enc.encode(raw, off)
            bounds = np.concatenate([[0], np.cumsum(2 * n)])
            for i, j in tc.slices(bounds, 1 << 30):  # a batch's offsets are 32 bits wide
                at = (bounds[i : j + 1] - bounds[i]).astype(np.int32)
                own = np.ascontiguousarray(ids[bounds[i] // 2 : bounds[j] // 2])
                mask = pa.py_buffer(np.packbits(valid[i:j], bitorder="little").tobytes())
                cells = pa.Array.from_buffers(pa.binary(), j - i, [mask, pa.py_buffer(at.tobytes()), pa.py_buffer(own.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), cells], schema=_TOKENS)

    return run


def _ids(batch) -> tuple[np.ndarray, np.ndarray]:
    """(ids one after the other, ids of each row) from the column's own buffers; a null has none."""
    col = batch.column("ids").cast(pa.large_binary())
    _, off, data = col.buffers()
    bounds = np.frombuffer(off, np.int64, len(col) + 1, col.offset * 8) if len(col) else np.zeros(1, np.int64)
    flat = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return np.frombuffer(flat.tobytes(), "<u2"), np.diff(bounds) // 2


def _count(size: int):
    def run(batches):
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_ids(batch)[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["token", "n"])

    return run


def rounds_of(ids: np.ndarray, n: np.ndarray, doc: np.ndarray, start: np.ndarray, shares: tuple[float, ...]) -> np.ndarray:
    """The round that each window is trained on in, by a hash of some of its tokens and its place: however rows are partitioned, each has one."""
    begin = (np.cumsum(n) - n)[doc]
    at = lambda k: ids[begin + np.minimum(start + k, n[doc] - 1)].astype(np.uint64)
    with np.errstate(over="ignore"):
        head = (((at(0) << np.uint64(16)) | at(5)) << np.uint64(16) | at(17)) * np.uint64(0x9E3779B97F4A7C15)
        h = tc.mix(head + n[doc].astype(np.uint64) * np.uint64(7919) + start.astype(np.uint64) * np.uint64(31))
    return np.searchsorted(np.cumsum(shares)[:-1], (h >> np.uint64(11)) / float(1 << 53), "right")


def _train(shared, turn: int, shares: tuple[float, ...]):
    def run(batches):
        _keep_freed()
        w0, voc = shared.value
        w = {k: v.copy() for k, v in w0.items()}
        adam, held_r, held_t, held, seen = Adam(w), [], [], 0, 0

        def steps():
            nonlocal held_r, held_t, held, seen
            rows, target = np.concatenate(held_r), np.concatenate(held_t)
            for i in range(0, len(rows), BATCH):
                adam.step(*_backward(w, rows[i : i + BATCH], target[i : i + BATCH])[1:])
            seen += len(rows)
            held_r, held_t, held = [], [], 0

        for batch in batches:
            ids, n = _ids(batch)
            doc, start = windows(n, WINDOW)  # side by side: each token is predicted once
            if not len(doc):
                continue
            own = np.flatnonzero(rounds_of(ids, n, doc, start, shares) == turn)
            for i in range(0, len(own), 16 * BATCH):
                part = own[i : i + 16 * BATCH]
                rows, index = laid_out(ids, n, doc[part], start[part], voc)
                held_r.append(rows)
                held_t.append(np.where(index >= 0, voc.cls.take(ids.take(index, mode="clip")), -1))
                held += len(part)
                if held >= 16 * BATCH:
                    steps()
        if held:
            steps()
        if seen:
            flat = np.concatenate([w[k].ravel() for k in w0])
            yield pa.RecordBatch.from_arrays([pa.array(range(8), pa.int32()), pa.array([seen] * 8, pa.int64()), pa.array([c.tobytes() for c in np.array_split(flat, 8)], pa.binary())], names=["part", "n", "w"])

    return run


def _average(t: pa.Table) -> pa.Table:
    got = sorted(zip(t.column("w").to_pylist(), t.column("n").to_pylist()))
    total = sum(n for _, n in got)
    mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (n / total) for w, n in got).astype(np.float32)
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "w": pa.array([mean.tobytes()], pa.binary())})


def train(tokens: DataFrame, size: int, shares: tuple[float, ...] = SHARES) -> tuple[dict[str, np.ndarray], Vocabulary]:
    """(weights, vocabulary) from every window of tokens(ids): each round trains on its share of them, from the averaged weights of the one before."""
    spark = tokens.sparkSession
    counts = np.zeros(size, np.int64)
    got = tokens.select("ids").mapInArrow(_count(size), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toPandas()  # a row for each id of the vocabulary at most
    counts[got["token"].to_numpy(int)] = got["n"].to_numpy(int)
    voc, w = Vocabulary(counts), initial()
    for k in range(len(shares)):
        shared = spark.sparkContext.broadcast((w, voc))
        mean = tokens.select("ids").mapInArrow(_train(shared, k, shares), "part int, n long, w binary").groupBy("part").applyInArrow(_average, "part int, w binary").toPandas()
        if not len(mean):
            continue
        flat = np.frombuffer(b"".join(mean.sort_values("part")["w"]), np.float32)
        cuts = np.cumsum([v.size for v in w.values()])[:-1]
        w = {name: part.reshape(old.shape).copy() for (name, old), part in zip(w.items(), np.split(flat, cuts))}
    return w, voc


def _score(shared):
    def run(batches):
        _keep_freed()
        w, voc = shared.value
        for batch in batches:
            ids, n = _ids(batch)
            bounds = np.concatenate([[0], np.cumsum(n)])
            lp, flat = np.zeros(len(n)), np.zeros(len(n))
            for i, j in tc.slices(bounds, 1 << 17):
                part = ids[bounds[i] : bounds[j]]
                cut = bounds[i : j + 1] - bounds[i]
                lp[i:j] = tc.segment_sums(score(w, voc, part, n[i:j]).astype(np.float64), cut)
                flat[i:j] = tc.segment_sums(voc.log_unigram[part].astype(np.float64), cut)
            none = n == 0
            least = np.maximum(n, 1)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(lp), pa.array(-lp / least, mask=none), pa.array(-flat / least, mask=none)], names=["doc_id", "tokens", "log_prob", "nll", "unigram_nll"])

    return run


def lm_scores(docs: DataFrame, tokenizers: str = TOKENIZERS, shares: tuple[float, ...] = SHARES) -> DataFrame:
    """(doc_id, tokens, log_prob, nll, unigram_nll) of every row of docs.

    Texts are encoded once with a public byte-pair vocabulary. Token counts over all documents give the output
    classes; a one-layer causal self-attention model predicts the next token's class, and a token's probability is
    its class's times its share of the class. The model is trained in numpy on every window of all documents, each window once,
    in rounds of local Adam by partition whose weights are averaged. Scoring covers each document with overlapping windows,
    batched, and takes each token's log-probability (natural) from one window, in which it has at least 8 tokens
    before it or all there are. nll is the mean per token, unigram_nll that of the counts alone.

    Since each partition trains on its own rows, the weights follow from how the table is partitioned: the mean nll of a
    corpus differs between partitionings, most where they leave each partition little to train on (5.26 and 4.94 for a thousand documents
    in eight parts and in one; the tests hold it to 8 %), and equal partitions give equal scores.

    Null and empty texts have 0 tokens, log_prob 0 and null means. Every row is scored by itself: repeated rows and
    null doc_ids stay, very long texts are read in full, an empty table gives no rows, and other columns aren't read.
    """
    spark = docs.sparkSession
    tc.ship(spark)
    size = encoder(tokenizers).size
    tokens = tc.table(docs.select(tc.long_id().alias("doc_id"), "text").mapInArrow(_encode(tokenizers), "doc_id long, ids binary"), "tokens")
    shared = spark.sparkContext.broadcast(train(tokens, size, shares))
    return tokens.mapInArrow(_score(shared), "doc_id long, tokens long, log_prob double, nll double, unigram_nll double")
