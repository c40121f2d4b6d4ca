"""The language model's training reads every window of every document, once."""

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from setaudit.llm import lm
from setaudit.llm import textcore as tc
from setaudit.llm.tokens import BatchEncoder, encoder


def test_every_window_is_trained_on_once():
    rng = np.random.default_rng(2)
    n = np.array([0, 1, 31, 63, 64, 65, 400, 400, 50_000])
    ids = [rng.integers(0, 500, k).astype("<u2") for k in n]
    ids[7] = ids[6]  # copies count each
    batch = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary())], names=["ids"])
    doc, start = lm.windows(n, lm.WINDOW)
    covered = np.zeros(n.sum(), int)
    for d, s in zip(doc, start):
        covered[n[:d].sum() + s : n[:d].sum() + min(n[d], s + lm.WINDOW)] += 1
    assert (covered == 1).all()
    seen = 0
    for turn in range(len(lm.SHARES)):
        shared = SimpleNamespace(value=(lm.initial(), lm.Vocabulary(np.arange(500))))
        (got,) = lm._train(shared, turn, lm.SHARES)([batch])
        assert len(set(got.column("n").to_pylist())) == 1
        seen += got.column("n")[0].as_py()
    assert sum(lm.SHARES) == 1 and seen == len(doc)


def test_gradients_by_differences():
    rng = np.random.default_rng(3)
    w = {name: v.astype(np.float64) for name, v in lm.initial().items()}
    rows, target = rng.integers(2, 60, (3, lm.WINDOW)), rng.integers(-1, lm.CLASSES, (3, lm.WINDOW))
    _, g = lm.gradients(w, rows, target)
    for name in w:
        i = (int(rows[0, 3]), 2) if name == "emb" else (5,) if name == "bias" else (1, 2)
        old, h = w[name][i], 1e-5
        w[name][i] = old + h
        up = lm.gradients(w, rows, target)[0]
        w[name][i] = old - h
        down = lm.gradients(w, rows, target)[0]
        w[name][i] = old
        assert abs((up - down) / (2 * h) - g[name][i]) < 1e-6, name


def test_loss_by_the_definition():
    """Attention and softmax written out position by position."""
    rng = np.random.default_rng(4)
    w = {name: v.astype(np.float64) * 3 for name, v in lm.initial().items()}
    rows = rng.integers(0, 90, (2, lm.WINDOW))
    got = lm.class_log_probs(w, rows)
    for b, t in ((0, 0), (0, 1), (1, 17), (1, lm.WINDOW - 1)):
        x = w["emb"][rows[b]] + w["pos"]
        e = np.exp([x[t] @ w["q"] @ (x[u] @ w["k"]) / np.sqrt(lm.WIDTH) for u in range(t + 1)])
        h = x[t] + (e / e.sum()) @ (x[: t + 1] @ w["v"]) @ w["o"]
        z = h @ w["out"] + w["bias"]
        assert np.allclose(got[b, t], z - np.log(np.exp(z).sum()))
    assert np.allclose(lm.class_log_probs(w, rows, 20), got[:, 20:])


def test_batches_are_encoded_like_texts():
    enc, rng = encoder(), np.random.default_rng(5)
    pool = [" ", "  ", "a", " the", "\n", "\n\n", "'s", "12", "é", "漢字", "，", "\u3000", "\u00a0", "\u2003", "\x1c", " \t", "don't", "\U0001f600", ""]
    texts = ["", None, " ", "plain words here", *("".join(rng.choice(pool, rng.integers(0, 80))) for _ in range(400)), "x" * 5000, " y" * 300_000]
    raw, off, _ = tc.text_buffers(pa.array(texts))
    batch = BatchEncoder(enc)
    for _ in range(2):  # from an empty and from a filled cache
        ids, n = batch.encode(raw, off)
        want = [np.array(enc.encoding.encode_ordinary(t or ""), "<u2") for t in texts]
        assert n.tolist() == list(map(len, want)) and (ids == np.concatenate(want)).all()


def test_words_are_encoded_once_in_a_process(monkeypatch):
    """In one call for each slice of text, and not again by the next task."""
    enc, calls = encoder(), []
    whole = enc.encoding.encode_ordinary
    counted = SimpleNamespace(encode_ordinary=lambda text: calls.append(text) or whole(text))
    monkeypatch.setattr(enc, "encoding", counted)
    texts = [f"zq{k} of zq{k + 1}, it's\n zq{k}x" for k in range(300)] + ["", None, " ", "'s", "\n", "漢字 x"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    for most in (20, 0):
        (got,) = lm._encode("/opt/tokenizers")([batch])
        assert len(calls) <= most, calls
        assert got.column("ids").to_pylist() == [None if t is None else np.array(whole(t), "<u2").tobytes() for t in texts]
        calls.clear()


def test_words_come_back_when_few_are_held(monkeypatch):
    monkeypatch.setattr("setaudit.llm.tokens.MOST_CACHED", 7)
    enc, rng = encoder(), np.random.default_rng(6)
    batch = BatchEncoder(enc)
    for _ in range(20):
        texts = [" ".join(f"w{k}" for k in rng.integers(0, 30, 12)) for _ in range(3)]
        raw, off, _ = tc.text_buffers(pa.array(texts))
        ids, n = batch.encode(raw, off)
        want = [np.array(enc.encoding.encode_ordinary(t), "<u2") for t in texts]
        assert n.tolist() == list(map(len, want)) and (ids == np.concatenate(want)).all()
        assert len(batch.known) <= 7 and len(batch.older) <= 7


@pytest.mark.parametrize("bias", [0, 5, 35])
def test_gradients_and_scores_with_biases(bias):
    """A bias is applied to the exponentials, a large one to the logits: both as in the plain form, by differences."""
    rng = np.random.default_rng(8)
    w = {name: v.astype(np.float64) * 3 for name, v in lm.initial().items()}
    w["bias"] = rng.uniform(-1, 1, lm.CLASSES) * bias
    rows, target = rng.integers(2, 60, (3, lm.WINDOW)), rng.integers(0, lm.CLASSES, (3, lm.WINDOW))
    plain = lambda: np.take_along_axis(lm.class_log_probs(w, rows), target[:, :, None], 2)[:, :, 0]
    loss, g = lm.gradients(w, rows, target)
    assert np.allclose(lm.target_log_probs(w, rows, target), plain()) and np.isclose(loss, -plain().mean())
    for name in w:
        for i in [(int(rows[0, 3]), 2)] if name == "emb" else [(5,), (60,)] if name == "bias" else [(1, 2), (7, 11)]:
            old, h = w[name][i], 1e-5
            w[name][i] = old + h
            up = -plain().mean()
            w[name][i] = old - h
            down = -plain().mean()
            w[name][i] = old
            assert abs((up - down) / (2 * h) - g[name][i]) < 1e-6, name


@pytest.fixture(scope="module")
def scored(spark):
    docs = tc.read(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    return docs, {k: lm.lm_scores(docs.repartition(k, "doc_id")).toPandas().sort_values("doc_id", ignore_index=True) for k in (1, 8)}


def test_scores_hardly_depend_on_the_partitioning(scored):
    _, by = scored
    mean = {k: (t["nll"] * t["tokens"]).sum() / t["tokens"].sum() for k, t in by.items()}
    flat = (by[1]["unigram_nll"] * by[1]["tokens"]).sum() / by[1]["tokens"].sum()
    assert (by[1]["tokens"] == by[8]["tokens"]).all() and abs(mean[1] / mean[8] - 1) < 0.08
    assert max(mean.values()) < flat - 0.3, (mean, flat)


def test_log_prob_of_the_query_from_its_weights(spark):
    """One partition trains in a fixed order, so its weights can be had again: tokens are then scored one at a time."""
    docs = tc.read(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text").coalesce(1)
    got = {r.doc_id: r for r in lm.lm_scores(docs).collect()}
    enc = encoder()
    tokens = docs.select("doc_id", "text").mapInArrow(lm._encode("/opt/tokenizers"), "doc_id long, ids binary")
    w, voc = lm.train(tokens, enc.size)
    for r in docs.where("length(text) > 600").limit(3).collect():
        ids = np.array(enc.encoding.encode_ordinary(r.text))
        total = 0.0
        for t in range(len(ids)):
            k = 0 if t < lm.WINDOW else 1 + (t - lm.WINDOW) // lm.STRIDE
            a = k * lm.STRIDE
            rows = np.full(lm.WINDOW, lm.PAD)
            before = [lm.BOS if u == 0 else voc.row[ids[u - 1]] for u in range(a, t + 1)]
            rows[: len(before)] = before
            total += lm.class_log_probs(w, rows[None])[0, t - a, voc.cls[ids[t]]] + voc.log_in[ids[t]]
        assert np.isclose(total, got[r.doc_id].log_prob, rtol=1e-4) and got[r.doc_id].tokens == len(ids)
