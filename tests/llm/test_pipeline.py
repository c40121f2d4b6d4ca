"""The pipeline's stages against plain Python over their own inputs, and over odd tables."""

import numpy as np
import pytest

import corpus_pipeline
from setaudit.llm import decontaminate, mixing, quality, queries, simhash, substring
from setaudit.llm import textcore as tc

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def groups(signatures, radius):
    """The component of each signature, by comparing all pairs one at a time."""
    mask, root = (1 << 64) - 1, list(range(len(signatures)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(signatures):
        for j in range(i):
            if sum(((p ^ q) & mask).bit_count() for p, q in zip(a, signatures[j])) <= radius:
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(signatures))]


def without_repeats(rows, least):
    """(doc_id, text) with each passage that a smaller doc_id holds taken out, word by word."""
    first = {}
    for d, text in rows:
        w = text.split()
        for i in range(len(w) - least + 1):
            key = tuple(w[i : i + least])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, text in rows:
        w, cut = text.split(), set()
        for i in range(len(w) - least + 1):
            if first[tuple(w[i : i + least])] < d:
                cut.update(range(i, i + least))
        left = [x for k, x in enumerate(w) if k not in cut]
        if left or not w:
            out.append((d, left))
    return out


def edits_to(item, text):
    row = np.zeros(len(text) + 1, int)
    chars = np.array([ord(c) for c in text])
    for i, a in enumerate(item, 1):
        new = np.minimum(row[1:] + 1, row[:-1] + (chars != ord(a)))
        line = np.concatenate([[i], new])
        row = np.minimum.accumulate(line - np.arange(len(line))) + np.arange(len(line))
    return int(row.min())


def test_stages_against_brute_force(spark):
    docs = tc.read(spark, SF, "documents")
    start = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        before, after = docs.toPandas().set_index("doc_id"), out.toPandas().set_index("doc_id")
        if name == "quality":
            model = quality.fit_model(docs, tc.read(spark, SF, "labels"))
            import pyarrow as pa

            good, toxic, words = model.score(pa.array(before["text"]))
            assert set(after.index) == set(before.index[(good >= 0.5) & (toxic < 0.5) & (words > 0)])
        if name == "near_duplicates":
            sig = {r.doc_id: (r.s0, r.s1) for r in simhash.signatures(docs).collect() if r.s0 is not None}
            ids = sorted(sig)
            root = groups([sig[i] for i in ids], simhash.RADIUS)
            gone = {d for k, d in enumerate(ids) if root[k] != k}
            assert set(after.index) == set(before.index) - gone and gone
        if name == "repeats":
            want = {d: w for d, w in without_repeats(list(before["text"].items()), substring.LEAST_WORDS)}
            assert {d: t.split() for d, t in after["text"].items()} == want
        if name == "benchmark":
            import pyarrow as pa

            items = [i for i in decontaminate.normalised(pa.array([r.text for r in tc.read(spark, SF, "benchmark").collect()])) if i]
            texts = dict(zip(before.index, decontaminate.normalised(pa.array(before["text"]))))
            gone = {d for d, t in texts.items() if any(i in t or edits_to(i, t) <= int(len(i) * decontaminate.ERROR_RATE) for i in items if len(i) <= 1.1 * len(t) + 1)}
            assert set(after.index) == set(before.index) - gone
        if name != "mix":
            assert out.columns == start
            docs = tc.table(out, "test")
        else:
            assert set(after.index) == set(before.index) and (after["rate"] >= 0).all()


EXTRA = ["__hits", "__text", "__id", "__th", "__nth", "__row", "th", "s0", "s1", "lead", "size", "group_id", "kept", "rep", "root", "node"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in EXTRA)
PASSAGE = " ".join(f"shared{i}" for i in range(60))
A, B = "the first story tells about seven rivers crossing green valleys", "quite another report lists broken engines waiting outside"
LONG = " ".join(f"word{i % 997}x{i // 997}" for i in range(40_000))


def table(spark, rows):
    return spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), *(f"{c}{k}" for c in EXTRA)) for k, (d, t) in enumerate(rows)], SCHEMA)


ODD = [(None, None), (None, A), (1, None), (2, ""), (3, " \n"), (4, "!!!"), (5, A), (6, A), (6, A), (7, LONG), (8, B), (None, LONG)]


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES if n != "mix"])
def test_odd_rows(spark, name):
    docs = table(spark, ODD)
    got = STAGES[name](spark, docs, SF)
    assert got.columns == docs.columns
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.text or "") for r in got.collect())
    key = lambda kept: sorted((ODD[k][0] if ODD[k][0] is not None else -1, ODD[k][1] or "") for k in kept)
    if name == "quality":
        assert all(t.strip(" \n!") for _, t in rows) and set(rows) <= set(key(range(len(ODD))))
    elif name == "near_duplicates":
        assert rows == key([0, 1, 2, 3, 4, 5, 6, 9, 10, 11])
    else:
        assert rows == key(range(len(ODD)))
    for r in got.collect():  # values travel with their rows
        k = int(r["__row"][len("__row") :])
        assert (r.doc_id, r.text) == ODD[k] and all(r[c] == f"{c}{k}" for c in EXTRA)
    none = STAGES[name](spark, docs.limit(0), SF)
    assert none.columns == docs.columns and none.count() == 0


def test_doc_ids_with_several_texts(spark):
    rows = [(3, B), (5, A), (5, B), (7, A), (8, "x " + PASSAGE), (9, PASSAGE + " y"), (9, "z words of another kind"), (9, "z words of another kind")]
    docs = table(spark, rows)
    left = sorted((r.doc_id, r.text) for r in STAGES["near_duplicates"](spark, docs, SF).collect())
    assert left == [(3, B), (5, A), (8, "x " + PASSAGE), (9, "z words of another kind")]
    cut = sorted((r.doc_id, r.text, r.n_chars) for r in STAGES["repeats"](spark, docs, SF).collect() if r.doc_id in (8, 9))
    assert cut == [(8, "x " + PASSAGE, len(PASSAGE) + 2), (9, "y", 1), (9, "z words of another kind", 23), (9, "z words of another kind", 23)]


def test_mix_of_odd_rows(spark):
    got = STAGES["mix"](spark, table(spark, ODD), SF).collect()
    assert len(got) == len(ODD) and all(r.rate >= 0 for r in got)
    assert all(r.rate == 1 for r in got if not r.tokens) and sum(not r.tokens for r in got) == 5
    assert STAGES["mix"](spark, table(spark, ODD).limit(0), SF).count() == 0


def test_rates_solve_the_least_squares(spark):
    """Against plain projected gradient over the same posteriors, with targets that can be met and with some that can't."""
    docs, labels = tc.read(spark, "/root/testdata/sf0.01", "documents"), tc.read(spark, "/root/testdata/sf0.01", "labels")
    for targets in (None, {"q1t0": 0.5, "q1t1": 0.4, "q0t0": 0.05, "q0t1": 0.05}):
        got = mixing.mixing_rates(docs, docs, labels, targets).toPandas()
        p, n = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), got["tokens"].to_numpy(float)
        goal = np.array([(targets or mixing.TARGETS)[d] for d in mixing.DOMAINS])
        a = p * (n / n.sum())[:, None]
        loss = lambda r: ((r @ a - goal) ** 2).sum()
        r, step = np.ones(len(p)), 1 / np.linalg.norm(a, 2) ** 2
        for _ in range(20_000):
            r = np.maximum(0, r - step * a @ (r @ a - goal))
        assert (got["rate"] >= 0).all() and loss(got["rate"].to_numpy()) <= loss(r) + 1e-8, (targets, loss(got["rate"].to_numpy()), loss(r))


def test_rates_of_kept_documents_dont_diverge(spark):
    """What the quality stage keeps hardly reaches the targets: the loss still falls, to that of many plain gradient steps or lower."""
    docs, labels = tc.read(spark, "/root/testdata/sf0.1", "documents"), tc.read(spark, "/root/testdata/sf0.1", "labels")
    got = mixing.mixing_rates(quality.quality_stage(docs, labels), docs, labels).toPandas()
    p, n = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy(), got["tokens"].to_numpy(float)
    a, goal = p * (n / n.sum())[:, None], np.array([mixing.TARGETS[d] for d in mixing.DOMAINS])
    loss = lambda r: ((r @ a - goal) ** 2).sum()
    r, steepest = np.ones(len(p)), np.linalg.eigvalsh(a.T @ p)[-1]
    for _ in range(1000):
        r = np.maximum(0, r - p @ (r @ a - goal) / steepest)
    assert (got["rate"] >= 0).all() and loss(got["rate"].to_numpy()) <= loss(r) < loss(np.ones(len(p))), (loss(got["rate"].to_numpy()), loss(r))


def test_names():
    assert len(corpus_pipeline.STAGES) == 5 and set(queries.ORACLES) <= set(queries.QUERIES)
    assert sum(n.startswith("op") for n in queries.QUERIES) == 10
