"""Operators against brute force, exact round trips and held-out accuracy."""

import random
import string

import numpy as np
import pyarrow as pa
import pytest

from setaudit.llm import chat, decontaminate, edits, embeddings, licenses, lm, mixing, quality, simhash, substring
from setaudit.llm import textcore as tc
from setaudit.llm.tokens import encoder

SF = "/root/testdata/sf0.001"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus():
    """Random documents with shared passages of 40 to 90 words."""
    rng = random.Random(5)
    shared = [words(rng, rng.randint(40, 90), 10**6) for _ in range(12)]
    out = []
    for i in range(80):
        w = words(rng, rng.randint(0, 150), 10**6)
        for p in rng.sample(shared, rng.randint(0, 2)):
            at = rng.randint(0, len(w))
            w[at:at] = p[: rng.randint(30, len(p))]
        out.append((i // 2 if i < 6 else i, " ".join(w)))
    return out


@pytest.mark.parametrize("most", [substring.MOST_PIECES, 3, 0])  # with 0 all grams are hot ones
@pytest.mark.parametrize("earlier", [False, True])
def test_substring(spark, corpus, earlier, most):
    least, held, spans = 50, {}, []
    for d, t in corpus:
        w = t.split()
        for i in range(len(w) - least + 1):
            held.setdefault(tuple(w[i : i + least]), set()).add(d)
    for d, t in corpus:
        w = t.split()
        spans += [(d, i, i + least) for i in range(len(w) - least + 1) if (min(held[tuple(w[i : i + least])]) < d if earlier else len(held[tuple(w[i : i + least])]) > 1)]
    want = set(zip(*(x.tolist() for x in substring.merged(*(np.array(c, np.int64) for c in zip(*spans))))))
    got = {tuple(r) for r in substring.repeated_passages(spark.createDataFrame(corpus, "doc_id long, text string"), earlier=earlier, most=most).collect()}
    assert want and got == want


def test_shard_in_several_blocks(spark):
    rng = random.Random(1)
    base = [rng.randrange(50) for _ in range(300)]
    piece = [(d, base[s : s + rng.randint(20, 80)]) for d in range(30) for s in [rng.randrange(220)]]
    args = np.array([d for d, _ in piece]), np.zeros(len(piece), np.int64), [np.array(w, np.uint32).tobytes() for _, w in piece]
    one = substring.shard_hits(*args, 12, False)
    many = substring.shard_hits(*args, 12, False, block=4)
    assert len(one[0]) and all((a == b).all() for a, b in zip(one, many))


def distance(item, text):
    """Least edit distance of the item to any substring, by the plain matrix."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_decontamination(spark):
    rng = random.Random(2)
    items = [(i, " ".join("".join(rng.choices(string.ascii_lowercase, k=rng.randint(2, 9))) for _ in range(rng.randint(3, 12)))) for i in range(12)]
    docs = []
    for d in range(40):
        text = list(" ".join(words(rng, 12)))
        if d % 2:
            item = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 5)):
                k = rng.randrange(len(item))
                item[k : k + rng.randint(0, 1)] = rng.choice(["", "q", "zz"])
            text += [" "] + item
        docs.append((d, "".join(text)))
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 0.08)
    got = {(r.doc_id, r.item_id): r.distance for r in found.collect()}
    want = {}
    for (d, text), (i, item) in ((x, y) for x in docs for y in items):
        a, b = decontaminate.normalised(pa.array([item, text]))
        if (k := distance(a, b)) <= int(len(a) * 0.08):
            want[d, i] = k
    assert any(want.values()) and got == want


def test_short_items_match_whole_words(spark):
    items = spark.createDataFrame([(1, "Cat!"), (2, "漢字"), (3, "--"), (4, "a b")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "cat"), (2, "the CAT, sat"), (3, "concatenate"), (4, "x 漢字 y"), (5, "漢字x"), (6, "A-b"), (7, "aa b")], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance, r.end) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, 1, 0, 3), (2, 1, 0, 7), (4, 2, 0, 4), (6, 4, 0, 3)}
    assert {r.doc_id for r in decontaminate.without_contaminated(docs, items).collect()} == {3, 5, 7}


def test_best_match_of_several(spark):
    item = "abcdefghij klmnopqrst uvwxyz0123 456789"
    text = "x " * 20 + item.replace("m", "") + " y " * 30 + item + " z " + item
    (row,) = decontaminate.contaminated(spark.createDataFrame([(1, text)], "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    plain = decontaminate.normalised(pa.array([text]))[0]
    assert (row.distance, row.end) == (0, plain.index(item) + len(item))
    assert decontaminate.united([(5, 9), (0, 3), (8, 12), (3, 4)]) == [(0, 4), (5, 12)]


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 32))
    x[300:] = x[:300] + rng.standard_normal((300, 32)) * 0.5
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.85) & ~np.eye(len(u), dtype=bool)
    got = {r.vec_id: (r.class_id, r.links) for r in embeddings.embedding_classes(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    links = np.array([got[i][1] for i in range(600)])
    assert (links <= near.sum(axis=1)).all() and links.sum() >= 0.9 * near.sum() > 100
    from setaudit.llm.graph import forest

    root = forest(600, *np.nonzero(near))
    same = [got[i][0] == root[i] for i in range(600)]
    assert np.mean(same) >= 0.9 and all(root[got[i][0]] == root[i] for i in range(600))


def test_embedding_recall_of_the_full_tables(spark):
    """Against brute force, in blocks, over the largest test table at a threshold that it has pairs for."""
    table = tc.read(spark, "/root/testdata/sf0.1", "embeddings")
    x = np.array(table.orderBy("vec_id").toPandas()["embedding"].tolist())
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sum(int((u[i : i + 500] @ u.T >= 0.45).sum()) for i in range(0, len(u), 500)) - len(u)
    got = embeddings.embedding_classes(table, threshold=0.45).agg({"links": "sum"}).first()[0]
    assert 0.9 * want <= got <= want and want > 100


def test_lm_scores_each_token_once_and_causally():
    n = np.array([0, 1, 63, 64, 65, 104, 105, 400])
    voc, w, rng = lm.Vocabulary(np.arange(500)), lm.initial(), np.random.default_rng(0)
    ids = rng.integers(0, 500, n.sum()).astype(np.uint16)
    seen = np.zeros(n.sum(), int)
    doc, start = lm.windows(n)
    for d, s in zip(doc, start):
        first = 0 if s == 0 else lm.WINDOW - lm.STRIDE
        _, index = lm.laid_out(ids, n, np.array([d]), np.array([s]), voc)
        np.add.at(seen, index[0, first:][index[0, first:] >= 0], 1)
    assert (seen == 1).all()
    full = lm.score(w, voc, ids, n)
    changed = ids.copy()
    changed[-1] = (changed[-1] + 1) % 500
    assert np.allclose(full[:-1], lm.score(w, voc, changed, n)[:-1])
    # against one window at a time, position by position
    at = int(n[:-1].sum())
    own = ids[at : at + lm.WINDOW]
    rows = np.array([[lm.BOS, *voc.row[own[:-1]]]])
    plain = lm.class_log_probs(w, rows)[0]
    assert np.allclose(full[at : at + lm.WINDOW], plain[np.arange(lm.WINDOW), voc.cls[own]] + voc.log_in[own], atol=1e-4)


def test_lm_beats_unigrams(spark):
    got = lm.lm_scores(tc.read(spark, "/root/testdata/sf0.01", "documents")).where("tokens > 0").toPandas()
    assert (got["nll"] * got["tokens"]).sum() < (got["unigram_nll"] * got["tokens"]).sum()
    assert (got["nll"] < got["unigram_nll"]).mean() > 0.85 and np.allclose(got["log_prob"], -got["nll"] * got["tokens"])


def test_simhash(spark):
    docs = tc.read(spark, SF, "documents")
    rows = {r.doc_id: (r.s0, r.s1) for r in simhash.signatures(docs).collect() if r.s0 is not None}
    ids = sorted(rows)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    mask = (1 << 64) - 1
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if sum(((p ^ q) & mask).bit_count() for p, q in zip(rows[a], rows[b])) <= simhash.RADIUS:
                p, q = sorted((top(a), top(b)))
                root[q] = p
    size = {}
    for i in ids:
        size[top(i)] = size.get(top(i), 0) + 1
    want = {(i, top(i)) for i in ids if size[top(i)] > 1}
    assert {(r.doc_id, r.group_id) for r in simhash.simhash_groups(docs).collect()} == want


def test_signature_by_the_definition():
    """128 majority votes over the bits of the features' hashes, worked out word by word."""
    texts = ["One common WORD, one word; of 12 things", "a b c", "!!", "same same words words again", ""]
    sig, some = simhash.signatures_of(*tc.text_buffers(pa.array([t.lower() for t in texts]))[:2])
    assert some.tolist() == [True, True, False, True, False]
    for text, got in zip(texts, sig):
        found = {}
        for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
            h = tc.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w)]), "alnum").hashes()[0]
            found[int(h) >> 20] = len(w) >= simhash.LEAST_BYTES or any(c.isdigit() for c in w)
        used = [h for h, good in found.items() if good] or list(found)
        votes = np.zeros(128, int)
        for h in used:
            one = tc.mix(np.array([h], np.uint64))
            two = tc.mix(one ^ np.uint64(0x5851F42D4C957F2D))
            votes += np.unpackbits(np.concatenate([one, two]).view(np.uint8)).astype(int)
        assert (np.unpackbits(got.view(np.uint8)) == (2 * votes > len(used))).all()


def test_numbers_tell_templates_apart():
    rng = random.Random(8)
    form = "order {} of {} units at {} for customer {} by carrier {} weight {} volume {} code {}"
    texts = [form.format(*[rng.randrange(100, 1000) for _ in range(8)]) for _ in range(40)]
    sig, _ = simhash.signatures_of(*tc.text_buffers(pa.array(texts))[:2])
    apart = [sum(int(np.bitwise_count(x ^ y)) for x, y in zip(a, b)) for k, a in enumerate(sig) for b in sig[:k]]
    assert np.mean(np.array(apart) > simhash.RADIUS) > 0.95


@pytest.mark.parametrize("radius", [0, 3, 4, 7, 12, 24])
def test_simhash_blocks_leave_no_close_pair_out(radius):
    rng = np.random.default_rng(radius)
    sig = rng.integers(0, 2**63, (1500, 2)).astype(np.uint64)
    for i in range(700, 1500):  # near copies, up to a few bits beyond the radius
        bits = np.unpackbits(sig[i - 700].view(np.uint8))
        bits[rng.choice(128, rng.integers(0, radius + 4), replace=False)] ^= 1
        sig[i] = np.packbits(bits).view(np.uint64)
    sig[600:700, 0] = sig[600, 0]  # a hundred that share four blocks
    rep = rng.permutation(1500)
    for side in (np.zeros(1500, int), rng.integers(0, 2, 1500)):
        want = simhash.tile_edges(rep, sig, side, radius)
        got = [simhash.tile_edges(rep, sig, side, radius, k) for k, reach in enumerate(simhash.reaches(radius)) if reach >= 0]
        label = lambda a, b: simhash.forest(1500, np.asarray(a, int), np.asarray(b, int))
        assert np.array_equal(label(*want), label(*(np.concatenate(x) for x in zip(*got))))


def test_simhash_blocks_compare_a_small_part():
    """Of 20,000 signatures and a radius of 24 bits, under a twentieth of the pairs."""
    value = np.random.default_rng(5).integers(0, 1 << 16, (20_000, 8)).astype(np.uint16)
    compared = sum(len(a) * len(b) for k, reach in enumerate(simhash.reaches(24)) for a, b in simhash.candidates(value[:, k], value[:, k], reach, True))
    assert compared < 0.05 * 20_000 * 19_999 / 2


def test_simhash_groups_by_blocks_are_those_of_all_pairs(spark, monkeypatch):
    docs = tc.read(spark, SF, "documents")
    want = sorted(map(tuple, simhash.simhash_groups(docs).collect()))
    links = simhash._links
    monkeypatch.setattr(simhash, "_links", lambda uniq, radius: links(uniq, radius, plain=0))
    monkeypatch.setattr(simhash, "WIDE", 300)
    assert want and sorted(map(tuple, simhash.simhash_groups(docs).collect())) == want


def test_simhash_tiles_leave_no_close_pair_out():
    rng = np.random.default_rng(4)
    sig = rng.integers(0, 2**63, (400, 2)).astype(np.uint64)
    sig[200:] = sig[:200] ^ (np.uint64(1) << rng.integers(0, 64, (200, 2)).astype(np.uint64))
    a, b = simhash.tile_edges(np.arange(400), sig, np.zeros(400, int), 4)
    assert {frozenset(e) for e in zip(a.tolist(), b.tolist())} == {frozenset((i, i + 200)) for i in range(200)}


def test_mixing_meets_targets(spark):
    docs, labels = tc.read(spark, "/root/testdata/sf0.01", "documents"), tc.read(spark, "/root/testdata/sf0.01", "labels")
    got = mixing.mixing_rates(docs, docs, labels).toPandas()
    p = got[[f"p_{d}" for d in mixing.DOMAINS]].to_numpy()
    share = (got["rate"].to_numpy() * got["tokens"].to_numpy()) @ p / got["tokens"].sum()
    assert (got["rate"] >= 0).all() and np.abs(share - [mixing.TARGETS[d] for d in mixing.DOMAINS]).max() < 0.01


def test_edits_equal_a_full_count():
    rng, counts = random.Random(6), edits.Counts(encoder())
    pool = ["  ", " ", "a", "word", " the", "\n\n", "'ll", "99", "é", "漢", ".", "\t", "don't", "", "\r\n", "，", "。x", "\x1c", "\u3000", "longish\nline"]
    for _ in range(300):
        text = "".join(rng.choices(pool, k=rng.choice([10, 60, 600])))
        tree = edits.TokenTree(text, counts)
        for _ in range(6):
            s, n, new = rng.randint(0, len(text) + 2), rng.randint(0, 9), "".join(rng.choices(pool, k=rng.randint(0, 3)))
            tree.edit(s, n, new)
            s = min(s, len(text))
            text = text[:s] + new + text[s + n :]
            assert tree.text() == text and tree.chars == len(text)
            assert tree.tokens == len(counts.enc.encoding.encode_ordinary(text)), text


def test_edits_cost_what_they_touch():
    counts = edits.Counts(encoder())
    tree, again = edits.TokenTree("", counts), 0
    for k in range(10_000):
        again += tree.edit(tree.chars, 0, f" w{k % 97}")
    assert again <= 4 * 10_000 and tree.tokens == len(counts.enc.encoding.encode_ordinary(tree.text()))
    tree = edits.TokenTree("start end", counts)
    tree.edit(5, 0, " word" * 20_000)
    assert tree.edit(50_000, 1, "x") <= 6
    lines = "\n".join(f"line{k}" for k in range(5_000))
    assert edits.TokenTree(lines, counts).edit(20_000, 2, "?") <= 6
    tree = edits.TokenTree("汉字，句子。" * 4_000, counts)
    assert tree.edit(9_000, 1, "新") <= 6 and tree.tokens == len(counts.enc.encoding.encode_ordinary(tree.text()))
    rng, text = random.Random(3), ""
    tree = edits.TokenTree(text, counts)
    for _ in range(3_000):  # grows to a few thousand pieces and is mostly taken away again
        s, n, new = rng.randint(0, len(text)), rng.choice([0, 3, 40]) if len(text) > 2_000 else 0, "".join(rng.choices([" a", "\nb", "  ", "x9", "'s"], k=rng.randint(0, 12)))
        tree.edit(s, n, new)
        text = text[:s] + new + text[s + n :]
    assert tree.text() == text and tree.tokens == len(counts.enc.encoding.encode_ordinary(text))


def test_chat_round_trip():
    rng = random.Random(7)
    pool = ["<|end|>\n", "<|turn|>", "<\\|end|>\n", "<|", "\\", "|", "\n", "user", "!e", "<|end|>", "", " "]
    some = lambda: rng.choice([None, "".join(rng.choices(pool, k=rng.randint(0, 6)))])
    for _ in range(500):
        turns = [(some(), some()) for _ in range(rng.randint(0, 5))]
        assert chat.parse(chat.formatted(turns)[0]) == turns


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = tc.read(spark, sf, "documents"), tc.read(spark, sf, "labels")
    got = quality.quality_scores(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    good = (got["quality"] > 0) & (got["toxic"] == 0)
    assert len(got) > 1000 and (got["keep"] == good).mean() > 0.95


def test_trees_fit_and_traverse():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 3)).astype(np.float32)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.probability(x[2000:]) > 0.5) == y[2000:]).mean() > 0.95
    row, total = x[2500:2501], model.base
    b = model.bins(row)[0]
    for f, a, leaf in zip(model.feature, model.above, model.leaf):
        node = 0
        while node < len(f):
            node = 2 * node + (2 if b[f[node]] > a[node] else 1)
        total += leaf[node - len(f)]
    assert abs(total - model.margin(row)[0]) < 1e-9


def test_licenses_without_the_filter(spark):
    scanner = licenses.Scanner()
    texts = [r.text for r in tc.read(spark, "/root/testdata/sf0.01", "documents").where("text is not null").select("text").collect()]
    texts += ["SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person", "the MIT License and GNU General Public License version 3"]
    found = 0
    for t in texts:
        if len(t) > 4000:
            continue
        every = scanner.detections(t)
        kept = scanner.scan(t)
        found += len(kept)
        assert kept == licenses.resolve(every)
        for d in every:  # what is left out lies within a kept one at least as strong
            assert any(k[2] <= d[2] and d[3] <= k[3] and k[1] >= d[1] for k in kept)
    assert found > 10 and len(licenses.RULES) >= 200


def test_components(spark):
    from setaudit.llm.graph import components

    rng = random.Random(9)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(i, i + 1) for i in range(300, 400)] + [(None, 3), (5, 5)]
    root = list(range(500))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        if a is not None:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    got = {(r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {(i, top(i)) for i in range(500) if top(i) != i}


def test_statistics_by_the_definition():
    """The features of the classifier, worked out text by text with str methods."""
    texts = ["One two, two THREE!\nfour 55 5", "", "a", "x" * 20 + " y " * 3, "aa bb cc dd aa bb cc dd"]
    odds = np.zeros(quality.BUCKETS, np.float32)
    h = tc.Words(np.frombuffer(b"two", np.uint8), np.array([0, 3]), "alnum").hashes()
    odds[int(h[0]) >> 46] = 3.0
    got, count = quality.statistics(pa.array(texts), odds)
    for row, n, text in zip(got, count, texts):
        f = dict(zip(quality.NAMES, row))
        w = "".join(c if c.isalnum() else " " for c in text.lower()).split()
        size, k = max(len(text), 1), max(len(w), 1)
        share = lambda some: sum(map(some, text)) / size
        assert n == len(w) and np.isclose(f["log_bytes"], np.log1p(len(text))) and np.isclose(f["log_words"], np.log1p(len(w)))
        assert np.isclose(f["word_bytes"], sum(map(len, w)) / k) and np.isclose(f["upper"], share(str.isupper)) and np.isclose(f["digit"], share(str.isdigit))
        assert np.isclose(f["space"], share(str.isspace)) and np.isclose(f["bang"], share(lambda c: c == "!")) and np.isclose(f["line"], share(lambda c: c == "\n"))
        assert np.isclose(f["distinct"], len(set(w)) / k) and np.isclose(f["adjacent"], sum(a == b for a, b in zip(w, w[1:])) / k)
        assert np.isclose(f["short"], sum(len(x) <= 2 for x in w) / k) and np.isclose(f["long"], sum(len(x) >= 12 for x in w) / k)
        grams = list(zip(w, w[1:], w[2:], w[3:]))
        if w:
            assert np.isclose(f["distinct4"], (len(set(grams)) + 1) / (len(grams) + 1))
            assert f["odds_max"] == (3 if "two" in w else 0) and np.isclose(f["odds_mean"], 3 * w.count("two") / k) and f["odds_high"] == w.count("two")


def test_ties_and_equal_rows_are_judged_alike(spark):
    docs = tc.read(spark, SF, "documents").select("doc_id", "text", "source")
    labels = tc.read(spark, SF, "labels")
    twice = docs.unionByName(docs)
    got = quality.quality_scores(twice, labels).toPandas()
    assert len(got) == 2 * docs.count() and (got.groupby("doc_id")["keep"].nunique() == 1).all()
    rates = mixing.mixing_rates(twice, docs, labels).toPandas()
    assert len(rates) == len(got) and (rates.groupby("doc_id")["rate"].agg(lambda r: r.max() - r.min()) < 1e-9).all()
