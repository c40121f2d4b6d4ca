"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns, for every operator."""

import numpy as np
import pytest

from setaudit.llm import chat, decontaminate, edits, embeddings, licenses, lm, mixing, quality, simhash, substring

LONG = " ".join(f"word{i % 9973} filler" for i in range(60_000))
PASSAGE = " ".join(f"shared{i}" for i in range(60))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, group_id string, kept int, th int, rep int, bucket int, rate string, stage string"
EXTRA = ("x", 1, 2, 3, 4, "y", "z")


def row(i, text):
    return (i, text, "en", None, None if text is None else len(text), *EXTRA)


ROWS = [row(None, PASSAGE), row(1, None), row(2, ""), row(3, " \n\t"), row(4, LONG), row(5, PASSAGE + " one end"), row(6, "before it " + PASSAGE), row(6, "before it " + PASSAGE), row(7, "Licensed under the Apache License, Version 2.0"), row(8, "!!!"), row(None, None), row(9, "é 漢字 \U0001f600 ok")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, q, t) for i in (4, 5, 6, 7) for q, t in ((i % 2, 0),)] + [(None, 1, 0), (5, None, 1), (6, 1, None), (5, 1, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_substring(docs, none):
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring.repeated_passages(docs).collect()}
    assert got == {(5, 0, 60), (6, 2, 62)}
    assert substring.repeated_passages(none).count() == 0
    left = substring.without_passages(docs, substring.repeated_passages(docs, earlier=True)).collect()
    texts = [r.text for r in left if r.doc_id == 6]
    assert texts == ["before it "] * 2 and all(r.n_chars == 10 for r in left if r.doc_id == 6)
    assert len(left) == len(ROWS) and left[0].group_id == "x"


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(1, PASSAGE), (2, PASSAGE), (None, PASSAGE), (3, None), (4, "ok"), (5, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(d, i, 0) for d in (5, 6) for i in (1, 2)} | {(9, 4, 0)}
    assert decontaminate.contaminated(none, items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()


def test_embeddings(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [1.0, None]), (None, [1.0, 0.0]), (7, [1.0, 0.0, 0.0]), (8, []), (9, [0.0, 1.0]), (10, [float("inf"), 1.0]), (11, [1.0, 0.0]), (9, [0.1, 1.0])]
    v = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, node int, key int, class_id string")
    got = sorted(tuple(r) for r in embeddings.embedding_classes(v).collect())
    assert got == [(1, 1, 2), (2, 1, 2), (7, 7, 0), (9, 9, 1), (9, 9, 1), (11, 1, 2)]
    assert embeddings.embedding_classes(v.limit(0)).count() == 0


def test_embeddings_in_a_hot_bucket(spark):
    rng = np.random.default_rng(5)
    one, other = rng.standard_normal((2, 8))
    x = np.concatenate([one + 0.01 * rng.standard_normal((400, 8)), np.repeat(one[None], 300, axis=0), other + 0.01 * rng.standard_normal((3, 8))])
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole, blocks = (sorted(tuple(r) for r in embeddings.embedding_classes(v, most=m).collect()) for m in (10_000, 50))
    assert whole == blocks == [(i, 0 if i < 700 else 700, 699 if i < 700 else 2) for i in range(703)]


def test_lm(docs, none):
    got = lm.lm_scores(docs).collect()
    assert len(got) == len(ROWS)
    by = {r.doc_id: r for r in got}
    assert by[2].tokens == 0 and by[2].log_prob == 0 and by[2].nll is None and by[1].nll is None
    assert by[4].tokens > 60_000 and by[4].nll > 0
    assert lm.lm_scores(none).count() == 0


def test_simhash(docs, none):
    got = {(r.doc_id, r.group_id, r.kept) for r in simhash.simhash_groups(docs).collect()}
    assert got == {(5, 5, True), (6, 5, False)}
    assert simhash.simhash_groups(none).count() == 0


def test_simhash_of_doc_ids_with_several_texts(spark):
    a, b = "the first text has seven common words", "quite another story with nothing alike inside"
    rows = [(3, b), (5, a), (5, b), (7, a), (5, a), (None, a), (8, "a lonely document stands here")]
    t = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in simhash.simhash_groups(t).collect()} == {(3, 3, True), (5, 3, False), (5, 5, True), (7, 5, False)}
    left = simhash.without_near_duplicates(t).collect()
    assert sorted((r.doc_id or 0, r.text) for r in left) == sorted([(0, a), (3, b), (5, a), (8, "a lonely document stands here")])


def test_simhash_ties(spark):
    rows = [(i, "one text that thousands of documents have") for i in range(3000)]
    got = simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 3000 and {r.group_id for r in got} == {0} and sum(r.kept for r in got) == 1


def test_mixing(docs, none, labels):
    got = mixing.mixing_rates(docs, docs, labels).collect()
    assert len(got) == len(ROWS) and all(r.rate >= 0 for r in got)
    assert all(r.rate == 1 and r.p_q1t0 == 0 for r in got if not r.tokens)
    assert mixing.mixing_rates(none, none, labels.limit(0)).count() == 0


def test_edits(docs, none):
    got = edits.edited_counts(edits.standard_edits(docs)).collect()
    assert len(got) == len(ROWS)
    assert {r.tokens_before for r in got if r.doc_id in (1, 2)} == {0}
    assert edits.edited_counts(edits.standard_edits(none)).count() == 0


def test_chat(spark):
    rows = [(1, 1, "user", "a<|end|>\nb"), (1, None, None, None), (1, 2, "x y!", "<\\|end|>\n"), (1, 2, "x y!", "<\\|end|>\n"), (None, 1, "user", "hi"), (2, 1, "", "")]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.chat_format(t.withColumnRenamed("turn", "turn").selectExpr("*", "1 as rendered", "2 as turns")).collect()}
    assert chat.parse(got[1].rendered) == [(None, None), ("user", "a<|end|>\nb"), ("x y!", "<\\|end|>\n"), ("x y!", "<\\|end|>\n")]
    assert got[None].turns == 1 and chat.parse(got[2].rendered) == [("", "")]
    alone = spark.createDataFrame([(None, 1, "user", "hi"), (None, 1, "user", "hi"), (None, None, None, None)], t.schema)
    assert sorted(r.turns for r in chat.chat_format(alone).collect()) == [1, 1, 1]
    (long,) = chat.chat_format(spark.createDataFrame([(1, k, "user", "<|end|>\n" * 50_000) for k in range(3)], t.schema)).collect()
    assert long.escaped == 3 and chat.parse(long.rendered) == [("user", "<|end|>\n" * 50_000)] * 3
    assert chat.chat_format(t.limit(0)).count() == 0


def test_quality(docs, none, labels):
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(ROWS)
    assert all(r.p_quality is None and not r.keep for r in got if r.doc_id in (1, 2, 3, 8))
    assert quality.quality_scores(none, labels.limit(0)).count() == 0
    assert quality.quality_stage(docs, labels).columns == docs.columns


def test_licenses(docs, none):
    assert [(r.doc_id, r.license) for r in licenses.license_scan(docs).collect()] == [(7, "Apache-2.0")]
    assert licenses.license_scan(none).count() == 0


def test_edits_from_a_table(spark):
    docs = spark.createDataFrame([(1, "hello world"), (1, "hello there"), (2, None), (None, "x")], "doc_id long, text string")
    rows = [(1, 2, 0, 5, "bye"), (1, 1, 0, 0, "> "), (2, None, 3, 1, "new"), (9, 1, 0, 1, None), (None, 1, 0, 1, "y")]
    table = spark.createDataFrame(rows, "doc_id long, seq int, start int, remove int, insert string")
    got = sorted((r.doc_id or 0, r.chars_after) for r in edits.edited_counts(edits.with_edits(docs, table)).collect())
    assert got == [(0, 1), (1, 11), (1, 11), (2, 3)]
    assert edits.edited_counts(edits.with_edits(docs, table.limit(0))).count() == 4
    assert edits.edited_counts(edits.with_edits(docs.limit(0), table)).count() == 0


def test_a_long_text_full_of_licenses(spark):
    text = "Licensed under the MIT License.\n" * 20_000
    got = licenses.license_scan(spark.createDataFrame([(1, text, 2)], "doc_id long, text string, license int"))
    assert got.count() == 20_000 and {r.license for r in got.limit(5).collect()} == {"MIT"}
