"""Sources, mapping, checks, report, gate and CLI on small sets."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import setaudit as sa
from setaudit import cli, config, functions, gate
from setaudit.operators import responses


def make(spark, labels=None, pairs=None):
    if pairs is None:
        pairs = [(f"question number {i}", "ok") for i in range(len(labels))]
    labels = labels or [None] * len(pairs)
    return sa.EvalSet.create(spark, [sa.EvalCase(f"c{i}", q, a, label) for i, ((q, a), label) in enumerate(zip(pairs, labels), 1)])


RECORDS = [{"id": "a1", "input": "What is\n\"x\"?", "expected": "one", "label": "l"}, {"id": "a2", "input": "Why, and how?", "expected": "two", "label": "m"}]


def files(tmp_path):
    (tmp_path / "a.jsonl").write_text("﻿" + "\n\n".join(map(json.dumps, RECORDS)), "utf-8")
    (tmp_path / "a.json").write_text(json.dumps({"cases": RECORDS}), "utf-8")
    (tmp_path / "a.csv").write_text('﻿id,input,expected,label\na1,"What is\n""x""?",one,l\n\na2,"Why, and how?",two,m,over\n', "utf-8")
    return [str(tmp_path / f"a.{x}") for x in ("jsonl", "json", "csv")]


def test_formats_agree(spark, tmp_path):
    for path in files(tmp_path):
        assert [(c.id, c.input, c.expected, c.label) for c in sa.load(spark, path)] == [tuple(r.values()) for r in RECORDS]


@pytest.mark.parametrize("name, text, said", [
    ("a.jsonl", '{"input": "x"}\n\n{bad', "line 3: invalid JSON"), ("a.jsonl", '{"id": "x"}\n{"input": "y"}', "line 1: 'input' is missing"), ("a.jsonl", '{"input": " "}', "line 1: 'input' must"), ("a.json", '{"x": 1}', "'cases'"),
    ("a.json", "3", "list of cases"), ("a.json", '["x"]', "item 1: expected an object"), ("a.jsonl", '{"input": "x", "label": ["y"]}', "'label' must be a scalar"), ("a.csv", "", "no cases|header"), ("a.txt", "x", "unsupported"),
    ("a.jsonl", '{"id":"b","input":"x"}\n{"id":"b","input":"y"}\n{"id":"a","input":"y"}\n{"id":"a","input":"y"}', "repeated: a, b"), ("a.jsonl", "", "no cases"),
])
def test_bad_files(spark, tmp_path, name, text, said):
    (tmp_path / name).write_text(text)
    with pytest.raises(sa.LoadError, match=said):
        sa.load(spark, str(tmp_path / name))


def test_values_keep_their_form(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"question": "x", "answer": true, "category": 1, "k": 2}\n{"question": "y", "answer": [1.0, "z"], "category": "1"}\n')
    got, mapping = sa.load_with_mapping(spark, str(p))
    cases = list(got)
    assert [c.id for c in cases] == ["case_1", "case_2"] and [c.expected for c in cases] == [True, [1.0, "z"]] and {c.label for c in cases} == {"1"}
    assert cases[0].metadata == {"k": 2} and mapping.inferred == {"input": "question", "expected": "answer", "label": "category"}
    assert [r.expected_text for r in got.cases.orderBy("pos").collect()] == ["True", "[1.0, 'z']"]


def test_mapping():
    columns = ["ind", "activity_label", "ctx", "label"]
    m = sa.resolve_mapping(columns)
    assert m.resolved == {"id": "ind", "input": "ctx", "label": "label"} and m.alternatives == {"label": ("activity_label",)}
    moved = sa.resolve_mapping(columns, {"label": "activity_label"})
    assert moved.displaced == {"label": "unmapped_label"} and any("unmapped_label" in x for x in moved.explain())
    with pytest.raises(sa.AmbiguousMappingError):
        sa.resolve_mapping(["type", "category", "question"])
    with pytest.raises(sa.MappingError):
        sa.resolve_mapping(["x"])
    with pytest.raises(sa.MappingError):
        sa.resolve_mapping(["question"], {"input": "nope"})


def test_imbalance(spark):
    check = sa.ImbalanceCheck()
    assert not check.run(make(spark, ["a"] * 8 + ["b"] * 6 + ["c"] * 6)).findings
    got = check.run(make(spark, ["a"] * 18 + ["b"] * 2))
    assert got.stats["imbalance_ratio"] == 9 and [f.case_ids for f in got.findings] == [(), ("c19", "c20")]
    gaps = check.run(make(spark, ["a"] * 5 + ["b"] * 5 + [None] * 4))
    assert gaps.findings[0].case_ids == ("c11", "c12", "c13", "c14")
    assert [f.severity for f in check.run(make(spark, [None] * 3)).findings] == ["info"]
    assert check.run(make(spark, ["a"] * 6)).findings[0].severity == "info"


def test_leakage(spark):
    check = sa.LeakageCheck()
    clean = [(f"what is the value of item {i}", f"the long reasoned answer {i}") for i in range(24)]
    assert not check.run(make(spark, pairs=clean)).has_warnings
    got = check.run(make(spark, pairs=[*clean, ("Say THE  secret\tphrase here now", "the secret PHRASE here")]))
    assert got.stats["leaking_case_ids"] == ["c25"] and got.findings[0].case_ids == ("c25",)
    assert check.run(make(spark, pairs=[(f"pick A {i}", "ABCD"[i % 4]) for i in range(40)])).stats["closed_vocabulary"]
    wide = check.run(make(spark, pairs=[(f"text with the answer number {i} inside", f"answer number {i} inside") for i in range(30)]))
    assert wide.stats["widespread"] and len(wide.findings) == 1 and len(wide.findings[0].case_ids) == 20
    assert check.run(make(spark, pairs=[("x", None)])).findings[0].severity == "info"


def angles(*degrees):
    return lambda texts: np.array([[math.cos(math.radians(degrees[int(t.split()[-1])])), math.sin(math.radians(degrees[int(t.split()[-1])]))] for t in texts])


@pytest.mark.parametrize("per_batch", [False, True])
def test_duplicates(spark, per_batch):
    run = lambda names, *d: sa.DuplicateCheck(embedder=angles(*d), per_batch=per_batch).run(make(spark, pairs=[(f"text {i}", None) for i in names]))
    assert run([0, 1], 0, 40).stats["max_similarity"] == 0.766
    chain = run([0, 1, 2], 0, 25, 50)
    assert chain.stats["clusters"] == [{"case_ids": ["c1", "c2", "c3"], "min_similarity": 0.6428, "max_similarity": 0.9063}] and chain.stats["effective_n_cases"] == 1
    same = run([0, 0, 1], 0, 90)
    assert "identical" in same.findings[0].message and same.findings[0].case_ids == ("c1", "c2") and same.stats["max_similarity"] == 1.0


def test_tiles_agree(spark):
    from setaudit.operators.duplicates import compare

    x = np.random.default_rng(0).standard_normal((90, 4))
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pos long, vec array<double>")
    one, many = ({(r.a, r.b) for r in compare(v, 0.8, tile)[0].collect()} for tile in (4096, 11))
    assert one == many and one


def lookup(table):
    return lambda case, model: table[case.id][["weak", "strong"].index(model)]


def test_discrimination(spark):
    cases = make(spark, pairs=[("q", None)] * 5)
    table = {"c1": (True, True), "c2": (False, False), "c3": (False, True), "c4": (np.float64(0.9), 0.1), "c5": (float("nan"), 0.5)}
    got = sa.DiscriminationCheck(lookup(table), ["weak", "strong"], max_workers=3).run(cases).stats
    assert (got["ceiling_case_ids"], got["floor_case_ids"], got["inverted_case_ids"], got["n_discriminating"]) == (["c1"], ["c2"], ["c4"], 3)
    with pytest.raises(sa.ScorerError, match="case 'c2' with model 'strong'"):
        sa.DiscriminationCheck(lookup(table | {"c2": (True, "x")}), ["weak", "strong"], max_workers=2).run(cases)
    log = spark.createDataFrame([(p, f"c{p}", m, "x", r, float(p == 1 and r)) for p in (1, 2) for m in (0, 1) for r in (0, 1)], "pos long, case_id string, model_ix int, model string, repeat int, score double")
    assert sa.DiscriminationCheck(None, ["weak", "strong"], repeats=2).run(make(spark, pairs=[("q", None)] * 2), log).stats["unstable_case_ids"] == ["c1"]


def test_sample_keeps_order(spark):
    cases = make(spark, pairs=[("q", None)] * 40)
    check = lambda: sa.DiscriminationCheck(lambda c, m: True, ["weak", "strong"], sample=10, sample_seed=3).run(cases)
    got = check()
    ids = got.stats["ceiling_case_ids"]
    assert len(ids) == 10 and ids == sorted(ids, key=lambda s: int(s[1:])) == check().stats["ceiling_case_ids"] and got.summary.startswith("SAMPLE of 10 of 40")


def test_response_functions(spark):
    t = spark.createDataFrame([("#### 1,234 then #### $-5.5", "<think>no FAIL</think> pass."), ("none", "<think>PASS"), (None, "it may PASS")], "a string, b string")
    got = t.select(functions.last_number("a").alias("n"), functions.verdict("b").alias("v")).collect()
    assert [tuple(r) for r in got] == [(-5.5, True), (None, None), (None, None)]
    k = t.select(functions.request_key(m=F.col("a"), r=F.lit(1)).alias("k"), functions.request_key(m=F.col("a"), r=F.lit(2)).alias("j")).collect()
    assert len({x for r in k for x in r}) == 6
    req, log = spark.createDataFrame([("k1",), ("k2",), ("k2",)], "key string"), spark.createDataFrame([("k1", "old", 1), ("k1", "new", 3), ("k1", "mid", 2)], "key string, text string, at long")
    hit, miss = responses.replayed(req, log)
    assert [r.text for r in hit.collect()] == ["new"] and [r.key for r in miss.collect()] == ["k2"]


def test_gate_report_and_cli(spark, tmp_path, capsys):
    with pytest.raises(ValueError):
        sa.CheckResult("x", "s")
    r = [sa.CheckResult("x", "s", (sa.Finding("m [b]", case_ids=tuple("abcdefgh")), sa.Finding("i", sa.Severity.INFO)), {"n": np.int64(3)}, ("limit",))]
    assert [gate.exit_code(r, f) for f in gate.FAIL_ON] == [0, 1, 1] and gate.exit_code(r, "never", True) == 3
    text = sa.render_text(r, source="f")
    assert "(+2 more)" in text and "limit" in text and "[b]" in text and "1 warning across 1 check, plus 1 for information" in text
    assert json.loads(json.dumps(sa.to_dict(r, source="f")))["checks"][0]["stats"] == {"n": 3}
    p = tmp_path / "s.jsonl"
    p.write_text("\n".join(json.dumps({"id": f"i{i}", "input": f"text {i}", "expected": "x", "label": "ab"[i > 17]}) for i in range(20)))
    assert cli.main([str(p), "--skip-duplicates"], spark) == 0
    assert cli.main([str(p), "--skip-duplicates", "--fail-on", "warning", "--json"], spark) == 1
    out = capsys.readouterr().out
    assert json.loads(out[out.index("{\n") :])["gate"] == {"fail_on": "warning", "exit_code": 1, "tripped": True, "incomplete": False}
    assert cli.main([str(p)], spark) == 3 and cli.main([str(tmp_path / "no")], spark) == 2 and cli.main([str(p), "--min-class-share", "2"], spark) == 3
    assert cli.main([str(p), "--map", "label"], spark) == 3
    (tmp_path / "setaudit.toml").write_text('fail_on = "any"\nskip_duplicates = true\n')
    assert cli.main([str(p)], spark) == 1 and cli.main([str(p), "--fail-on", "never"], spark) == 0
    (tmp_path / "setaudit.toml").write_text("min_class_count = true\n")
    with pytest.raises(config.ConfigError):
        config.load_config(config.find_config(tmp_path))
