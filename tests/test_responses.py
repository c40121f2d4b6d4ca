"""Response logs: write-through, chains of answers and verdicts, reports."""

import pytest
from pyspark.sql import functions as F

from setaudit import functions as fn
from setaudit.operators import responses


def test_write_through_asks_once(spark, tmp_path):
    path, marks = str(tmp_path / "log"), tmp_path / "calls"
    marks.mkdir()

    def call(r, marks=str(marks)):
        import os
        import uuid

        open(os.path.join(marks, f"{r['key']}-{uuid.uuid4().hex}"), "w").close()
        return {"model": "m", "text": f"to {r['key']}", "input_tokens": 2, "output_tokens": 3}

    asked = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "key string, n int")
    first = responses.answered(asked, path, call, at=1)
    assert sorted((r.key, r.n, r.text) for r in first.collect()) == [("a", 1, "to a"), ("b", 2, "to b"), ("b", 3, "to b")]
    again = responses.answered(asked.union(spark.createDataFrame([("c", 4)], "key string, n int")), path, call, at=2)
    assert again.count() == 4 and len(list(marks.iterdir())) == 3
    log = responses.opened(spark, path)
    assert sorted((r.key, r["at"]) for r in log.collect()) == [("a", 1), ("b", 1), ("c", 2)]


def test_newest_is_settled_by_time_then_content(spark):
    log = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("a", "z", 2), (None, "n", 9)], "key string, text string, at long")
    assert [(r.key, r.text) for r in responses.newest(log).collect()] == [("a", "z")]
    hit, miss = responses.replayed(spark.createDataFrame([("q", 2), ("q", 1), (None, 5), (None, 5)], "key string, n int"), log)
    assert hit.count() == 0 and sorted((r.key or "", r.n) for r in miss.collect()) == [("", 5), ("", 5), ("q", 1)]


def asks(spark):
    rows = [(c, m, i, r) for c in ("c1", "c2", "c3") for i, m in enumerate(("weak", "strong")) for r in (1, 2)]
    return spark.createDataFrame([(*x, f"q {x[0]}", "e") for x in rows], "case_id string, model string, model_ix int, repeat int, input string, expected string")


def keys():
    none = F.lit(None).cast("double")
    answer = fn.answer_key("local", model=F.col("model"), system=F.lit("s"), input=F.col("input"), temperature=none, seed=F.lit(0), repeat=F.col("repeat"))
    judge = lambda a: fn.judge_key("local", judge_model=F.lit("j"), case=F.col("case_id"), system=F.lit("js"), prompt=fn.prompt("grade {a} against {e}", a=a, e=F.col("expected")), temperature=none, seed=F.lit(0), repeat=F.col("repeat"))
    return answer, judge


def logged(spark):
    answer, judge = keys()
    rows = asks(spark).where("case_id != 'c3' or model = 'weak'")
    text = F.concat("model", F.lit(" on "), "case_id", F.lit("#"), F.col("repeat").cast("string"))
    verdict = F.when((F.col("case_id") == "c1") | (F.col("repeat") == 1), F.when(F.col("model") == "weak", "PASS").otherwise("FAIL")).otherwise("FAIL")
    full = rows.withColumn("a", text)
    one = full.select(answer.alias("key"), F.col("a").alias("text"), F.lit(1).alias("at"))
    return one.unionByName(full.select(judge(F.col("a")).alias("key"), verdict.alias("text"), F.lit(1).alias("at")))


def test_chain_report_and_trail(spark):
    trail = responses.chained(asks(spark), logged(spark), *keys())
    assert trail.count() == 12
    verdicts = trail.withColumn("repeat", F.col("repeat") - 1)
    got = {r.case_id: (r.weak, r.strong, r.n_inverted, r.status, r.always_inverted) for r in responses.stability_report(verdicts, 2).collect()}
    assert got == {"c1": ("PP", "FF", 2, "stable", True), "c2": ("PF", "FF", 1, "unstable", False), "c3": ("PF", "..", None, "incomplete", False)}
    seen = responses.audit(trail.where("repeat = 1"), ["c1", "c3"])
    assert {(r.case_id, r.model, r.outcome) for r in seen.collect()} == {("c1", "weak", "PASS"), ("c1", "strong", "FAIL"), ("c3", "weak", "PASS"), ("c3", "strong", "no answer")}
    lines = responses.trail_lines(seen)
    assert lines[:3] == ["case c1", "  input: q c1", "  expected: e"] and "    answer: weak on c1#1" in lines and "  strong: no answer" in lines


def test_identity_needs_every_part():
    with pytest.raises(ValueError, match="seed"):
        fn.answer_key("local", model=F.lit("m"))


def test_identity_tells_requests_apart(spark):
    parts = dict(model=F.lit("m"), system=F.lit("s"), input=F.lit("i"), temperature=F.lit(None).cast("double"), seed=F.lit(1), repeat=F.lit(1))
    variants = [fn.answer_key("local", **parts), fn.answer_key("other", **parts)] + [fn.answer_key("local", **parts | {k: F.lit("2")}) for k in parts]
    row = spark.range(1).select(*[v.alias(f"k{n}") for n, v in enumerate(variants)]).first()
    assert len(set(row)) == len(variants)


def test_prompt_fills_in_columns(spark):
    row = spark.createDataFrame([("q {b}", None)], "a string, b string").select(fn.prompt("[{a}|{b}]", b=F.col("b"), a=F.col("a")).alias("p")).first()
    assert row.p == "[q {b}|]"


def test_costs(spark):
    calls = spark.createDataFrame([("c1", "m", 1_000_000, 0), ("c1", "n", 0, 1_000_000), ("c1", "free", 5, 5)], "case_id string, model string, input_tokens long, output_tokens long")
    prices = spark.createDataFrame([("m", 1.0, 9.0), ("n", 9.0, 3.0)], "model string, input_rate double, output_rate double")
    lines = responses.cost_lines(responses.costs(calls, prices))
    assert len(lines) == 5 and lines[-1].endswith("$4.0000") and "free" in lines[1]
    got = responses.smoke_estimate(calls, prices, 100, 3).first()
    assert (got.n_measured, got.usd_per_case, got.n_calls, got.usd) == (1, 4.0, 900, 1200.0)
    assert responses.smoke_estimate(calls.limit(0), prices, 10).first().usd == 0


def test_strict_numbers(spark):
    t = spark.createDataFrame([("ANSWER: 1,000",), (None,)], "a string")
    assert [r.n for r in t.select(fn.last_number("a", strict=True).alias("n")).collect()] == [1000.0, None]
    with pytest.raises(Exception, match="no number in the reply"):
        spark.createDataFrame([("forty",)], "a string").select(fn.last_number("a", strict=True).alias("n")).collect()


def test_judge_notes():
    sizes = {"a:3b": 3.0, "a:7b": 7.0, "b:14b": 14.0}
    text = lambda *x, **k: " / ".join(responses.judge_notes(*x, **k))
    assert "another provider" in text("x", ["a:3b"], other_provider=True) and "temperature" in text("x", ["a:3b"], other_provider=True)
    own = text("a:3b", ["a:3b", "a:7b"], sizes)
    assert "its own answers" in own and "smaller" in own and "another family" not in own
    big = text("b:14b", ["a:3b", "a:7b"], sizes)
    assert "at least as large" in big and "another family" in big
    assert "isn't known" in text("c", ["a:3b"], sizes)
