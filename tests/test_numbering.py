"""Row numbers over sets that a planner splits in more than one way."""

import pytest
from pyspark.sql import functions as F

import setaudit as sa
from setaudit import runtime, sources


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("shape", ["ordered", "shuffled"])
def test_every_row_has_its_own_number(spark, adaptive, shape):
    n = 100_000
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        wide = spark.range(n).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).alias("k"), F.repeat(F.lit("x"), 512).alias("input"))
        wide = wide if shape == "ordered" else wide.distinct()
        cases, _ = sources.from_dataframe(wide, order_by="k" if shape == "ordered" else None)
        assert len(cases) == n
        got = cases.cases.select("pos", "input", F.get_json_object("metadata", "$.k").cast("long").alias("k")).where("length(input) = 512").toPandas().sort_values("pos")
        assert (got["pos"].to_numpy() == range(1, n + 1)).all()
        if shape == "ordered":
            assert got["k"].is_monotonic_increasing
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_a_million_numbers(spark):
    got = runtime.numbered(spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("k")).orderBy("k"))
    row = got.agg(F.count("*").alias("n"), F.count_distinct("pos").alias("d"), F.min("pos").alias("a"), F.max("pos").alias("z"), F.sum(F.col("pos") * F.col("k")).alias("s")).first()
    want = sum(i * k for i, k in enumerate(sorted(i * 7919 % 1_000_003 for i in range(1_000_000)), 1))
    assert (row.n, row.d, row.a, row.z, row.s) == (1_000_000, 1_000_000, 1, 1_000_000, want)


def test_odd_tables_are_numbered(spark):
    none = spark.createDataFrame([], "a long, pos long")
    assert runtime.numbered(none, "n").columns == ["a", "pos", "n"] and runtime.numbered(none, "n").count() == 0
    clash = spark.createDataFrame([(1, 2, 3, 4)], "__mid long, __of long, __first long, `a.b` long")
    assert [tuple(r) for r in runtime.numbered(clash, "__base").collect()] == [(1, 2, 3, 4, 1)]


def test_labels_are_stripped_alike_from_all_sources(spark, tmp_path):
    rows = [("x", "a\t"), ("y", "a"), ("z", "\u00a0a\n")]
    cases, _ = sources.from_dataframe(spark.createDataFrame(rows, "input string, label string"))
    assert {c.label for c in cases} == {"a"}
    floats = spark.createDataFrame([("x", 1e20), ("y", None)], "input string, expected double")
    lists = spark.createDataFrame([("x", ["a", "b"])], "input string, expected array<string>")
    assert [c.expected for c in sources.from_dataframe(floats)[0]] == [1e20, None]
    got = [r.expected_text for f in (floats, lists) for r in sources.from_dataframe(f)[0].cases.orderBy("pos").collect()]
    assert got == ["1e+20", None, "['a', 'b']"]


def test_files_that_are_not_utf8_are_refused(spark, tmp_path):
    for name, content in (("a.jsonl", b'{"input": "x"}\n{"input": "\xff"}'), ("a.json", b'["\xff"]'), ("a.csv", b"input\n\xff\n")):
        (tmp_path / name).write_bytes(content)
        with pytest.raises(sa.LoadError, match="not UTF-8"):
            sa.load(spark, str(tmp_path / name))
