"""Discrimination, response logs and the gate over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from setaudit import functions as fn
from setaudit import gate, runtime
from setaudit.operators import discrimination as disc
from setaudit.operators import responses
from setaudit.plans.checks import as_cases, read

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


MODELS = ("small", "medium", "large")
_SCORE = "(140 - ((doc_id * 7919) % 100) + 20 * m - (CASE WHEN doc_id % 11 = 0 THEN 60 * m ELSE 0 END) + (CASE WHEN doc_id % 13 = 0 THEN 30 * r ELSE 0 END)) / 200.0"
_VERDICTS = f"""WITH v AS (SELECT doc_id::VARCHAR AS case_id, m AS model_ix, r AS "repeat", ({_SCORE})::DOUBLE AS score, ({_SCORE})::DOUBLE >= 0.5 AS passed
  FROM documents, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1, 2]) AS r)),
p AS (SELECT case_id, model_ix, count(*) AS n_repeats, count(*) FILTER (WHERE passed) AS n_passed FROM v GROUP BY ALL),
k AS (SELECT case_id, bool_and(n_passed IN (0, n_repeats)) AS stable, bool_and(n_passed = n_repeats) AS a, bool_and(n_passed = 0) AS z,
  coalesce(min(model_ix) FILTER (WHERE n_passed > 0) < max(model_ix) FILTER (WHERE n_passed < n_repeats), false) AS i FROM p GROUP BY case_id),
t AS (SELECT case_id, stable, stable AND a AS ceiling, stable AND z AS floor, stable AND i AS inverted FROM k)
"""
_TOTALS = """SELECT count(*) AS n_cases, count(*) FILTER (WHERE stable) AS n_measured, count(*) FILTER (WHERE NOT stable) AS n_unstable, count(*) FILTER (WHERE ceiling) AS n_ceiling,
  count(*) FILTER (WHERE floor) AS n_floor, count(*) FILTER (WHERE inverted) AS n_inverted, count(*) FILTER (WHERE ceiling OR floor) AS n_same,
  round(count(*) FILTER (WHERE ceiling OR floor)::DOUBLE / count(*) FILTER (WHERE stable), 6) AS same_share"""


def _verdicts(spark, sf, threshold=0.5):
    rows = disc.tasks(read(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("case_id")), MODELS, 3)
    d, m, r = F.col("pos"), F.col("model_ix"), F.col("repeat")
    score = (140 - (d * 7919) % 100 + 20 * m - F.when(d % 11 == 0, 60 * m).otherwise(0) + F.when(d % 13 == 0, 30 * r).otherwise(0)).cast("double") / 200.0
    return disc.judged(rows.withColumn("score", score), threshold)


@query(_VERDICTS + 'SELECT case_id, model_ix, "repeat", round(score, 6) AS score, passed FROM v')
def disc_verdicts(spark, sf):
    return _verdicts(spark, sf).select("case_id", "model_ix", "repeat", F.round("score", 6).alias("score"), "passed")


@query(_VERDICTS + "SELECT *, n_passed IN (0, n_repeats) AS unanimous FROM p")
def disc_stability(spark, sf):
    return disc.stability(_verdicts(spark, sf))


@query(_VERDICTS + "SELECT case_id, stable, ceiling, floor, inverted FROM t")
def disc_taxonomy(spark, sf):
    return disc.taxonomy(_verdicts(spark, sf), 3)


@query(_VERDICTS + _TOTALS + " FROM t")
def disc_stats(spark, sf):
    return disc.totals(disc.taxonomy(_verdicts(spark, sf), 3)).withColumn("same_share", F.round("same_share", 6))


@query(_VERDICTS + "SELECT model_ix, list_extract(['small', 'medium', 'large'], model_ix + 1) AS model, count(*) AS n_calls, round(count(*) FILTER (WHERE passed)::DOUBLE / count(*), 6) AS pass_rate FROM v GROUP BY model_ix")
def disc_pass_rates(spark, sf):
    return disc.pass_rates(_verdicts(spark, sf)).withColumn("pass_rate", F.round("pass_rate", 6))


@query(_VERDICTS + "SELECT x::DOUBLE AS threshold, count(*) FILTER (WHERE score >= x) AS n_passed, count(*) AS n_calls FROM v, (SELECT unnest([0.3, 0.5, 0.8]) AS x) GROUP BY x")
def disc_threshold_sweep(spark, sf):
    rows = _verdicts(spark, sf).select("score", F.explode(F.array(F.lit(0.3), F.lit(0.5), F.lit(0.8))).alias("threshold"))
    ok = F.when(F.isnan("score"), False).otherwise(F.col("score") >= F.col("threshold"))
    return rows.groupBy("threshold").agg(F.count_if(ok).alias("n_passed"), F.count("*").alias("n_calls"))


@query("""WITH v AS (SELECT event_id AS case_id, m AS ix, value >= (CASE m WHEN 0 THEN 60 WHEN 1 THEN 40 ELSE 20 END) + (CASE WHEN event_id % 17 = 0 THEN 30 * r ELSE 0 END) - (CASE WHEN event_id % 5 = 0 THEN 45 * (2 - m) ELSE 0 END) AS y
  FROM events, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1]) AS r)),
p AS (SELECT case_id, ix, count(*) AS n, count(*) FILTER (WHERE y) AS y FROM v GROUP BY ALL),
k AS (SELECT case_id, bool_and(y IN (0, n)) AS stable, bool_and(y = n) AS a, bool_and(y = 0) AS z, coalesce(min(ix) FILTER (WHERE y > 0) < max(ix) FILTER (WHERE y < n), false) AS i FROM p GROUP BY case_id),
t AS (SELECT stable, stable AND a AS ceiling, stable AND z AS floor, stable AND i AS inverted FROM k)
""" + _TOTALS + " FROM t")
def disc_events_log(spark, sf):
    """Every event is a case; its value is graded twice for three models, each with a bar of its own."""
    rows = disc.tasks(read(spark, sf, "events").select(F.col("event_id").alias("case_id"), "value"), MODELS, 2)
    m, r, e = F.col("model_ix"), F.col("repeat"), F.col("case_id")
    bar = F.when(m == 0, 60).when(m == 1, 40).otherwise(20) + F.when(e % 17 == 0, 30 * r).otherwise(0) - F.when(e % 5 == 0, 45 * (2 - m)).otherwise(0)
    return disc.totals(disc.taxonomy(rows.withColumn("passed", F.coalesce(F.col("value") >= bar, F.lit(False))), 3)).withColumn("same_share", F.round("same_share", 6))


@query("""WITH v AS (SELECT user_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END AS ix, coalesce(value >= 20, false) AS y FROM events WHERE event_type IN ('view', 'click', 'signup'))
SELECT user_id AS case_id, ix AS model_ix, count(*) AS n_repeats, count(*) FILTER (WHERE y) AS n_passed, count(*) FILTER (WHERE y) IN (0, count(*)) AS unanimous FROM v GROUP BY user_id, ix""")
def disc_events_stability(spark, sf):
    """Every view, click and signup of the log is a verdict on its user: repeats in any number."""
    ix = F.when(F.col("event_type") == "view", 0).when(F.col("event_type") == "click", 1).otherwise(2)
    calls = read(spark, sf, "events").where(F.col("event_type").isin("view", "click", "signup"))
    return disc.stability(disc.judged(calls.select(F.col("user_id").alias("case_id"), ix.alias("model_ix"), F.col("value").alias("score")), 20.0))


@query("""SELECT doc_id AS case_id, true AS stable, quality > 0 AND toxic > 0 AS ceiling, quality <= 0 AND toxic <= 0 AS floor, quality > 0 AND toxic <= 0 AS inverted
FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL""")
def disc_labels_two_raters(spark, sf):
    both = F.explode(F.array(F.struct(F.lit(0).alias("model_ix"), F.col("quality").alias("y")), F.struct(F.lit(1).alias("model_ix"), F.col("toxic").alias("y")))).alias("v")
    rows = read(spark, sf, "labels").where("quality is not null and toxic is not null").select(F.col("doc_id").alias("case_id"), both)
    return disc.taxonomy(rows.select("case_id", "v.model_ix", (F.col("v.y") > 0).alias("passed")), 2)


@query()
def disc_sample(spark, sf):
    """200 drawn cases: the feature is a sample."""
    cases = runtime.numbered(read(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("id"), "doc_id").orderBy("doc_id")).select("id", "pos")
    return disc.drawn(cases, cases.count(), 200, seed=7)


def _scorer(case, model):
    d, m = int(case.id), MODELS.index(model)
    return (90 - (d * 7919) % 100 + 20 * m - (60 * m if d % 11 == 0 else 0) + len(case.input) % 101) / 200.0


@query(r"""WITH v AS (SELECT doc_id::VARCHAR AS case_id, m AS model_ix, r AS "repeat",
  ((90 - ((doc_id * 7919) % 100) + 20 * m - (CASE WHEN doc_id % 11 = 0 THEN 60 * m ELSE 0 END) + length(text) % 101) / 200.0)::DOUBLE AS score
  FROM documents, (SELECT unnest([0, 1, 2]) AS m), (SELECT unnest([0, 1, 2]) AS r) WHERE regexp_matches(text, '\S'))
SELECT case_id, model_ix, "repeat", round(score, 6) AS score, score >= 0.5 AS passed FROM v""")
def disc_scorer_udf(spark, sf):
    """The scorer reads each case's whole text, for three models and three runs. It can't know the run, so runs agree."""
    none = F.lit(None).cast("string")
    cases = as_cases(read(spark, sf, "documents").where(~fn.is_blank("text")), "doc_id", "text").withColumns({"expected_json": none, "metadata": none})
    calls = disc.scored(disc.tasks(cases, MODELS, 3), _scorer, MODELS)
    return disc.judged(calls).select("case_id", "model_ix", "repeat", F.round("score", 6).alias("score"), "passed")


@query(r"""WITH t AS (SELECT o_orderkey, 'so ANSWER: ' || o_custkey || '; no, ANSWER: $1,' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0') AS reply FROM orders)
SELECT o_orderkey, replace(list_extract(regexp_extract_all(reply, '(?:ANSWER:|####)\s*\$?(-?[0-9][0-9,]*(?:\.[0-9]+)?)', 1), -1), ',', '')::DOUBLE AS answer FROM t""")
def resp_number_parse(spark, sf):
    reply = F.concat(F.lit("so ANSWER: "), F.col("o_custkey").cast("string"), F.lit("; no, ANSWER: $1,"), F.lpad((F.col("o_orderkey") % 1000).cast("string"), 3, "0"))
    return read(spark, sf, "orders").select("o_orderkey", fn.last_number(reply).alias("answer"))


_PRICES = [("view", 1.0, 5.0), ("click", 3.0, 15.0), ("signup", 5.0, 25.0)]


@query("""WITH t AS (SELECT event_type AS model, count(*) AS n_calls, sum(floor(value)::BIGINT)::BIGINT AS i, sum(event_id % 50)::BIGINT AS o FROM events GROUP BY 1)
SELECT model, n_calls, i AS input_tokens, o AS output_tokens, round((i * coalesce(pi, 0) + o * coalesce(po, 0)) / 1e6, 6) AS usd
FROM t LEFT JOIN (VALUES ('view', 1.0::DOUBLE, 5.0::DOUBLE), ('click', 3.0, 15.0), ('signup', 5.0, 25.0)) AS c(m, pi, po) ON model = m""")
def resp_cost_rollup(spark, sf):
    calls = read(spark, sf, "events").select(F.col("event_type").alias("model"), F.floor("value").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"))
    prices = spark.createDataFrame(_PRICES, "model string, input_rate double, output_rate double")
    return responses.costs(calls, prices).withColumn("usd", F.round("usd", 6))


@query(_VERDICTS + """SELECT case_id, model_ix, string_agg(CASE WHEN passed THEN 'P' ELSE 'F' END, '' ORDER BY "repeat") || '.' AS runs FROM v GROUP BY case_id, model_ix""")
def resp_stability_strings(spark, sf):
    return responses.stability_strings(_verdicts(spark, sf), 4)


_FINDINGS = [("clean", None), ("noted", "info"), ("warned", "warning"), ("both", "info"), ("both", "warning")]


@query("""WITH f(run, severity) AS (VALUES ('clean', NULL), ('noted', 'info'), ('warned', 'warning'), ('both', 'info'), ('both', 'warning')),
n AS (SELECT run, count(severity) AS n_findings, count(*) FILTER (WHERE severity = 'warning') AS n_warnings FROM f GROUP BY run)
SELECT run, n_findings, n_warnings, fail_on, incomplete, CASE WHEN incomplete THEN 3 WHEN fail_on = 'warning' AND n_warnings > 0 OR fail_on = 'any' AND n_findings > 0 THEN 1 ELSE 0 END AS exit_code
FROM n, (VALUES ('never'), ('warning'), ('any')) AS g(fail_on), (VALUES (false), (true)) AS i(incomplete)""")
def gate_truth_table(spark, sf):
    return gate.decided(spark.createDataFrame(_FINDINGS, "run string, severity string"))
