"""Whole checks, readers of text files and response logs over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from setaudit import functions as fn
from setaudit import report, runtime, sources
from setaudit.model import EvalSet
from setaudit.operators import responses
from setaudit.operators.discrimination import DiscriminationCheck
from setaudit.operators.duplicates import DuplicateCheck
from setaudit.operators.imbalance import ImbalanceCheck
from setaudit.operators.leakage import LeakageCheck
from setaudit.plans.checks import _CLUSTERS, _PLANTED, _SIM, _leak_sql, _planted, as_cases, read
from setaudit.plans.verdicts import _VERDICTS, MODELS, _verdicts

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _found(spark, result):
    """Findings in their order, after a row that holds the summary."""
    rows = report.findings_table(spark, [result]).select("ord", "severity", "message", F.array_join("case_ids", ",").alias("ids"))
    return spark.createDataFrame([(-1, "summary", result.summary, "")], rows.schema).unionByName(rows)


_NUMBERED = "SELECT (row_number() OVER (ORDER BY o, p) - 2)::INTEGER AS ord, severity, message, ids FROM f"


@query("""WITH d AS (SELECT doc_id, lang, toxic FROM documents LEFT JOIN labels USING (doc_id)),
n AS (SELECT count(*) AS n, count(lang) AS l, count(*) FILTER (WHERE toxic IS NULL) AS m FROM d),
c AS (SELECT lang, count(*) AS k, min(doc_id) AS f, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM d WHERE lang IS NOT NULL GROUP BY lang),
e AS (SELECT count(*) AS g, max(k)::DOUBLE / min(k) AS r, (SELECT lang FROM c ORDER BY k DESC, f LIMIT 1) AS a, (SELECT lang FROM c ORDER BY k, f DESC LIMIT 1) AS z, max(k) AS ka, min(k) AS kz FROM c),
w AS (SELECT *, share < 0.12 AS low, k < 5 AS few FROM c),
f AS (
SELECT 0 AS o, 0 AS p, 'summary' AS severity, printf('%d cases across %d classes, imbalance ratio %.1f:1', n, g, r) AS message, '' AS ids FROM n, e
UNION ALL SELECT 1, 0, 'warning', printf('%d of %d cases have no label; shares cover the %d labelled ones', n - l, n, l), (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM d WHERE lang IS NULL) FROM n WHERE 0 < l AND l < n
UNION ALL SELECT 2, 0, 'warning', printf('%d of %d cases have no ''expected'' value and can''t be scored automatically', m, n), (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM d WHERE toxic IS NULL) FROM n WHERE m > 0
UNION ALL SELECT 3, 0, 'warning', printf('class imbalance ratio is %.1f:1 — ''%s'' has %d cases, ''%s'' %d; the average is mostly ''%s''', r, a, ka, z, kz, a), '' FROM e WHERE g > 1 AND r > 3
UNION ALL SELECT 4, row_number() OVER (ORDER BY k DESC, f), 'warning', 'class ''' || lang || ''' is under-represented: '
  || CASE WHEN low THEN printf('%.1f%% of labelled cases (below 12%%)', share * 100) ELSE '' END || CASE WHEN low AND few THEN '; ' ELSE '' END
  || CASE WHEN few THEN printf('only %d case%s, so its accuracy has %d distinct values', k, CASE WHEN k = 1 THEN '' ELSE 's' END, k + 1) ELSE '' END,
  (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM d WHERE d.lang = w.lang) FROM w WHERE low OR few)
""" + _NUMBERED)
def chk_imbalance(spark, sf):
    docs = read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left")
    return _found(spark, ImbalanceCheck(min_class_share=0.12).run(EvalSet(as_cases(docs, "doc_id", "text", "toxic", "lang"))))


@query(_leak_sql(_PLANTED) + """, f AS (
SELECT 0 AS o, 0 AS p, 'summary' AS severity, n_with_expected || ' answered cases, ' || CASE WHEN n_contained > 0 THEN printf('%d contain their own answer (%.0f%%)', n_contained, share * 100) ELSE 'none contain their own answer' END
  || CASE WHEN n_short > 0 THEN ' — ' || n_short || ' skipped as too short to judge' ELSE '' END AS message, '' AS ids FROM s
UNION ALL SELECT 1, doc_id, 'warning', printf('the expected answer stands word for word in the input (%d characters): copying solves this case', answer_chars), doc_id::VARCHAR FROM k WHERE contained)
""" + _NUMBERED)
def chk_leakage(spark, sf):
    return _found(spark, LeakageCheck().run(EvalSet(_planted(spark, sf).where("input is not null"))))


@query(_leak_sql("substr(text, 1, 60)") + """, f AS (
SELECT 0 AS o, 0 AS p, 'summary' AS severity, printf('%d answered cases, %d contain their own answer (%.0f%%)', n_with_expected, n_contained, share * 100)
  || CASE WHEN n_short > 0 THEN ' — ' || n_short || ' skipped as too short to judge' ELSE '' END AS message, '' AS ids FROM s
UNION ALL SELECT 1, 0, 'info', printf('%.0f%% of cases (%d/%d) contain their own expected answer; so many suggest that the task is to find it there, so cases aren''t reported one by one', share * 100, n_contained, n_with_expected),
  (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM k WHERE contained ORDER BY doc_id LIMIT 20)) FROM s WHERE widespread)
""" + _NUMBERED)
def chk_leakage_widespread(spark, sf):
    return _found(spark, LeakageCheck().run(EvalSet(as_cases(read(spark, sf, "documents").where("text is not null"), "doc_id", "text", F.substring("text", 1, 60)))))


@query(_CLUSTERS + f""", q AS (SELECT x.cluster AS cluster, min({_SIM}) AS lo, max({_SIM}) AS hi
  FROM c x JOIN c y ON x.cluster = y.cluster AND x.n < y.n JOIN embeddings a ON a.vec_id = x.n JOIN embeddings b ON b.vec_id = y.n GROUP BY x.cluster),
g AS (SELECT cluster, count(*) AS k, string_agg(n, ',' ORDER BY n) AS ids FROM c GROUP BY cluster),
t AS (SELECT (SELECT count(*) FROM embeddings) AS n, count(*) AS g, sum(k)::BIGINT AS held, (sum(k) - count(*))::BIGINT AS spare FROM g),
f AS (
SELECT 0 AS o, 0 AS p, 'summary' AS severity, printf('%d cases, %d near-duplicate cluster%s covering %d cases — about %d distinct scenarios (%.0f%% redundant)', n, g, CASE WHEN g = 1 THEN '' ELSE 's' END, held, n - spare, 100.0::DOUBLE * spare / n) AS message, '' AS ids FROM t
UNION ALL SELECT 1, cluster, 'warning', printf('%d near-identical cases (pairwise cosine %s)', k, CASE WHEN round(lo, 6) = round(hi, 6) THEN printf('%.2f', lo) ELSE printf('%.2f-%.2f', lo, hi) END), ids FROM g JOIN q USING (cluster))
""" + _NUMBERED)
def chk_duplicates(spark, sf):
    vectors = read(spark, sf, "embeddings").where("vec_id is not null and embedding is not null")
    cases = as_cases(vectors, "vec_id", F.concat(F.lit("case "), F.col("vec_id").cast("string")))
    return _found(spark, DuplicateCheck(threshold=0.4, vectors=vectors.select(F.col("vec_id").alias("id"), "embedding")).run(EvalSet(cases)))


@query(_VERDICTS + """, s AS (SELECT count(*) AS n, count(*) FILTER (WHERE stable) AS m, count(*) FILTER (WHERE NOT stable) AS u, count(*) FILTER (WHERE ceiling) AS c, count(*) FILTER (WHERE floor) AS z, count(*) FILTER (WHERE inverted) AS i,
  count(*) FILTER (WHERE ceiling OR floor) AS same FROM t),
l AS (SELECT string_agg(case_id, ',' ORDER BY case_id::BIGINT) FILTER (WHERE NOT stable) AS u_ids, string_agg(case_id, ',' ORDER BY case_id::BIGINT) FILTER (WHERE ceiling) AS c_ids,
  string_agg(case_id, ',' ORDER BY case_id::BIGINT) FILTER (WHERE floor) AS z_ids, string_agg(case_id, ',' ORDER BY case_id::BIGINT) FILTER (WHERE inverted) AS i_ids FROM t),
r AS (SELECT 100.0::DOUBLE * count(*) FILTER (WHERE passed AND model_ix = 0) / count(*) FILTER (WHERE model_ix = 0) AS weak, 100.0::DOUBLE * count(*) FILTER (WHERE passed AND model_ix = 2) / count(*) FILTER (WHERE model_ix = 2) AS strong FROM v),
f AS (
SELECT 0 AS o, 0 AS p, 'summary' AS severity, printf('%d cases x 3 models x 3 repeats: %d discriminate, %d do not (%.0f%%)', n, m - same, same, 100.0::DOUBLE * same / m) || CASE WHEN u > 0 THEN ', ' || u || ' not reproducible' ELSE '' END AS message, '' AS ids FROM s
UNION ALL SELECT 1, 0, 'warning', printf('%d of %d cases changed their verdict between 3 identical runs and are left out below; the other figures cover the %d reproducible cases', u, n, m), u_ids FROM s, l WHERE u > 0
UNION ALL SELECT 2, 0, 'warning', printf('%.0f%% of %scases (%d/%d) have one verdict for all models; this set discriminates like one of %d case%s', 100.0::DOUBLE * same / m, CASE WHEN u > 0 THEN 'measured ' ELSE '' END, same, m, m - same, CASE WHEN m - same = 1 THEN '' ELSE 's' END), '' FROM s WHERE same > 0.2 * m
UNION ALL SELECT 3, 0, 'info', printf('every model passes %d case%s, ''small'' too', c, CASE WHEN c = 1 THEN '' ELSE 's' END), c_ids FROM s, l WHERE c > 0
UNION ALL SELECT 4, 0, 'warning', printf('every model fails %d case%s, ''large'' too; look at the reference answer and the grader first', z, CASE WHEN z = 1 THEN '' ELSE 's' END), z_ids FROM s, l WHERE z > 0
UNION ALL SELECT 5, 0, 'warning', printf('in %d case%s a weaker model passed and a stronger one failed, which points at a wrong reference answer or grader', i, CASE WHEN i = 1 THEN '' ELSE 's' END), i_ids FROM s, l WHERE i > 0
UNION ALL SELECT 6, 0, 'warning', printf('''small'', given as the weakest, passed %.0f%% against %.0f%% for ''large'': the order or the scorer may be the wrong way round', weak, strong), '' FROM r WHERE weak > strong)
""" + _NUMBERED)
def chk_discrimination(spark, sf):
    docs = as_cases(read(spark, sf, "documents"), "doc_id", F.concat(F.lit("document "), F.col("doc_id").cast("string")))
    log = _verdicts(spark, sf).select("pos", "case_id", "model_ix", "model", "repeat", "score")
    return _found(spark, DiscriminationCheck(None, MODELS, repeats=3, max_non_discriminating_share=0.2).run(EvalSet(docs), log))


_ITEMS = "SELECT item_id::VARCHAR AS id, text AS input, length(text)::VARCHAR AS expected_text, 'l' || item_id % 3 AS label FROM benchmark WHERE text IS NOT NULL"


def _items(spark, sf):
    """The benchmark under the column names of other sets, to be mapped by their aliases."""
    rows = read(spark, sf, "benchmark").where("text is not null")
    return rows.select(F.col("item_id").cast("string").alias("uid"), F.col("text").alias("question"), F.length("text").cast("string").alias("answer"), F.concat(F.lit("l"), F.col("item_id") % 3).alias("category"), "item_id")


def _loaded(spark, path):
    return sources.load(spark, path, {"id": "uid"}).cases.select("id", "input", "expected_text", "label")


@query(_ITEMS)
def load_jsonl(spark, sf):
    path = runtime.scratch(spark, "items.jsonl")
    _items(spark, sf).drop("item_id").select(F.to_json(F.struct("*"))).write.text(path)
    return _loaded(spark, path)


@query(_ITEMS)
def load_json(spark, sf):
    """Documents of a thousand items each, a file each: a JSON file is one value."""
    path = runtime.scratch(spark, "items.json")
    items = _items(spark, sf).groupBy(F.floor(F.col("item_id") / 1000).alias("k")).agg(F.collect_list(F.struct("uid", "question", "answer", "category")).alias("cases"))
    items.select("k", F.to_json(F.struct("cases")).alias("value")).write.partitionBy("k").text(path)
    return _loaded(spark, path)


@query(_ITEMS)
def load_csv(spark, sf):
    path = runtime.scratch(spark, "items.csv")
    _items(spark, sf).drop("item_id").write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)
    return _loaded(spark, path)


@query(_ITEMS)
def load_parquet(spark, sf):
    path = runtime.scratch(spark, "items.parquet")
    _items(spark, sf).drop("item_id").write.parquet(path)
    return _loaded(spark, path)


@query(r"SELECT 'case_' || row_number() OVER (ORDER BY page_id) AS id, page_id, length(html) AS chars FROM pages WHERE regexp_matches(html, '\S')")
def ids_generated_wide(spark, sf):
    """Generated ids next to the whole pages they are for."""
    pages = read(spark, sf, "pages").where(~fn.is_blank("html")).select("page_id", F.col("html").alias("input"))
    cases = sources.from_dataframe(pages, order_by="page_id")[0].cases
    return cases.select("id", F.get_json_object("metadata", "$.page_id").cast("long").alias("page_id"), F.length("input").cast("long").alias("chars"))


@query("""SELECT event_type AS model, count(*) AS n_calls, count(DISTINCT user_id) FILTER (WHERE user_id % 2 = 1) AS n_misses
FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1""")
def resp_write_through(spark, sf):
    """Every event asks for its user and type; an earlier run has asked for the users of even number, the others are asked now."""
    path = runtime.scratch(spark, "log")
    asked = read(spark, sf, "events").where("user_id is not null and event_type is not null").select(fn.request_key(user=F.col("user_id"), type=F.col("event_type")).alias("key"), "user_id", "event_type")
    old = asked.where("user_id % 2 = 0").select("key", F.col("event_type").alias("model"), F.lit("old").alias("text"), F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("output_tokens"), F.lit(0).cast("long").alias("at"))
    responses.append(old.dropDuplicates(["key"]), path)
    new = lambda r: {"model": r["event_type"], "text": "new", "input_tokens": 1, "output_tokens": 1}
    got = responses.answered(asked, path, new, at=1)
    return got.groupBy("model").agg(F.count("*").alias("n_calls"), F.count_distinct(F.when(F.col("text") == "new", F.col("user_id"))).alias("n_misses"))


def _asks(spark, sf):
    """Two models and two repeats of each benchmark item."""
    models = F.explode(F.array(F.struct(F.lit(0).alias("model_ix"), F.lit("weak").alias("model")), F.struct(F.lit(1).alias("model_ix"), F.lit("strong").alias("model")))).alias("m")
    rows = read(spark, sf, "benchmark").where("text is not null").select(F.col("item_id").alias("case_id"), F.col("text").alias("input"), models)
    return rows.select("case_id", "input", "m.model_ix", "m.model", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))


_TRAIL = """WITH a AS (SELECT item_id AS case_id, m AS model_ix, r AS "repeat", item_id % 5 = 1 AND m = 1 AS unanswered, item_id % 3 = 0 AS unjudged, (length(text) + m * 7 + (CASE WHEN item_id % 4 = 0 THEN r ELSE 0 END)) % 2 = 0 AS y
  FROM benchmark, (SELECT unnest([0, 1]) AS m), (SELECT unnest([0, 1]) AS r) WHERE text IS NOT NULL),
c AS (SELECT case_id, model_ix, "repeat", NOT unanswered AS has_answer, CASE WHEN unanswered OR unjudged THEN NULL ELSE y END AS passed FROM a)
"""


def _trail(spark, sf):
    """Asks with answer and verdict from a log that lacks some: verdicts on every third item, the strong model's answers to every fifth."""
    asks = _asks(spark, sf)
    none, zero = F.lit(None).cast("double"), F.lit(0)
    answer = fn.answer_key("local", model=F.col("model"), system=F.lit("s"), input=F.col("input"), temperature=none, seed=zero, repeat=F.col("repeat"))
    judge = lambda a: fn.judge_key("local", judge_model=F.lit("j"), case=F.col("case_id"), system=F.lit("grade"), prompt=fn.prompt("{q}\n{a}", q=F.col("input"), a=a), temperature=none, seed=zero, repeat=F.col("repeat"))
    i, m, r = F.col("case_id"), F.col("model_ix"), F.col("repeat")
    given = asks.where(~((i % 5 == 1) & (m == 1))).withColumn("a", F.concat_ws(" ", "model", i.cast("string"), r.cast("string")))
    ok = (F.length("input") + m * 7 + F.when(i % 4 == 0, r).otherwise(0)) % 2 == 0
    answers = given.select(answer.alias("key"), F.col("a").alias("text"), F.lit(1).alias("at"))
    rulings = given.where(i % 3 != 0).select(judge(F.col("a")).alias("key"), F.when(ok, "<think>hm</think> PASS").otherwise("FAIL.").alias("text"), F.lit(1).alias("at"))
    return responses.chained(asks, answers.unionByName(rulings), answer, judge)


@query(_TRAIL + 'SELECT case_id, model_ix, "repeat", has_answer, passed FROM c')
def resp_verdict_chain(spark, sf):
    return _trail(spark, sf).select("case_id", "model_ix", "repeat", F.col("answer").isNotNull().alias("has_answer"), "passed")


@query(_TRAIL + """, g AS (SELECT case_id, string_agg(CASE WHEN passed THEN 'P' WHEN NOT passed THEN 'F' ELSE '.' END, '' ORDER BY "repeat") FILTER (WHERE model_ix = 0) AS weak,
  string_agg(CASE WHEN passed THEN 'P' WHEN NOT passed THEN 'F' ELSE '.' END, '' ORDER BY "repeat") FILTER (WHERE model_ix = 1) AS strong FROM c GROUP BY case_id),
s AS (SELECT *, contains(weak || strong, '.') AS missing, (weak[1] = 'P' AND strong[1] = 'F')::BIGINT + (weak[2] = 'P' AND strong[2] = 'F')::BIGINT AS k FROM g)
SELECT case_id, weak, strong, CASE WHEN missing THEN '-' ELSE k || '/2' END AS inverted, CASE WHEN missing THEN 'incomplete' WHEN weak IN ('PF', 'FP') OR strong IN ('PF', 'FP') THEN 'unstable' ELSE 'stable' END AS status,
  NOT missing AND weak = 'PP' AND strong = 'FF' AS always_inverted FROM s""")
def resp_stability_report(spark, sf):
    shown = F.coalesce(F.concat(F.col("n_inverted").cast("string"), F.lit("/2")), F.lit("-"))
    return responses.stability_report(_trail(spark, sf), 2).select("case_id", "weak", "strong", shown.alias("inverted"), "status", "always_inverted")


@query(_TRAIL + """SELECT case_id, model_ix, CASE WHEN NOT has_answer THEN 'no answer' WHEN passed IS NULL THEN 'no verdict' WHEN passed THEN 'PASS' ELSE 'FAIL' END AS outcome
FROM c WHERE "repeat" = 0 AND case_id IN (0, 1, 2, 3, 4, 5, 6, 11)""")
def resp_audit_trail(spark, sf):
    """The trail of cases asked for by name, which is the feature."""
    return responses.audit(_trail(spark, sf).where("repeat = 0"), [0, 1, 2, 3, 4, 5, 6, 11]).select("case_id", "model_ix", "outcome")


@query("""WITH t AS (SELECT count(DISTINCT user_id) AS n_measured, count(DISTINCT event_type) AS k,
  sum(CASE event_type WHEN 'view' THEN floor(value) * 1.0::DOUBLE + (event_id % 50) * 5.0::DOUBLE WHEN 'click' THEN floor(value) * 3.0::DOUBLE + (event_id % 50) * 15.0::DOUBLE ELSE 0 END) / 1e6 AS usd FROM events)
SELECT n_measured, round(usd / n_measured, 6) AS usd_per_case, k * 3000 AS n_calls, round(usd / n_measured * 3000, 6) AS usd FROM t""")
def resp_smoke_estimate(spark, sf):
    calls = read(spark, sf, "events").select(F.col("user_id").alias("case_id"), F.col("event_type").alias("model"), F.floor("value").alias("input_tokens"), (F.col("event_id") % 50).alias("output_tokens"))
    prices = spark.createDataFrame([("view", 1.0, 5.0), ("click", 3.0, 15.0)], "model string, input_rate double, output_rate double")
    got = responses.smoke_estimate(calls, prices, 1000, 3)
    return got.withColumns({"usd": F.round("usd", 6), "usd_per_case": F.round("usd_per_case", 6)})
