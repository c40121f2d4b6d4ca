"""Imbalance, leakage, duplicates and mapping over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from setaudit import sources
from setaudit.mapping import resolve_mapping
from setaudit.model import repeated_ids
from setaudit.operators import duplicates as dup
from setaudit.operators import imbalance as imb
from setaudit.operators import leakage as leak

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def as_cases(df: DataFrame, key: str, text, expected=None, label=None) -> DataFrame:
    none = F.lit(None).cast("string")
    one = lambda c: none if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(F.col(key).cast("long").alias("pos"), F.col(key).cast("string").alias("id"), one(text).alias("input"), one(expected).alias("expected_text"), one(label).alias("label"))


@query("""SELECT lang AS label, count(*) AS n_cases, round(count(*)::DOUBLE / sum(count(*)) OVER (), 6) AS share
FROM documents WHERE lang IS NOT NULL GROUP BY lang""")
def imb_class_counts(spark, sf):
    counts = imb.class_counts(as_cases(read(spark, sf, "documents"), "doc_id", "text", label="lang"))
    return counts.select("label", "n_cases", F.round("share", 6).alias("share"))


_EXTREMES = """WITH c AS (SELECT 'lang' AS field, lang AS label, count(*) AS n, min(doc_id) AS f FROM documents WHERE lang IS NOT NULL GROUP BY lang
  UNION ALL SELECT 'source', source, count(*), min(doc_id) FROM documents WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT *, row_number() OVER (PARTITION BY field ORDER BY n DESC, f) AS a, row_number() OVER (PARTITION BY field ORDER BY n, f DESC) AS z FROM c)
SELECT field, count(*) AS n_classes, max(label) FILTER (WHERE a = 1) AS largest, max(n) AS largest_n, max(label) FILTER (WHERE z = 1) AS smallest, min(n) AS smallest_n,
  round(max(n)::DOUBLE / min(n), 6) AS ratio FROM r GROUP BY field"""


@query(_EXTREMES)
def imb_ratio_extremes(spark, sf):
    docs = read(spark, sf, "documents")
    one = lambda c: imb.extremes(imb.class_counts(as_cases(docs, "doc_id", "text", label=c))).select(F.lit(c).alias("field"), "*")
    return one("lang").unionByName(one("source")).withColumn("ratio", F.round("ratio", 6))


@query("""WITH c AS (SELECT lang, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share FROM documents WHERE lang IS NOT NULL GROUP BY lang)
SELECT lang AS label, n AS n_cases, share < 0.12 AS low_share, n < 5 AS low_count, doc_id::VARCHAR AS id FROM c JOIN documents USING (lang) WHERE share < 0.12 OR n < 5""")
def imb_rare_classes(spark, sf):
    cases = as_cases(read(spark, sf, "documents"), "doc_id", "text", label="lang")
    return imb.rare_cases(cases, imb.rare_classes(imb.class_counts(cases), 0.12, 5)).select("label", "n_cases", "low_share", "low_count", "id")


@query("""SELECT count(*) AS n_cases, count(quality) AS n_labelled, count(*) - count(quality) AS n_unlabelled, count(*) FILTER (WHERE toxic IS NULL) AS n_missing_expected
FROM documents LEFT JOIN labels USING (doc_id)""")
def imb_missing_fields(spark, sf):
    cases = as_cases(read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id", "left"), "doc_id", "text", "toxic", "quality")
    stats = imb.set_stats(cases)
    return stats.select("n_cases", "n_labelled", (F.col("n_cases") - F.col("n_labelled")).alias("n_unlabelled"), "n_missing_expected")


@query("SELECT min(length(text)) AS min_chars, median(length(text)) AS median_chars, round(avg(length(text)), 6) AS mean_chars, max(length(text)) AS max_chars FROM documents")
def imb_length_stats(spark, sf):
    row = imb.set_stats(as_cases(read(spark, sf, "documents"), "doc_id", "text"))
    return row.select(F.col("min_chars").cast("long").alias("min_chars"), "median_chars", F.round("mean_chars", 6).alias("mean_chars"), F.col("max_chars").cast("long").alias("max_chars"))


@query("""SELECT t AS "table", sum(n)::BIGINT AS n_cases, count(*) AS n_classes, round(max(n)::DOUBLE / min(n), 6) AS ratio FROM (
  SELECT 'orders' AS t, o_orderpriority AS label, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'part', p_type, count(*) FROM part WHERE p_type IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'lineitem', l_returnflag, count(*) FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 2) GROUP BY t""")
def imb_summary_wide(spark, sf):
    out = None
    for table, key, label in (("orders", "o_orderkey", "o_orderpriority"), ("part", "p_partkey", "p_type"), ("lineitem", "l_orderkey", "l_returnflag")):
        counts = imb.class_counts(as_cases(read(spark, sf, table), key, label, label=label))
        row = counts.agg(F.sum("n_cases").alias("n_cases"), F.count("*").alias("n_classes"), F.round(F.max("n_cases") / F.min("n_cases"), 6).alias("ratio")).select(F.lit(table).alias("table"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_NORM = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_PLANTED = "CASE WHEN doc_id % 10 = 0 THEN translate(substr(text, 5, 40), 'aeiou', 'AEIOU') ELSE reverse(substr(text, 1, 40)) END"


def _leak_sql(expected: str) -> str:
    return f"""WITH n AS (SELECT doc_id, {_NORM.format(expected)} AS answer, {_NORM.format('text')} AS prompt FROM documents WHERE {expected} IS NOT NULL),
k AS (SELECT doc_id, answer, length(answer) AS answer_chars, length(answer) < 12 AS short, length(answer) >= 12 AND contains(prompt, answer) AS contained FROM n),
t AS (SELECT count(*) AS n_with_expected, count(DISTINCT answer) AS n_distinct, count(*) FILTER (WHERE short) AS n_short, count(*) FILTER (WHERE contained) AS n_contained FROM k),
s AS (SELECT *, n_with_expected >= 20 AND n_distinct <= greatest(10, n_with_expected // 20) AS closed, n_contained::DOUBLE / n_with_expected AS share, n_contained::DOUBLE / n_with_expected >= 0.5 AS widespread FROM t)
"""


def _planted(spark, sf):
    docs = read(spark, sf, "documents")
    expected = F.when(F.col("doc_id") % 10 == 0, F.translate(F.substring("text", 5, 40), "aeiou", "AEIOU")).otherwise(F.reverse(F.substring("text", 1, 40)))
    return as_cases(docs, "doc_id", "text", expected)


_STATS = "SELECT n_with_expected, n_distinct, n_short, n_contained, closed, round(share, 6) AS share, widespread FROM s"


@query(_leak_sql(_PLANTED) + "SELECT doc_id::VARCHAR AS id, answer_chars::BIGINT AS answer_chars FROM k WHERE contained")
def leak_cases(spark, sf):
    return leak.LeakageCheck().flagged(_planted(spark, sf)).select("id", F.col("answer_chars").cast("long").alias("answer_chars"))


@query(_leak_sql(_PLANTED) + _STATS)
def leak_stats(spark, sf):
    return leak.leak_stats(leak.compared(_planted(spark, sf))).withColumn("share", F.round("share", 6))


@query(_leak_sql("lang") + _STATS)
def leak_closed_vocab(spark, sf):
    return leak.leak_stats(leak.compared(as_cases(read(spark, sf, "documents"), "doc_id", "text", "lang"))).withColumn("share", F.round("share", 6))


@query(_leak_sql("substr(text, 1, 60)") + """, f AS (SELECT doc_id FROM k WHERE contained ORDER BY doc_id LIMIT 20)
SELECT n_contained, round(share, 6) AS share, widespread, (SELECT string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FROM f) AS first_ids FROM s""")
def leak_widespread(spark, sf):
    rows = leak.compared(as_cases(read(spark, sf, "documents"), "doc_id", "text", F.substring("text", 1, 60)))
    first = rows.where("contained").select("pos", "id").orderBy("pos").limit(leak.NOTE_IDS)
    note = first.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id"))), lambda x: x["id"]), ",").alias("first_ids"))
    return leak.leak_stats(rows).crossJoin(F.broadcast(note)).select("n_contained", F.round("share", 6).alias("share"), "widespread", "first_ids")  # one row each


@query(f"""WITH t AS (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
k AS (SELECT {_NORM.format('answer')} AS a, {_NORM.format('text')} AS q FROM t WHERE role = 'user' AND next_role = 'assistant' AND answer IS NOT NULL)
SELECT count(*) AS n_with_expected, count(*) FILTER (WHERE length(a) < 12) AS n_short, count(*) FILTER (WHERE length(a) >= 12 AND contains(q, a)) AS n_contained FROM k""")
def leak_conversations(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf, "conversations").withColumns({"next_role": F.lead("role").over(w), "answer": F.lead("text").over(w)}).where("role = 'user' and next_role = 'assistant'")
    return leak.leak_stats(leak.compared(as_cases(rows, "conv_id", "text", "answer"))).select("n_with_expected", "n_short", "n_contained")


@query(f"""SELECT min(doc_id) AS first_pos, count(*) AS n_cases, count(DISTINCT text) AS n_raw FROM documents WHERE text IS NOT NULL GROUP BY {_NORM.format('text')} HAVING count(*) > 1""")
def dup_exact_groups(spark, sf):
    return dup.exact_groups(as_cases(read(spark, sf, "documents").where("text is not null"), "doc_id", "text"))


def _vectors(spark, sf):
    return read(spark, sf, "embeddings").where("vec_id is not null and embedding is not null").select(F.col("vec_id").alias("pos"), F.col("embedding").alias("vec"))


_SIM = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
_EDGES = f"SELECT a.vec_id AS a, b.vec_id AS b, {_SIM} AS sim FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id"
_CLUSTERS = f"""WITH RECURSIVE e AS (SELECT a, b FROM ({_EDGES}) WHERE sim >= 0.4), both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT a AS n, a AS m FROM both_ways UNION SELECT r.n, w.b FROM reach r JOIN both_ways w ON r.m = w.a), c AS (SELECT n, min(m) AS cluster FROM reach GROUP BY n)
"""


@query(f"SELECT a, b, round(sim, 4) AS sim FROM ({_EDGES}) WHERE sim >= 0.35")
def dup_pairs(spark, sf):
    return dup.compare(_vectors(spark, sf), 0.35)[0].withColumn("sim", F.round("sim", 4))


@query(_CLUSTERS + "SELECT n AS vec_id, cluster FROM c")
def dup_clusters(spark, sf):
    return dup.components(dup.links(_vectors(spark, sf), 0.4)[0]).withColumnRenamed("pos", "vec_id")


@query(_CLUSTERS + f"""SELECT x.cluster AS cluster, (SELECT count(*) FROM c z WHERE z.cluster = x.cluster) AS n_cases, round(min({_SIM}), 4) AS min_sim, round(max({_SIM}), 4) AS max_sim
FROM c x JOIN c y ON x.cluster = y.cluster AND x.n < y.n JOIN embeddings a ON a.vec_id = x.n JOIN embeddings b ON b.vec_id = y.n GROUP BY x.cluster""")
def dup_cluster_stats(spark, sf):
    vectors = _vectors(spark, sf)
    stats = dup.cluster_stats(dup.components(dup.links(vectors, 0.4)[0]), vectors)
    return stats.select("cluster", "n_cases", F.round("min_sim", 4).alias("min_sim"), F.round("max_sim", 4).alias("max_sim"))


@query(f"SELECT (SELECT count(*) FROM embeddings) AS n_cases, count(*) FILTER (WHERE sim >= 0.85) AS n_pairs, round(greatest(0, max(sim)), 4) AS max_similarity FROM ({_EDGES})")
def dup_none_at_default(spark, sf):
    vectors = _vectors(spark, sf)
    pairs, most = dup.compare(vectors)
    return vectors.agg(F.count("*").alias("n_cases")).crossJoin(pairs.agg(F.count("*").alias("n_pairs"))).withColumn("max_similarity", F.round(F.lit(float(most)), 4))


@query("SELECT item_id::VARCHAR AS id, text AS input FROM benchmark")
def map_projection(spark, sf):
    table = read(spark, sf, "benchmark")
    return sources.project(table, resolve_mapping(table.columns, {"id": "item_id"})).select("id", "input")


@query("SELECT 'case_' || row_number() OVER (ORDER BY page_id) AS id, page_id FROM pages")
def ids_generated(spark, sf):
    pages = read(spark, sf, "pages").select("page_id", F.col("html").alias("input"))
    cases, _ = sources.from_dataframe(pages, order_by="page_id", check=False)
    return cases.cases.select("id", F.get_json_object("metadata", "$.page_id").cast("long").alias("page_id"))


@query("SELECT conv_id::VARCHAR AS id, count(*) AS n_cases FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def ids_duplicate(spark, sf):
    return repeated_ids(read(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("id")))
