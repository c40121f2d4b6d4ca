"""The queries of this subpackage, each over its whole table, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setaudit.llm import textcore as tc


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.substring import repeated_passages

    return repeated_passages(tc.read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.decontaminate import contaminated

    return contaminated(tc.read(spark, sf_dir, "documents"), tc.read(spark, sf_dir, "benchmark"))


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.embeddings import embedding_classes

    return embedding_classes(tc.read(spark, sf_dir, "embeddings"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.lm import lm_scores

    return lm_scores(tc.read(spark, sf_dir, "documents"))


def op5_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.simhash import simhash_groups

    return simhash_groups(tc.read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.mixing import mixing_rates

    docs = tc.read(spark, sf_dir, "documents")
    return mixing_rates(docs, docs, tc.read(spark, sf_dir, "labels"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.edits import edited_counts, standard_edits

    return edited_counts(standard_edits(tc.read(spark, sf_dir, "documents")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.chat import chat_format

    return chat_format(tc.read(spark, sf_dir, "conversations"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.quality import quality_scores

    return quality_scores(tc.read(spark, sf_dir, "documents"), tc.read(spark, sf_dir, "labels"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from setaudit.llm.licenses import license_scan

    return license_scan(tc.read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_decontamination, op3_embedding_dedup, op4_lm_scores, op5_simhash_dedup, op6_mixing, op7_token_counts, op8_chat_format, op9_quality, op10_licenses, pipeline)}

ORACLES = {
    # every 50 words of a document, those that two documents hold, and their unions
    "op1_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda x: x <> '') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), spans AS (
  SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 50], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(0, len(w) - 49)) AS i FROM words WHERE len(w) >= 50)
), shared AS (
  SELECT h FROM spans GROUP BY h HAVING min(doc_id) < max(doc_id)
), hits AS (
  SELECT DISTINCT doc_id, i FROM spans JOIN shared USING (h)
), marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) < 50 THEN 0 ELSE 1 END AS fresh FROM hits
), numbered AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM marked
)
SELECT doc_id, CAST(min(i) AS INTEGER) AS start_word, CAST(max(i) + 50 AS INTEGER) AS end_word FROM numbered GROUP BY doc_id, part""",
    "op3_embedding_dedup": """
WITH RECURSIVE e AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON (a.vec_id <> b.vec_id OR a.v <> b.v) AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.85
), reach AS (
  SELECT vec_id AS n, vec_id AS m FROM e UNION SELECT r.n, p.b FROM reach r JOIN p ON r.m = p.a
), c AS (SELECT n, min(m) AS class_id FROM reach GROUP BY n)
SELECT e.vec_id, c.class_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS links FROM e JOIN c ON c.n = e.vec_id""",
    "op8_chat_format": r"""
SELECT conv_id, count(*) AS turns, count(*) FILTER (WHERE contains(text, '<|end|>' || chr(10))) AS escaped,
  string_agg('<|turn|>' || coalesce(role, '~') || CASE WHEN text IS NULL THEN '!n' WHEN contains(text, '<|end|>' || chr(10)) THEN '!e' ELSE '' END || chr(10) ||
    CASE WHEN text IS NULL THEN '' WHEN contains(text, '<|end|>' || chr(10)) THEN regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') ELSE text END || '<|end|>' || chr(10),
    '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS rendered
FROM (SELECT *, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone FROM conversations) GROUP BY conv_id, alone""",
}
