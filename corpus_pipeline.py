"""From documents to a training mix: each stage takes what its predecessor kept and returns the columns of documents.

The last stage returns the mixing table instead. ORACLE_SQL is None: a trained classifier, SimHash components, edit
distances and fitted rates aren't SQL; tests/llm holds run() against brute-force versions of its stages.

What each stage gives for odd rows is in the docstring of the operator that it calls. In all of them columns besides
doc_id, text, source and n_chars are carried along under whatever name, and an empty table stays one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from setaudit.llm import textcore as tc
from setaudit.llm.decontaminate import without_contaminated
from setaudit.llm.mixing import mixing_rates
from setaudit.llm.quality import quality_stage
from setaudit.llm.simhash import without_near_duplicates
from setaudit.llm.substring import without_repeats


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, as do those without a word: null, empty or punctuation only.

    Each row is judged by itself, whole text and all: repeated rows stay or go together, rows without doc_id are judged too.
    """
    return quality_stage(docs, tc.read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays, of the smallest doc_id; repeated rows are near-duplicates.

    Texts that share a doc_id are judged apart. Rows without doc_id, text or words stay.
    """
    return without_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of the smallest doc_id and are cut from all others.

    A document of which nothing is left goes; texts that share a doc_id are cut apart. Rows without doc_id or text stay.
    """
    return without_repeats(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds a benchmark item, edits allowed for, go.

    Each row is judged by its own text, with or without doc_id. Rows without text stay.
    """
    return without_contaminated(docs, tc.read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixing table, a row for each row; the classifier is fitted on the labelled rows of the documents table itself.

    Rows without words have posteriors 0 and rate 1; repeated rows and null ids stay.
    """
    return mixing_rates(docs, tc.read(spark, sf_dir, "documents"), tc.read(spark, sf_dir, "labels"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("benchmark", benchmark), ("mix", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tc.read(spark, sf_dir, "documents")
    for n, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if n == len(STAGES) - 1:
            return out
        out = tc.table(out, f"stage-{name}")
        tc.drop(docs)
        docs = out
