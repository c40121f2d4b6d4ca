"""Connected components of an edge table that never leaves the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from setaudit.llm.textcore import cut
from setaudit.operators.duplicates import forest  # noqa: F401


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b) but the roots; root is the smallest node.

    Alternates the large-star and small-star steps, which halve path lengths and keep each star's hub out of
    any single task's memory; lineage is cut by checkpoint() after every round. Nulls and self-loops are dropped.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u is not null and v is not null and u != v").distinct()
    e = cut(e)
    seen = None
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = F.least(F.col("u"), F.min("v").over(Window.partitionBy("u")))
        large = both.select("u", "v", m.alias("m")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(Window.partitionBy("u"))
        small = large.select("u", "v", m.alias("m"))
        pairs = F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
        e = cut(small.select(pairs.alias("p")).select("p.u", "p.v").where("u != v").distinct())
        state = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = state
