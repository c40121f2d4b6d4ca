"""Clusters that are larger than a tile: the same figures as from all pairs at once, and nothing as long as the pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from setaudit.operators import duplicates as dup


def table(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "pos long, vec array<double>")


def brute(x, threshold):
    """{smallest member: (members, least, largest cosine)} of the components, by plain loops."""
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(norm == 0, 1, norm)
    s, root = u @ u.T, list(range(len(x)))
    for _ in x:
        root = [min(root[j] for j in range(len(x)) if j == i or s[i, j] >= threshold) for i in range(len(x))]
    out = {}
    for c in set(root):
        m = [i for i in range(len(x)) if root[i] == c]
        if len(m) > 1:
            off = [s[i, j] for i in m for j in m if i < j]
            out[c] = (len(m), round(min(off), 9), round(max(off), 9))
    return out


@pytest.mark.parametrize("tile", [7, 30, 16_384])
def test_clusters_larger_than_a_tile(spark, tile):
    r = np.random.default_rng(3)
    x = np.concatenate([np.array([8, 0, 0, 0]) + r.standard_normal((60, 4)), np.array([0, 8, 0, 0]) + r.standard_normal((25, 4)), np.array([[0, 0, 1, 0], [0, 0, 0, 1], [0, 0, 0, 0], [0, 0, -1, 1e-3]])])
    v = table(spark, x)
    edges, most = dup.links(v, 0.95, tile)
    got = {q.cluster: (q.n_cases, round(q.min_sim, 9), round(q.max_sim, 9)) for q in dup.cluster_stats(dup.components(edges), v, tile).collect()}
    want = brute(x, 0.95)
    assert got == want and max(n for n, _, _ in got.values()) > 40
    assert most == pytest.approx(max(h for _, _, h in want.values()))


def test_like_vectors_are_not_listed_as_pairs(spark):
    v = table(spark, np.tile([[1.0, 2.0, 3.0]], (400, 1)) + np.random.default_rng(0).standard_normal((400, 3)) * 1e-3)
    assert dup.compare(v, 0.9)[0].count() == 400 * 399 // 2
    edges, most = dup.links(v, 0.9)
    assert edges.count() < 400 * 4 and most == pytest.approx(1)
    assert [tuple(r) for r in dup.components(edges).groupBy("cluster").count().collect()] == [(0, 400)]


def test_no_task_has_a_whole_large_cluster(spark):
    """Of a cluster of 300, a task's group has the rows of two tiles, not all."""
    v = table(spark, np.random.default_rng(1).standard_normal((300, 3)) * 1e-3 + 1)
    members = v.select("pos", F.lit(0).cast("long").alias("cluster"))
    plan = dup.spread_members(members, v, 50)
    sizes = [r["count"] for r in plan.groupBy("cluster", "i", "j").count().collect()]
    assert len(sizes) == 21 and max(sizes) < 150 and plan.where("self").count() == 300
