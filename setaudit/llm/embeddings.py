"""Embedding near-duplicates: p-stable hashing for Euclidean distance, then exact cosines."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.graph import components, forest

THRESHOLD = 0.85
RECALL = 0.95
WIDTH = 2.0  # of a quantised projection, in units of the normalised vectors
BUCKET = 2_048  # unrelated vectors that share a bucket on average; comparing them is a matrix product, sending a vector to more tables isn't as cheap
GROUP_ROWS = 8_000
MOST_ROWS = 16_384  # of a bucket that one task compares; larger ones go in blocks of about so many
MOST_BROADCAST = 200_000  # rows of 16 bytes that name large buckets; more of them are joined by shuffle
SEED = 20240229


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that one quantised Gaussian projection is equal for two points at this distance."""
    if distance <= 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def parameters(n: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """(projections of a table, tables): buckets hold BUCKET unrelated vectors or so at any n, and a pair just at
    the threshold shares a bucket with probability ``recall``."""
    near, far = collision(math.sqrt(max(0.0, 2 - 2 * threshold))), collision(math.sqrt(2))
    k = max(1, math.ceil(math.log(max(n, BUCKET) / BUCKET) / -math.log(far)))
    hit = near**k
    return k, 1 if hit >= recall else math.ceil(math.log(1 - recall) / math.log(1 - hit))


@lru_cache(maxsize=4)
def _drawn(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [np.random.default_rng([SEED, dim, k, t]) for t in range(tables)]
    a, b = zip(*[(r.standard_normal((dim, k)), r.uniform(0, WIDTH, k)) for r in parts])
    return np.concatenate(a, axis=1), np.concatenate(b), np.random.default_rng([SEED, k]).integers(1, 1 << 62, k, dtype=np.uint64) | np.uint64(1)


def projections(dim: int, k: int, tables: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(directions, offsets, multipliers) of the first ``tables`` tables; table t has the same ones however many are asked for."""
    a, b, mult = _drawn(dim, k, -(-tables // 64) * 64)
    return a[:, : tables * k], b[: tables * k], mult


def keys_of(x: np.ndarray, k: int, tables: int) -> np.ndarray:
    """(n, tables) bucket hashes of unit vectors."""
    a, b, mult = projections(x.shape[1], k, tables)
    cell = np.floor((x @ a + b) / WIDTH).astype(np.int64).reshape(len(x), tables, k).view(np.uint64)
    with np.errstate(over="ignore"):
        return (tc.mix((cell * mult).sum(axis=2, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def _by_size(col: pa.Array):
    """(rows, unit vectors) for each length of vector in the column."""
    size = col.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    begin = np.cumsum(size) - size
    for dim in np.unique(size[size > 0]):
        at = np.flatnonzero(size == dim)
        x = flat[begin[at][:, None] + np.arange(dim)]
        norm = np.sqrt((x * x).sum(axis=1))
        good = np.isfinite(norm) & (norm > 0)
        yield at[good], x[good] / norm[good, None]


def _hashed(k: int, tables: int, vectors: bool):
    """A row for each vector and table: (tab, key, node, weight, vec); vectors=False: (tab, key) alone."""

    def run(batches):
        for batch in batches:
            node, weight = batch.column("node").to_numpy(), batch.column("weight").to_numpy()
            for at, x in _by_size(batch.column("embedding")):
                for i in range(0, len(x), 512):
                    part = x[i : i + 512]
                    key = keys_of(part, k, tables).T.ravel().astype(np.int64)
                    columns = {"tab": np.repeat(np.arange(tables, dtype=np.int32), len(part)), "key": key}
                    if vectors:
                        own, vec = at[i : i + 512], np.array([v.tobytes() for v in part.astype(np.float32)], dtype=object)
                        columns |= {"node": np.tile(node[own], tables), "weight": np.tile(weight[own], tables), "vec": pa.array(np.tile(vec, tables), pa.binary())}
                    yield pa.RecordBatch.from_pydict(columns)

    return run


def _met(rows: np.ndarray, cols: np.ndarray, x: np.ndarray, table: int, k: int, threshold: float, same: bool):
    """Pairs (p, q) of rows and cols whose cosine reaches the threshold and that share no earlier table's bucket; each pair once."""
    for i in range(0, len(rows), 1024):
        a = rows[i : i + 1024]
        for j in range(i if same else 0, len(cols), 4096):
            b = cols[j : j + 4096]
            p, q = np.nonzero(x[a] @ x[b].T >= threshold - 1e-4)
            if same:
                keep = p + i < q + j
                p, q = p[keep], q[keep]
            if not len(p):
                continue
            p, q = a[p], b[q]
            for c in range(0, len(p), 1 << 18):
                u, v = p[c : c + (1 << 18)], q[c : c + (1 << 18)]
                y, z = x[u].astype(np.float64), x[v].astype(np.float64)
                ok = (y * z).sum(axis=1) / np.sqrt((y * y).sum(axis=1) * (z * z).sum(axis=1)) >= threshold
                u, v = u[ok], v[ok]
                if table and len(u):  # keys of the earlier tables, from the vectors themselves: they needn't travel
                    some, at = np.unique(np.concatenate([u, v]), return_inverse=True)
                    sig = keys_of(x[some].astype(np.float64), k, table)
                    met = np.zeros(len(u), bool)
                    for t in range(table):
                        met |= sig[at[: len(u)], t] == sig[at[len(u) :], t]
                    u, v = u[~met], v[~met]
                yield u, v


def bucket_links(table: int, key: np.ndarray, side: np.ndarray, node: np.ndarray, weight: np.ndarray, x: np.ndarray, k: int, threshold: float):
    """(links by row, edges a, edges b) of a group of buckets: for each row the weight of the rows it is first met by in this
    table, and edges that join what the links join, each row with the smallest node of its component.

    Rows of one bucket that are all of side 0 meet one another; where there are both sides, those of side 0 meet those of side 1.
    """
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
    links, label = np.zeros(len(key), np.int64), np.arange(len(key))
    ea, eb, held = [], [], 0
    for a, b in zip(cuts[:-1], cuts[1:]):
        if b - a < 2:
            continue
        own = order[a:b]
        rows, cols = own[side[own] == 0], own[side[own] == 1]
        for u, v in _met(rows, cols if len(cols) else rows, x, table, k, threshold, not len(cols)):
            np.add.at(links, u, weight[v])
            np.add.at(links, v, weight[u])
            ea.append(u)
            eb.append(v)
            held += len(u)
            if held > 1 << 20:  # flat memory where thousands of near copies form millions of pairs
                label = forest(len(key), np.concatenate([*ea, np.arange(len(key))]), np.concatenate([*eb, label]))
                ea, eb, held = [], [], 0
    label = forest(len(key), np.concatenate([*ea, np.arange(len(key))]), np.concatenate([*eb, label]))
    moved = np.flatnonzero(label != np.arange(len(key)))
    return links, node[moved], node[label[moved]]


_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def _group(k: int, threshold: float):
    def run(t: pa.Table) -> pa.Table:
        size = np.array([len(v) for v in t.column("vec").to_pylist()])
        got = [[], [], []]
        for dim in np.unique(size):
            s = t.filter(pa.array(size == dim))
            x = np.frombuffer(b"".join(s.column("vec").to_pylist()), np.float32).reshape(len(s), -1)
            node = s.column("node").to_numpy()
            links, a, b = bucket_links(s.column("tab")[0].as_py(), s.column("key").to_numpy(), s.column("side").to_numpy(), node, s.column("weight").to_numpy(), x, k, threshold)
            some = np.flatnonzero(links)
            for into, c in zip(got, ([node[some], a], [np.full(len(some), -1), b], [links[some], np.zeros(len(a), np.int64)])):
                into += c
        return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in got], schema=_MET)

    return run


def embedding_classes(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, most: int = MOST_ROWS) -> DataFrame:
    """(vec_id, class_id, links) of every vector: links counts the others whose cosine is at or above the threshold, and
    class_id is the smallest vec_id that such links lead to, its own where it has none.

    Equal vectors are taken together first: one of them is hashed, with their number as its weight. Normalised vectors are
    hashed into several tables, each by quantised Gaussian projections, and the members of each bucket are compared by
    exact cosines, a pair in the first table whose bucket it shares. A bucket gives a count for each member and
    a spanning forest, so what it hands on is as long as the bucket, not its square; a bucket of more than ``most`` members is
    compared in blocks, a task for each two of them, without any cap. Numbers of projections and tables follow from the row
    count and the threshold, such that a pair at the threshold is met with probability ``recall`` and closer ones more surely.

    Null vectors, those with a null, NaN or infinite entry and zero vectors aren't returned; vectors are compared with those of
    their own length. Rows without vec_id take no part and repeated rows count once; several vectors of one vec_id are
    vectors of their own, each with a row. An empty table gives no rows; other columns aren't read.
    """
    spark = vectors.sparkSession
    tc.ship(spark)
    x = F.col("embedding").cast("array<double>")
    base = vectors.select(tc.long_id("vec_id").alias("vec_id"), x.alias("embedding")).where("vec_id is not null and embedding is not null")
    fine = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    base = base.where(F.forall("embedding", fine) & F.exists("embedding", lambda v: v != 0))
    hashed = base.select("vec_id", F.xxhash64("embedding").alias("h0"), F.xxhash64(F.lit(1), "embedding", F.size("embedding")).alias("h1"), "embedding")
    whole = hashed.groupBy("h0", "h1").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("weight"), F.first("embedding").alias("embedding"))
    nodes = tc.table(whole.withColumn("node", F.monotonically_increasing_id()), "vectors")  # written, so numbers stay as they are
    n = nodes.count()
    k, tables = parameters(n, threshold, recall)
    source = nodes.select("node", "weight", "embedding")
    keys = source.mapInArrow(_hashed(k, tables, False), "tab int, key long").groupBy("tab", "key").count().where(F.col("count") > most)
    hot = tc.cut(keys.select("tab", "key", F.ceil(F.col("count") / most).cast("int").alias("blocks")))
    n_hot = hot.count()
    rows = source.mapInArrow(_hashed(k, tables, True), "tab int, key long, node long, weight long, vec binary")
    if n_hot:
        rows = rows.join(F.broadcast(hot) if n_hot <= MOST_BROADCAST else hot, ["tab", "key"], "left")
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        rows = rows.select("*", F.coalesce(block, F.lit(0)).alias("own")).select("*", other.alias("to"))
        rows = rows.select("tab", "key", "node", "weight", "vec", "blocks", F.least("own", "to").alias("i"), F.greatest("own", "to").alias("j"), F.when(F.col("own") > F.col("to"), 1).otherwise(0).alias("side"))
    else:
        rows = rows.select("*", F.lit(None).cast("int").alias("blocks"), F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("side"))
    groups = max(1, n // GROUP_ROWS)
    part = F.when(F.col("blocks").isNull(), F.pmod("key", F.lit(groups))).otherwise(F.col("key") + (1 << 33))
    met = rows.withColumn("part", part).drop("blocks").groupBy("tab", "part", "i", "j").applyInArrow(_group(k, threshold), "a long, b long, n long")
    met = tc.table(met, "links")
    roots = components(met.where("b >= 0"), "a", "b")
    counts = met.where("b < 0").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    named = nodes.select("node", "rep", "weight", "h0", "h1").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("rep").alias("class_id"))
    classes = named.join(least, "root").select("h0", "h1", "class_id", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("links"))
    return hashed.select("vec_id", "h0", "h1").distinct().join(classes, ["h0", "h1"]).select("vec_id", "class_id", "links")
