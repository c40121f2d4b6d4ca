"""Near-duplicate cases: exact cosines between tiles of vectors, and the clusters they form."""

from __future__ import annotations

import importlib.util
import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit import runtime
from setaudit.functions import normalised
from setaudit.model import Check, CheckResult, EvalSet, Finding, MissingEmbeddingsError

Embedder = Callable[[Sequence[str]], np.ndarray]
THRESHOLD, TILE = 0.85, 16_384  # vectors of a tile at most; two tiles of 1,000 floats are 130 MB
BAND = 4_096  # vectors of the other tile that one block of cosines covers
MOST_PARTITIONS = 50_000  # of a shuffle; more pairs of tiles share them
LIMITATIONS = (
    "Likeness is the embedder's: texts it places apart are not found, whatever they mean.",
    "Clusters are transitive, so two members may be less alike than the threshold; the range is reported.",
    "The threshold suits short prose; code, formulas and templates may need another.",
    "All pairs are compared, exactly; time grows with the square of the number of distinct inputs.",
)
_PAIRS = "a long, b long, sim double"


def exact_groups(cases: DataFrame) -> DataFrame:
    """(first_pos, n_cases, n_raw) of each normalised input that several cases have; hashes travel, not texts."""
    keyed = cases.select("pos", F.sha2(normalised("input"), 256).alias("k"), F.sha2("input", 256).alias("raw"))
    groups = keyed.groupBy("k").agg(F.min("pos").alias("first_pos"), F.count("*").alias("n_cases"), F.countDistinct("raw").alias("n_raw"))
    return groups.where("n_cases > 1").drop("k")


def _unit(column: pd.Series) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    x = np.stack([np.asarray(v, np.float64) for v in column])
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm == 0, 1, norm)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for the edges a-b over nodes 0..n-1."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        lo, hi = np.minimum(la, lb), np.maximum(la, lb)
        differ = lo != hi
        if not differ.any():
            break
        a, b = a[differ], b[differ]
        np.minimum.at(label, hi[differ], lo[differ])
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _sides(t: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame, bool]:
    """The rows of a tile pair's two tiles, and whether they are one tile with itself. With one of two tiles empty, that side is."""
    if t["self"].iloc[0]:
        return t, t, True
    first = t["tile"] == t["i"]
    return t[first], t[~first], False


def _blocks(x: np.ndarray, y: np.ndarray, only: bool):
    """(first row, first column, cosines) of blocks of 1024 x 4096; only: x is y, and what isn't above the diagonal is NaN."""
    for at in range(0, len(x), 1024):
        for to in range(at if only else 0, len(y), BAND):
            s = x[at : at + 1024] @ y[to : to + BAND].T
            if only and to < at + len(s):  # each pair once, and no row with itself
                s[np.arange(to, to + s.shape[1])[None, :] <= np.arange(at, at + len(s))[:, None]] = np.nan
            yield at, to, s


def _reached(s: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    return np.divmod(np.flatnonzero(s >= threshold), s.shape[1])  # np.nonzero of a matrix takes five times as long


def _most(s: np.ndarray, most: float) -> float:
    return max(most, min(1.0, float(np.fmax.reduce(s, axis=None, initial=-1.0))))


def _tile_pair(threshold: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        """The pairs of one tile pair, and a row without ids that holds the largest cosine met."""
        rows, cols, only = _sides(t)
        x, y = _unit(rows["vec"]), _unit(cols["vec"])
        i, j = rows["pos"].to_numpy(), cols["pos"].to_numpy()
        most, out = 0.0, []
        for at, to, s in _blocks(x, y, only):
            p, q = _reached(s, threshold)
            most = _most(s, most)
            a, b = i[p + at], j[q + to]
            out.append(pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "sim": np.clip(s[p, q], -1, 1)}))
        out.append(pd.DataFrame({"a": [None], "b": [None], "sim": [most]}))
        got = pd.concat(out, ignore_index=True)
        return got.astype({"a": "Int64", "b": "Int64"})

    return run


def _tile_forest(threshold: float):
    def run(t: pd.DataFrame) -> pd.DataFrame:
        """As _tile_pair, but instead of the pairs at most one for each row, which join what all of them join."""
        rows, cols, only = _sides(t)
        x, y = _unit(rows["vec"]), _unit(cols["vec"])
        pos = rows["pos"].to_numpy() if only else np.concatenate([rows["pos"].to_numpy(), cols["pos"].to_numpy()])
        most, label, ea, eb, held = 0.0, np.arange(len(pos)), [], [], 0
        shift = 0 if only else len(x)
        for at, to, s in _blocks(x, y, only):
            most = _most(s, most)
            p, q = _reached(s, threshold)
            p, q = label[p + at], label[q + to + shift]
            new = p != q
            ea.append(p[new])
            eb.append(q[new])
            held += len(ea[-1])
            if held > 1 << 18:
                label = forest(len(pos), np.concatenate([*ea, np.arange(len(pos))]), np.concatenate([*eb, label]))
                ea, eb, held = [], [], 0
        label = forest(len(pos), np.concatenate([*ea, np.arange(len(pos))]), np.concatenate([*eb, label]))
        moved = np.flatnonzero(label != np.arange(len(pos)))
        a, b = pos[label[moved]], pos[moved]
        got = pd.DataFrame({"a": [*np.minimum(a, b), None], "b": [*np.maximum(a, b), None], "sim": [*np.full(len(a), np.nan), most]})
        return got.astype({"a": "Int64", "b": "Int64"})

    return run


def tiles_for(n: int, slots: int, tile: int = TILE) -> int:
    """So many tiles that their pairs keep every slot busy, and none is larger than ``tile`` rows; each row is sent to as many groups."""
    return max(1, -(-n // tile), min(math.isqrt(2 * slots) + 1, n // 256))


def _partitions(pairs: int) -> int:
    return min(max(1, pairs), MOST_PARTITIONS)


def _spread(placed: DataFrame, tiles, *by: str) -> DataFrame:
    """placed(pos, vec, tile) with each row once for every pair (i, j) of tiles that its own is one of, the pairs of tiles spread over as many partitions.

    tiles: how many there are, a number, or a column for each group of ``by``. A task has a pair or a few, however many rows there are.
    """
    n = F.lit(tiles) if isinstance(tiles, int) else F.col("tiles")
    other = F.explode(F.sequence(F.lit(0), n - 1)).alias("k")
    spread = placed.select("*", other).select(*by, "pos", "vec", "tile", F.least("tile", "k").alias("i"), F.greatest("tile", "k").alias("j"))
    return spread.withColumn("self", F.col("i") == F.col("j"))


def _met(vectors: DataFrame, kernel, tile: int) -> tuple[DataFrame, float]:
    spark = vectors.sparkSession
    runtime.send(spark)
    tiles = tiles_for(vectors.count(), spark.sparkContext.defaultParallelism, tile)
    placed = vectors.select("pos", "vec", F.pmod(F.xxhash64("pos"), F.lit(tiles)).cast("int").alias("tile"))
    spread = _spread(placed, tiles).repartition(_partitions(tiles * (tiles + 1) // 2), "i", "j")
    met = runtime.checkpoint(spread.groupBy("i", "j").applyInPandas(kernel, _PAIRS))
    most = met.where("a is null").agg(F.max("sim")).first()[0] or 0.0
    return met.where("a is not null"), most


def compare(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, float]:
    """((a, b, sim) of the pairs of vectors(pos, vec) at or above the threshold, largest cosine of any pair or 0).

    Rows are hashed into tiles and every pair of tiles is one task's group, so no side is broadcast and no matrix is
    larger than 1024 x 4096. A row travels once for each tile, n / 16,384 times. A zero vector is like nothing.
    """
    return _met(vectors, _tile_pair(threshold), tile)


def links(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> tuple[DataFrame, float]:
    """((a, b) of pairs at or above the threshold that join all that such pairs join, largest cosine of any pair or 0).

    The same comparisons as compare(); of the pairs each two tiles give a spanning forest, at most a row a vector, so
    clusters of many like vectors don't become all their pairs.
    """
    edges, most = _met(vectors, _tile_forest(threshold), tile)
    return edges.select("a", "b"), most


def components(edges: DataFrame) -> DataFrame:
    """(pos, cluster) of every node of edges(a, b); cluster is the smallest node that can be reached.

    Each round takes the least label among neighbours and then the label's own label, which doubles the reach;
    lineage is cut every round. It ends when no label has changed.
    """
    both = runtime.checkpoint(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = both.groupBy(F.col("a").alias("pos")).agg(F.least(F.min("b"), F.min("a")).alias("cluster"))
    labels = runtime.checkpoint(labels)
    while True:
        near = both.join(labels, both["b"] == labels["pos"]).groupBy("a").agg(F.min("cluster").alias("m"))
        new = labels.join(near, labels["pos"] == near["a"]).select("pos", F.least("cluster", "m").alias("cluster"), F.col("cluster").alias("old"))
        up = new.select(F.col("pos").alias("p2"), F.col("cluster").alias("c2"))
        new = new.join(up, new["cluster"] == up["p2"]).select("pos", F.least("cluster", "c2").alias("cluster"), "old")
        new = runtime.checkpoint(new)
        changed = new.where("cluster != old").limit(1).count()
        labels = new.select("pos", "cluster")
        if not changed:
            return labels


def _span(t: pd.DataFrame) -> pd.DataFrame:
    """Least and largest cosine of a cluster's tile pair, and the rows of its own tile."""
    rows, cols, only = _sides(t)
    x, y = _unit(rows["vec"]), _unit(cols["vec"])
    low, high = np.inf, -np.inf
    for _, _, s in _blocks(x, y, only):
        low, high = min(low, np.fmin.reduce(s, axis=None, initial=np.inf)), max(high, np.fmax.reduce(s, axis=None, initial=-np.inf))
    low, high = (float(np.clip(v, -1, 1)) if np.isfinite(v) else v for v in (low, high))  # infinite where there is no pair
    return pd.DataFrame({"cluster": [t["cluster"].iloc[0]], "n": [len(x) if only else 0], "low": [low], "high": [high]})


def spread_members(members: DataFrame, vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """(cluster, pos, vec, tile, i, j, self) of members: the pairs (i, j) of tiles that a cluster of more than ``tile`` members is hashed into; others are one tile."""
    spark = members.sparkSession
    rows = members.join(vectors, "pos").select("cluster", "pos", "vec")
    sizes = runtime.checkpoint(rows.groupBy("cluster").agg(F.count("*").alias("n")).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int")))
    work = sizes.agg(F.sum(F.when(F.col("tiles") > 1, F.expr("tiles * (tiles + 1L) / 2")).otherwise(F.pow(F.col("n") / tile, 2)))).first()[0] or 0
    large = sizes.where("tiles > 1").select("cluster", "tiles")  # one for each ``tile`` rows at most
    placed = rows.join(F.broadcast(large), "cluster", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    placed = placed.withColumn("tile", F.pmod(F.xxhash64("pos"), F.col("tiles")).cast("int"))
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return _spread(placed, None, "cluster").repartition(_partitions(usual + int(work)), "cluster", "i", "j")


def cluster_stats(members: DataFrame, vectors: DataFrame, tile: int = TILE) -> DataFrame:
    """(cluster, n_cases, min_sim, max_sim) over all pairs of members, edges or not.

    A cluster of more than ``tile`` members is compared as in compare(), each pair of its tiles by itself, so neither a task
    nor its memory grows with the cluster.
    """
    runtime.send(members.sparkSession)
    met = spread_members(members, vectors, tile).groupBy("cluster", "i", "j").applyInPandas(_span, "cluster long, n long, low double, high double")
    return met.groupBy("cluster").agg(F.sum("n").alias("n_cases"), F.min("low").alias("min_sim"), F.max("high").alias("max_sim"))


class DefaultEmbedder:
    """The named sentence-transformers model, loaded where it is first called in a process."""

    def __init__(self, name: str):
        if importlib.util.find_spec("sentence_transformers") is None:
            raise MissingEmbeddingsError("the duplicates check needs an embedder, a table of vectors, or sentence-transformers")
        self.name, self.model = name, None

    def __getstate__(self):
        return {"name": self.name, "model": None}

    def __call__(self, texts: Sequence[str]) -> np.ndarray:
        if self.model is None:
            from sentence_transformers import SentenceTransformer

            self.model = SentenceTransformer(self.name)
        return self.model.encode(list(texts), show_progress_bar=False)


class DuplicateCheck(Check):
    """``vectors`` is a table (id, embedding); or an ``embedder`` maps texts to vectors: all distinct texts at once on the
    driver (its vectors may depend on the whole set), or with per_batch=True on the executors. With neither, the default
    model, whose vectors depend on one text each, runs on the executors."""

    name = "duplicates"
    description = "Near-duplicate cases by the cosine of their embeddings."

    def __init__(self, *, threshold: float = THRESHOLD, embedder: Embedder | None = None, vectors: DataFrame | None = None, per_batch: bool = False, model_name: str = "all-MiniLM-L6-v2"):
        if not 0 < threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")
        self.threshold, self.embedder, self.vectors, self.per_batch, self.model_name = threshold, embedder, vectors, per_batch, model_name

    def embedded(self, firsts: DataFrame) -> DataFrame:
        """(pos, vec) of firsts(pos, id, input)."""
        spark = firsts.sparkSession
        if self.vectors is not None:
            return firsts.join(self.vectors.select(F.col("id").cast("string").alias("id"), F.col("embedding").alias("vec")), "id").select("pos", "vec")
        embedder = self.embedder or DefaultEmbedder(self.model_name)

        def vectors_of(texts: list[str]) -> list[list[float]]:
            x = np.asarray(embedder(texts), np.float32)
            if x.ndim != 2 or len(x) != len(texts):
                raise ValueError(f"an embedder must return one vector per text: ({len(texts)}, d), got {x.shape}")
            return x.tolist()

        if self.per_batch or self.embedder is None:
            runtime.send(spark)

            def run(batches):
                for b in batches:
                    yield pd.DataFrame({"pos": b["pos"], "vec": vectors_of(b["input"].tolist())})

            return runtime.checkpoint(firsts.select("pos", "input").mapInPandas(run, "pos long, vec array<float>"))
        rows = firsts.orderBy("pos").select("pos", "input").collect()
        return spark.createDataFrame(list(zip([r["pos"] for r in rows], vectors_of([r["input"] for r in rows]))), "pos long, vec array<float>")

    def run(self, eval_set: EvalSet) -> CheckResult:
        cases, n = eval_set.cases, len(eval_set)
        stats = {"n_cases": n, "threshold": self.threshold, "embedder": self.model_name if self.embedder is None and self.vectors is None else "custom", "n_clusters": 0, "n_cases_in_clusters": 0, "n_redundant_cases": 0, "effective_n_cases": n, "max_similarity": None, "clusters": []}
        if n < 2:
            return CheckResult(self.name, f"{n} case — nothing to compare", (), stats, LIMITATIONS)
        # equal inputs have equal vectors: only the first of each is compared, and the others are edges to it
        keyed = cases.withColumn("__k", F.sha2("input", 256))
        firsts = keyed.groupBy("__k").agg(F.min_by(F.struct("pos", "id", "input"), "pos").alias("c")).select("__k", "c.*")
        vec = self.embedded(firsts.drop("__k"))
        pairs, most = links(vec, self.threshold)
        copies = keyed.select(F.col("pos").alias("b"), "__k").join(firsts.select(F.col("pos").alias("a"), "__k"), "__k").where("a < b").select("a", "b")
        members = components(pairs.union(copies))
        all_vec = keyed.select("pos", "__k").join(firsts.select("__k", F.col("pos").alias("__f")), "__k").join(vec.withColumnRenamed("pos", "__f"), "__f").select("pos", "vec")
        spans = {r["cluster"]: r for r in cluster_stats(members, all_vec).collect()}
        groups: dict[int, list] = {}
        for r in members.join(cases.select("pos", "id", F.sha2(normalised("input"), 256).alias("text")), "pos").orderBy("cluster", "pos").collect():
            groups.setdefault(r["cluster"], []).append(r)
        found, shown = [], []
        for c, rows in groups.items():
            low, high = spans[c]["min_sim"], spans[c]["max_sim"]
            most = max(most, high)
            names = tuple(r["id"] for r in rows)
            shown.append({"case_ids": list(names), "min_similarity": round(low, 4), "max_similarity": round(high, 4)})
            if len({r["text"] for r in rows}) == 1:
                found.append(Finding(f"{len(names)} cases have identical input text", case_ids=names))
            else:
                span = f"{low:.2f}" if round(low, 6) == round(high, 6) else f"{low:.2f}-{high:.2f}"
                found.append(Finding(f"{len(names)} near-identical cases (pairwise cosine {span})", case_ids=names))
        held = sum(map(len, groups.values()))
        spare = held - len(groups)
        stats |= {"n_clusters": len(groups), "n_cases_in_clusters": held, "n_redundant_cases": spare, "effective_n_cases": n - spare, "max_similarity": round(max(0.0, most), 4), "clusters": shown}
        if groups:
            summary = f"{n} cases, {len(groups)} near-duplicate cluster{'' if len(groups) == 1 else 's'} covering {held} cases — about {n - spare} distinct scenarios ({spare / n:.0%} redundant)"
        else:
            summary = f"{n} cases, no near-duplicates above cosine {self.threshold:.2f}"
        return CheckResult(self.name, summary, tuple(found), stats, LIMITATIONS)
