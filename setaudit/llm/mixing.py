"""Mixing sources to target weights with soft domain membership."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.llm import textcore as tc
from setaudit.llm.quality import MOST_LABELLED, fit_model

DOMAINS = ("q1t0", "q1t1", "q0t0", "q0t1")  # quality and toxicity, as the labelled table has them
TARGETS = {"q1t0": 0.85, "q1t1": 0.05, "q0t0": 0.08, "q0t1": 0.02}  # shares of all tokens
ROUNDS = 25
ENOUGH = 1e-7
RIDGES = 10.0 ** np.arange(-9, 1)  # of the whitened steps that a round tries, as parts of the Gram matrix's trace
PARTS = (1.0, 0.25)  # of each of them
PLAIN = 4.0 ** np.arange(8)  # lengths of the gradient steps that a round tries; the shortest always lowers the loss

_POST = ", ".join(f"p_{d} double" for d in DOMAINS)


def _posteriors(model):
    def run(batches):
        for batch in batches:
            quality, toxic, words = model.value.score(batch.column("text"))
            p = np.stack([quality * (1 - toxic), quality * toxic, (1 - quality) * (1 - toxic), (1 - quality) * toxic], axis=1)
            p[words == 0] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(words), *(pa.array(p[:, k]) for k in range(len(DOMAINS)))], names=["doc_id", "source", "tokens", *(f"p_{d}" for d in DOMAINS)])

    return run


def rates_of(p: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after these projected steps from rate 1; p: (n, domains) posteriors."""
    r = np.ones(len(p))
    for v in steps:
        r = np.maximum(0.0, r - p @ v)
    return r


def _posterior(batch) -> np.ndarray:
    return np.stack([batch.column(f"p_{d}").to_numpy(zero_copy_only=False) for d in DOMAINS], axis=1)


def tried(gram: np.ndarray, residual: np.ndarray, steepest: float) -> np.ndarray:
    """(steps, domains) that a round tries: none, whitened ones from nearly pure to heavily ridged, and plain gradient steps."""
    n = len(residual)
    white = [part * np.linalg.pinv(gram + ridge * np.trace(gram) * np.eye(n)) @ residual for ridge in RIDGES for part in PARTS]
    return np.stack([np.zeros(n), *white, *(PLAIN[:, None] * residual / max(steepest, 1e-300))])


def _totals(total: float, steps: list[np.ndarray], tries: np.ndarray):
    def run(batches):
        out = np.zeros((len(tries), len(DOMAINS) * (1 + len(DOMAINS))))
        for batch in batches:
            p = _posterior(batch)
            a = p * (batch.column("tokens").to_numpy(zero_copy_only=False) / total)[:, None]
            r = np.maximum(0.0, rates_of(p, steps)[:, None] - p @ tries.T)
            out += np.concatenate([r.T @ a, (r > 0).T.astype(float) @ (a[:, :, None] * p[:, None, :]).reshape(len(p), -1)], axis=1)
        yield pa.RecordBatch.from_arrays([pa.array([out.ravel().tolist()], pa.list_(pa.float64()))], names=["v"])

    return run


def _final(steps: list[np.ndarray]):
    def run(batches):
        for batch in batches:
            r = rates_of(_posterior(batch), steps)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    return run


def mixing_rates(docs: DataFrame, labelled: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, source, tokens, p_<domain>..., rate) of every row of docs.

    A classifier fitted on the labelled table gives every document its posterior over the four domains (its
    quality and toxicity heads are taken as independent). The rates r >= 0, by which documents are to be
    repeated or thinned, solve a least-squares problem over all documents: the expected tokens of each domain,
    the sum of r * tokens * posterior, are to be the target's share of all tokens. Projected gradient starts at
    rate 1, scaled by 1/tokens (so a document's length doesn't set its rate) and whitened by the Gram matrix of
    the documents whose rate isn't 0. A whitened step may overshoot where rates are cut at 0, so each round tries
    steps of several lengths and ridges, plain gradient steps among them, and takes the one of the least loss, which
    is never more than the round's before. Each round is one aggregation of twenty numbers a step tried over the table
    of posteriors, and a document's rate follows from the steps taken alone.

    Tokens are words. A document without words has posteriors 0 and rate 1. Repeated rows count each for itself,
    null ids and sources stay, an empty table gives no rows, and other columns aren't read. Targets that the
    documents can't reach are met as nearly as nonnegative rates allow.
    """
    spark = docs.sparkSession
    goal = targets or TARGETS
    s = np.array([goal.get(d, 0.0) for d in DOMAINS])
    model = spark.sparkContext.broadcast(fit_model(labelled, labels, most))
    post = docs.select(tc.long_id().alias("doc_id"), "text", F.col("source").cast("string").alias("source"))
    schema = f"doc_id long, source string, tokens long, {_POST}"
    post = tc.table(post.mapInArrow(_posteriors(model), schema), "posteriors")
    total = float(post.agg(F.sum("tokens")).first()[0] or 0)
    steps: list[np.ndarray] = []
    tries, steepest = np.zeros((1, len(s))), None
    for _ in range(ROUNDS if total else 0):
        got = np.sum([r["v"] for r in post.mapInArrow(_totals(total, steps, tries), "v array<double>").collect()], axis=0).reshape(len(tries), -1)
        residuals = got[:, : len(s)] - s
        best = int((residuals**2).sum(axis=1).argmin())
        if tries[best].any():
            steps.append(tries[best])
        elif steepest is not None:  # no step lowers the loss
            break
        residual, gram = residuals[best], got[best, len(s) :].reshape(len(s), len(s))
        if np.abs(residual).max() < ENOUGH:
            break
        steepest = np.linalg.eigvalsh(gram)[-1] if steepest is None else steepest  # of all documents, since each starts at rate 1
        tries = tried(gram, residual, steepest)
    return post.mapInArrow(_final(steps), f"{schema}, rate double")
