"""Which cases tell a weak model from a strong one."""

from __future__ import annotations

import random
from collections.abc import Callable, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit import runtime
from setaudit.functions import passes
from setaudit.model import CASES, Check, CheckResult, EvalCase, EvalSet, Finding, ScorerError, Severity

Scorer = Callable[[EvalCase, Any], "bool | float"]
LIMITATIONS = (
    "Models must be given weakest first; a wrong order turns every inversion around.",
    "The scorer is trusted: a faulty grader looks like a faulty case.",
    "Cases that all models pass may be deliberate regression guards.",
    "Two models of one family often fail together, which hides differences.",
)
ONCE = "One run cannot tell a verdict from chance: with repeats=1 unstable cases go unseen."


def tasks(cases: DataFrame, models: Sequence[str], repeats: int) -> DataFrame:
    """Every case with every model (model_ix, model) and repeat; models and repeats are literals, so nothing is joined."""
    named = F.array(*[F.struct(F.lit(i).alias("model_ix"), F.lit(m).alias("model")) for i, m in enumerate(models)])
    rows = cases.select("*", F.explode(named).alias("__m")).select("*", "__m.model_ix", "__m.model").drop("__m")
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))


def judged(scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """scores with ``passed``: a score from a bool (is_bool) passes as it is, others at the threshold."""
    score = F.col("score")
    return scores.withColumn("passed", F.when(F.col("is_bool"), score == 1.0).otherwise(passes(score, threshold)) if "is_bool" in scores.columns else passes(score, threshold))


def stability(verdicts: DataFrame) -> DataFrame:
    """(case_id, model_ix, n_repeats, n_passed, unanimous) of each case and model."""
    rows = verdicts.groupBy("case_id", "model_ix").agg(F.count("*").alias("n_repeats"), F.count_if("passed").alias("n_passed"))
    return rows.withColumn("unanimous", (F.col("n_passed") == 0) | (F.col("n_passed") == F.col("n_repeats")))


def taxonomy(verdicts: DataFrame, n_models: int) -> DataFrame:
    """(case_id, stable, ceiling, floor, inverted) of each case, by one aggregation on the case."""
    of = lambda k, c: F.count_if((F.col("model_ix") == k) & c)
    yes, no = F.col("passed"), ~F.col("passed")
    stable = F.lit(True)
    for k in range(n_models):
        stable = stable & ((of(k, yes) == 0) | (of(k, no) == 0))
    up, down = F.min(F.when(yes, F.col("model_ix"))), F.max(F.when(no, F.col("model_ix")))
    rows = verdicts.groupBy("case_id").agg(stable.alias("stable"), F.bool_and("passed").alias("__all"), F.bool_or("passed").alias("__any"), F.coalesce(up < down, F.lit(False)).alias("__inv"))
    s = F.col("stable")
    return rows.select("case_id", "stable", (s & F.col("__all")).alias("ceiling"), (s & ~F.col("__any")).alias("floor"), (s & F.col("__inv")).alias("inverted"))


def totals(kinds: DataFrame) -> DataFrame:
    """One row of counts over ``taxonomy``; the share is of the measured cases."""
    same = F.count_if(F.col("ceiling") | F.col("floor"))
    n = F.count_if("stable")
    return kinds.agg(
        F.count("*").alias("n_cases"), n.alias("n_measured"), F.count_if(~F.col("stable")).alias("n_unstable"),
        F.count_if("ceiling").alias("n_ceiling"), F.count_if("floor").alias("n_floor"), F.count_if("inverted").alias("n_inverted"),
        same.alias("n_same"), F.when(n > 0, same / n).otherwise(0.0).alias("same_share"),
    )


def pass_rates(verdicts: DataFrame) -> DataFrame:
    """(model_ix, model, n_calls, pass_rate) over every call, those of unstable cases included."""
    return verdicts.groupBy("model_ix", "model").agg(F.count("*").alias("n_calls"), (F.count_if("passed") / F.count("*")).alias("pass_rate"))


def drawn(cases: DataFrame, n: int, k: int | None, seed: int = 0) -> DataFrame:
    """k of the n cases numbered 1..n by pos: the same for one seed however the table is partitioned."""
    if k is None or k >= n:
        return cases
    picks = [(i + 1,) for i in sorted(random.Random(seed).sample(range(n), k))]
    return cases.join(cases.sparkSession.createDataFrame(picks, "__pick long"), F.col("pos") == F.col("__pick"), "left_semi")


def _verdict(raw: Any) -> tuple[float, bool] | None:
    """(score, whether it was a bool); None for what isn't a verdict. numpy's scalars and arrays without dimensions count as their value."""
    plain = raw.tolist() if isinstance(raw, (np.generic, np.ndarray)) else raw
    match plain:
        case bool():
            return float(plain), True
        case int() | float():
            return float(plain), False
    return None


def scored(rows: DataFrame, scorer: Scorer, models: Sequence[Any]) -> DataFrame:
    """tasks with score, is_bool and error, by the scorer on the executors; a failed call has an error and no score."""
    runtime.send(rows.sparkSession)
    by_ix = tuple(models)

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                score, flag, error = None, None, None
                try:
                    clean = {k: (None if isinstance(v, float) and v != v else v) for k, v in r.items()}
                    raw = scorer(EvalCase.of(clean), by_ix[r["model_ix"]])
                    got = _verdict(raw)
                    if got is None:
                        error = f"scorer returned {type(raw).__name__} for case '{r['id']}' with model '{r['model']}': expected bool or float"
                    else:
                        score, flag = got
                except Exception as e:  # noqa: BLE001 - reported with its place by the driver
                    error = f"scorer raised on case '{r['id']}' with model '{r['model']}': {e}"
                out.append((r["pos"], r["id"], r["model_ix"], r["model"], r["repeat"], score, flag, error))
            yield pd.DataFrame(out, columns=["pos", "case_id", "model_ix", "model", "repeat", "score", "is_bool", "error"])

    return rows.mapInPandas(run, "pos long, case_id string, model_ix int, model string, repeat int, score double, is_bool boolean, error string")


def counted(n: int) -> str:
    return f"{n} case" + "s" * (n != 1)


class DiscriminationCheck(Check):
    """``scorer(case, model)`` runs on the executors, max_workers calls at once (None: as many as the session has slots); models are given weakest first."""

    name = "discrimination"
    description = "Cases whose verdict is the same for weak and strong models."

    def __init__(self, scorer: Scorer | None, models: Sequence[Any], *, pass_threshold: float = 0.5, max_non_discriminating_share: float = 0.5, repeats: int = 1, max_workers: int | None = None, sample: int | None = None, sample_seed: int = 0):
        names = [str(m) for m in models]
        if len(names) < 2:
            raise ValueError(f"two models or more are needed, got {len(names)}")
        if len(set(names)) != len(names):
            raise ValueError(f"models need distinct names, got {names}")
        if not 0 < max_non_discriminating_share <= 1:
            raise ValueError("max_non_discriminating_share must lie in (0, 1]")
        for what, value in (("repeats", repeats), ("max_workers", max_workers), ("sample", sample)):
            if value is not None and value < 1:
                raise ValueError(f"{what} must be 1 or more, got {value}")
        self.scorer, self.models, self.names = scorer, tuple(models), names
        self.pass_threshold, self.most_same, self.repeats, self.max_workers, self.sample, self.sample_seed = pass_threshold, max_non_discriminating_share, repeats, max_workers, sample, sample_seed

    def run(self, eval_set: EvalSet, verdicts: DataFrame | None = None) -> CheckResult:
        """``verdicts``: a log (pos, case_id, model_ix, model, repeat, score[, is_bool]) in place of a scorer."""
        whole = len(eval_set)
        cases = drawn(eval_set.cases, whole, self.sample, self.sample_seed)
        n = min(whole, self.sample or whole)
        if verdicts is None:
            workers = self.max_workers or cases.sparkSession.sparkContext.defaultParallelism
            rows = tasks(cases.select(*[c.split()[0] for c in CASES.split(", ")]), self.names, self.repeats).repartition(workers)
            calls = runtime.checkpoint(scored(rows, self.scorer, self.models))
            wrong = calls.where("error is not null").orderBy("pos", "model_ix", "repeat").first()
            if wrong:
                raise ScorerError(wrong["error"])
            verdicts = calls
        else:
            verdicts = verdicts.join(cases.select("pos"), "pos", "left_semi")
        return self.judge(judged(verdicts, self.pass_threshold), n, whole)

    def judge(self, verdicts: DataFrame, n: int, whole: int) -> CheckResult:
        place = verdicts.groupBy("case_id").agg(F.min("pos").alias("pos"))
        kinds = runtime.checkpoint(taxonomy(verdicts, len(self.names)).join(place, "case_id"))
        t = totals(kinds).first()
        of = lambda c: [r["case_id"] for r in kinds.where(c).orderBy("pos").select("case_id").collect()]
        unstable, ceiling, floor, inverted = of("not stable"), of("ceiling"), of("floor"), of("inverted")
        rates = {r["model_ix"]: r["pass_rate"] for r in pass_rates(verdicts).collect()}
        rate = {m: rates.get(i, 0.0) for i, m in enumerate(self.names)}
        measured, same, share, sampled = t["n_measured"], t["n_same"], t["same_share"], n < whole
        stats = {
            "n_cases": n, "n_cases_in_set": whole, "sampled": sampled, "sample_seed": self.sample_seed if sampled else None, "models": list(self.names), "repeats": self.repeats, "max_workers": self.max_workers,
            "n_scorer_calls": n * len(self.names) * self.repeats, "pass_threshold": self.pass_threshold, "n_measured": measured, "n_unstable": len(unstable), "n_discriminating": measured - same, "n_non_discriminating": same,
            "non_discriminating_share": share, "effective_n_cases": measured - same, "n_ceiling": len(ceiling), "n_floor": len(floor), "n_inverted": len(inverted), "per_model_pass_rate": rate,
            "ceiling_case_ids": ceiling, "floor_case_ids": floor, "inverted_case_ids": inverted, "unstable_case_ids": unstable,
        }
        found = []
        if unstable:
            found.append(Finding(f"{len(unstable)} of {n} cases changed their verdict between {self.repeats} identical runs and are left out below; the other figures cover the {measured} reproducible cases", case_ids=tuple(unstable)))
        if share > self.most_same:
            scope = "measured cases" if unstable else "cases"
            found.append(Finding(f"{share:.0%} of {scope} ({same}/{measured}) have one verdict for all models; this set discriminates like one of {counted(measured - same)}"))
        if ceiling:
            found.append(Finding(f"every model passes {counted(len(ceiling))}, '{self.names[0]}' too", Severity.INFO, tuple(ceiling)))
        if floor:
            found.append(Finding(f"every model fails {counted(len(floor))}, '{self.names[-1]}' too; look at the reference answer and the grader first", case_ids=tuple(floor)))
        if inverted:
            found.append(Finding(f"in {counted(len(inverted))} a weaker model passed and a stronger one failed, which points at a wrong reference answer or grader", case_ids=tuple(inverted)))
        weak, strong = rate[self.names[0]], rate[self.names[-1]]
        if weak > strong:
            found.append(Finding(f"'{self.names[0]}', given as the weakest, passed {weak:.0%} against {strong:.0%} for '{self.names[-1]}': the order or the scorer may be the wrong way round"))
        if measured and same == measured:
            found.append(Finding(f"no {'measured ' if unstable else ''}case separated these models", Severity.INFO))
        if not measured:
            found.append(Finding("no case had a reproducible verdict, so nothing was measured", Severity.INFO))
        head = f"SAMPLE of {n} of {whole} cases" if sampled else f"{n} cases"
        summary = f"{head} x {len(self.names)} models" + (f" x {self.repeats} repeats" if self.repeats > 1 else "") + f": {measured - same} discriminate, {same} do not ({share:.0%})" + (f", {len(unstable)} not reproducible" if unstable else "")
        known = LIMITATIONS + ((ONCE,) if self.repeats == 1 else ())
        if sampled:
            known = (f"Only {n} of {whole} cases were scored (random sample, seed {self.sample_seed}); a case that wasn't drawn isn't judged.", *known)
        return CheckResult(self.name, summary, tuple(found), stats, known)
