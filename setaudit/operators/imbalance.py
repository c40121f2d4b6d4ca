"""Class histogram, imbalance and basic statistics of a set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.model import Check, CheckResult, EvalSet, Finding, Severity

LIMITATIONS = (
    "An uneven distribution isn't a wrong one: only the traffic you expect can tell what the shares should be.",
    "Only 'label' is read. Categories that sit in metadata, or in the text itself, go unseen.",
    "Thresholds are conventions: reasons to look, not statistical tests.",
    "Lengths are in characters, a rough stand-in for tokens.",
)


def class_counts(cases: DataFrame) -> DataFrame:
    """(label, n_cases, first_pos, share) of each class; share is of the labelled cases."""
    counts = cases.where("label is not null").groupBy("label").agg(F.count("*").alias("n_cases"), F.min("pos").alias("first_pos"))
    total = counts.agg(F.sum("n_cases").alias("__total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n_cases", "first_pos", (F.col("n_cases") / F.col("__total")).alias("share"))  # total: one row


def extremes(counts: DataFrame) -> DataFrame:
    """One row: n_classes, the largest and smallest class, ratio. Of equal classes the first seen is the largest, the last seen the smallest."""
    key = F.struct("n_cases", -F.col("first_pos"))
    return counts.agg(
        F.count("*").alias("n_classes"),
        F.max_by("label", key).alias("largest"), F.max("n_cases").alias("largest_n"),
        F.min_by("label", key).alias("smallest"), F.min("n_cases").alias("smallest_n"),
        (F.max("n_cases") / F.min("n_cases")).alias("ratio"),
    )


def rare_classes(counts: DataFrame, min_share: float, min_count: int) -> DataFrame:
    """The classes below either threshold, with what tripped."""
    flagged = counts.withColumns({"low_share": F.col("share") < min_share, "low_count": F.col("n_cases") < min_count})
    return flagged.where("low_share or low_count")


def rare_cases(cases: DataFrame, rare: DataFrame) -> DataFrame:
    """Each case of a rare class, with the class's row; the planner picks the join by the size of ``rare``."""
    return cases.select("pos", "id", "label").join(rare, "label")


def set_stats(cases: DataFrame) -> DataFrame:
    """One row of counts and input lengths."""
    n = F.length("input")
    return cases.agg(
        F.count("*").alias("n_cases"), F.count("label").alias("n_labelled"), F.count_if(F.col("expected_text").isNull()).alias("n_missing_expected"),
        F.min(n).alias("min_chars"), F.median(n).alias("median_chars"), F.avg(n).alias("mean_chars"), F.max(n).alias("max_chars"),
    )


def ids(rows: DataFrame) -> tuple[str, ...]:
    return tuple(r["id"] for r in rows.orderBy("pos").select("id").collect())


class ImbalanceCheck(Check):
    name = "imbalance"
    description = "How cases are spread over classes, with basic statistics."

    def __init__(self, *, min_class_share: float = 0.10, min_class_count: int = 5, max_imbalance_ratio: float = 3.0):
        if not 0 < min_class_share < 1:
            raise ValueError("min_class_share must lie between 0 and 1")
        if min_class_count < 1:
            raise ValueError("min_class_count must be 1 or more")
        if max_imbalance_ratio < 1:
            raise ValueError("max_imbalance_ratio must be 1 or more")
        self.min_class_share, self.min_class_count, self.max_imbalance_ratio = min_class_share, min_class_count, max_imbalance_ratio

    def flagged(self, cases: DataFrame) -> DataFrame:
        """(label, pos, id, ...) of every case in a rare class, for sets whose ids don't fit the driver."""
        return rare_cases(cases, rare_classes(class_counts(cases), self.min_class_share, self.min_class_count))

    def run(self, eval_set: EvalSet) -> CheckResult:
        cases = eval_set.cases
        row = set_stats(cases).first()
        counts = class_counts(cases).orderBy(F.desc("n_cases"), "first_pos").collect()
        n, labelled = row["n_cases"], row["n_labelled"]
        found = []
        if 0 < labelled < n:
            found.append(Finding(f"{n - labelled} of {n} cases have no label; shares cover the {labelled} labelled ones", case_ids=ids(cases.where("label is null"))))
        if row["n_missing_expected"]:
            found.append(Finding(f"{row['n_missing_expected']} of {n} cases have no 'expected' value and can't be scored automatically", case_ids=ids(cases.where("expected_text is null"))))
        stats = {
            "n_cases": n, "n_labelled": labelled, "n_unlabelled": n - labelled, "n_classes": len(counts),
            "class_counts": {r["label"]: r["n_cases"] for r in counts}, "class_shares": {r["label"]: r["share"] for r in counts}, "imbalance_ratio": None,
            "input_length_chars": {"min": row["min_chars"], "median": row["median_chars"], "mean": round(row["mean_chars"], 1), "max": row["max_chars"]},
        }
        if not counts:
            found.append(Finding(f"none of the {n} cases has a label, so class balance can't be assessed", Severity.INFO))
            return CheckResult(self.name, f"{n} cases, no labels — class balance not assessed", tuple(found), stats, LIMITATIONS)
        top, low = counts[0], counts[-1]
        ratio = stats["imbalance_ratio"] = top["n_cases"] / low["n_cases"]
        if len(counts) == 1:
            found.append(Finding(f"all labelled cases are of class '{top['label']}': one scenario is all that is measured", Severity.INFO))
        elif ratio > self.max_imbalance_ratio:
            found.append(Finding(f"class imbalance ratio is {ratio:.1f}:1 — '{top['label']}' has {top['n_cases']} cases, '{low['label']}' {low['n_cases']}; the average is mostly '{top['label']}'"))
        rare = [r for r in counts if r["share"] < self.min_class_share or r["n_cases"] < self.min_class_count]
        members: dict[str, list[str]] = {}
        for r in self.flagged(cases).orderBy("pos").select("label", "id").collect() if rare else ():
            members.setdefault(r["label"], []).append(r["id"])
        for r in rare:
            why, k = [], r["n_cases"]
            if r["share"] < self.min_class_share:
                why.append(f"{r['share']:.1%} of labelled cases (below {self.min_class_share:.0%})")
            if k < self.min_class_count:
                why.append(f"only {k} case{'' if k == 1 else 's'}, so its accuracy has {k + 1} distinct values")
            found.append(Finding(f"class '{r['label']}' is under-represented: {'; '.join(why)}", case_ids=tuple(members[r["label"]])))
        return CheckResult(self.name, f"{n} cases across {len(counts)} classes, imbalance ratio {ratio:.1f}:1", tuple(found), stats, LIMITATIONS)
