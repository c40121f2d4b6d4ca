"""Cases whose expected answer stands in their input."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.functions import normalised
from setaudit.model import Check, CheckResult, EvalSet, Finding, Severity

MIN_ANSWER_CHARS, WIDESPREAD_SHARE, NOTE_IDS = 12, 0.5, 20


def limitations(least: int) -> tuple[str, ...]:
    return (
        "A leak and a task whose answer belongs in the input (span selection, reading comprehension) look the same from here.",
        "Matching is literal after case and white space are levelled: paraphrases, synonyms and hints go unseen.",
        "Shared words are no signal: worked solutions repeat their question's words without any leak.",
        f"Answers under {least} characters are skipped, and answers from a small closed vocabulary stand the check down.",
        "Only 'input' and 'expected' are read.",
    )


def compared(cases: DataFrame, least: int = MIN_ANSWER_CHARS) -> DataFrame:
    """(pos, id, answer, answer_chars, short, contained) of every answered case."""
    rows = cases.where("expected_text is not null").select("pos", "id", normalised("expected_text").alias("answer"), normalised("input").alias("__in"))
    short = F.length("answer") < least
    return rows.select("pos", "id", "answer", F.length("answer").alias("answer_chars"), short.alias("short"), (~short & F.contains("__in", "answer")).alias("contained"))


def leak_stats(rows: DataFrame, widespread: float = WIDESPREAD_SHARE) -> DataFrame:
    """One row over ``compared``: a closed vocabulary has at least 20 answers of at most max(10, n // 20) forms."""
    # forms are counted over hashes of 256 bits, so whole answers aren't shuffled
    got = rows.agg(F.count("*").alias("n_with_expected"), F.countDistinct(F.sha2("answer", 256)).alias("n_distinct"), F.count_if("short").alias("n_short"), F.count_if("contained").alias("n_contained"))
    share = F.when(F.col("n_with_expected") > 0, F.col("n_contained") / F.col("n_with_expected")).otherwise(0.0)
    closed = (F.col("n_with_expected") >= 20) & (F.col("n_distinct") <= F.greatest(F.lit(10), F.floor(F.col("n_with_expected") / 20)))
    return got.withColumns({"closed": closed, "share": share, "widespread": share >= widespread})


class LeakageCheck(Check):
    name = "leakage"
    description = "Cases whose answer can be copied from their own input."

    def __init__(self, *, min_answer_chars: int = MIN_ANSWER_CHARS, widespread_share: float = WIDESPREAD_SHARE):
        if min_answer_chars < 1:
            raise ValueError("min_answer_chars must be 1 or more")
        if not 0 < widespread_share <= 1:
            raise ValueError("widespread_share must lie in (0, 1]")
        self.min_answer_chars, self.widespread_share = min_answer_chars, widespread_share

    def flagged(self, cases: DataFrame) -> DataFrame:
        """(pos, id, answer_chars) of every case that holds its answer."""
        return compared(cases, self.min_answer_chars).where("contained").select("pos", "id", "answer_chars")

    def run(self, eval_set: EvalSet) -> CheckResult:
        n, known = len(eval_set), limitations(self.min_answer_chars)
        row = leak_stats(compared(eval_set.cases, self.min_answer_chars), self.widespread_share).first()
        answered = row["n_with_expected"]
        stats = {"n_cases": n, "n_with_expected": answered, "n_skipped_short_answer": 0, "closed_vocabulary": False, "n_contained": 0, "contained_share": 0.0, "widespread": False, "min_answer_chars": self.min_answer_chars, "leaking_case_ids": []}
        if not answered:
            note = Finding(f"none of the {n} cases has an 'expected' value to look for in its input", Severity.INFO)
            return CheckResult(self.name, f"{n} cases, none with an 'expected' value — leakage cannot be assessed", (note,), stats, known)
        if row["closed"]:
            stats["closed_vocabulary"] = True
            note = Finding(f"the {answered} answers take {row['n_distinct']} forms, like class labels; one in its own input is chance, so none is reported", Severity.INFO)
            return CheckResult(self.name, f"{answered} answers drawn from {row['n_distinct']} distinct values — taken as class labels, leakage not assessed", (note,), stats, known)
        hits = self.flagged(eval_set.cases).orderBy("pos").collect() if row["n_contained"] else []
        share, k = row["share"], len(hits)
        stats |= {"n_skipped_short_answer": row["n_short"], "n_contained": k, "contained_share": share, "widespread": row["widespread"], "leaking_case_ids": [r["id"] for r in hits]}
        if row["widespread"]:
            found = [Finding(f"{share:.0%} of cases ({k}/{answered}) contain their own expected answer; so many suggest that the task is to find it there, so cases aren't reported one by one", Severity.INFO, tuple(r["id"] for r in hits[:NOTE_IDS]))]
        else:
            found = [Finding(f"the expected answer stands word for word in the input ({r['answer_chars']} characters): copying solves this case", case_ids=(r["id"],)) for r in hits]
        summary = f"{answered} answered cases, " + (f"{k} contain their own answer ({share:.0%})" if k else "none contain their own answer")
        if row["n_short"]:
            summary += f" — {row['n_short']} skipped as too short to judge"
        return CheckResult(self.name, summary, tuple(found), stats, known)
