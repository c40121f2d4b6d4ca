"""Whether findings fail a build."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setaudit.model import CheckResult

NEVER, WARNING, ANY = FAIL_ON = ("never", "warning", "any")
OK, TRIPPED, USAGE, BROKEN = range(4)


def tripped(results: Sequence[CheckResult], fail_on: str) -> bool:
    if fail_on == NEVER:
        return False
    return any(r.findings if fail_on == ANY else r.has_warnings for r in results)


def exit_code(results: Sequence[CheckResult], fail_on: str, incomplete: bool = False) -> int:
    """A check that couldn't run weighs more than any gate."""
    return BROKEN if incomplete else TRIPPED if tripped(results, fail_on) else OK


def decided(findings: DataFrame) -> DataFrame:
    """(run, n_findings, n_warnings, fail_on, incomplete, exit_code) of findings(run, severity) for every setting."""
    n = findings.groupBy("run").agg(F.count("severity").alias("n_findings"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    every = n.select("*", F.explode(F.array(*map(F.lit, FAIL_ON))).alias("fail_on")).select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("incomplete"))
    trip = ((F.col("fail_on") == WARNING) & (F.col("n_warnings") > 0)) | ((F.col("fail_on") == ANY) & (F.col("n_findings") > 0))
    return every.withColumn("exit_code", F.when(F.col("incomplete"), BROKEN).when(trip, TRIPPED).otherwise(OK))
