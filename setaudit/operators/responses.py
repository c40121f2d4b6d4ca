"""Logs of model responses: lookups with write-through, verdict chains, costs and per-case stability.

A log has one row a response: key, model, text, input_tokens, output_tokens and ``at``, which orders writes (a time or a
batch number). Of several rows for a key the one with the largest ``at`` counts; of those the last by its text.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from setaudit import runtime
from setaudit.functions import verdict

LOG = "key string, model string, text string, input_tokens long, output_tokens long, at long"


def opened(spark: SparkSession, path: str) -> DataFrame:
    """The log stored at path; an empty one where nothing has been written yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(LOG).parquet(path) if there else spark.createDataFrame([], LOG)


def newest(log: DataFrame, order: str = "at") -> DataFrame:
    """One row a key, the one written last."""
    row = F.struct(*log.columns)
    return log.where("key is not null").groupBy("key").agg(F.max_by(row, F.struct(order, F.to_json(row))).alias("__row")).select("__row.*")


def replayed(requests: DataFrame, log: DataFrame, order: str = "at") -> tuple[DataFrame, DataFrame]:
    """(requests with their newest response, requests that the log lacks, each key once).

    Which row stands for several requests of one missing key is settled by their columns, so a second run asks the same.
    A request without key is asked for each time, as null equals nothing.
    """
    hits = requests.join(newest(log, order), "key")
    misses = requests.join(log.select("key").distinct(), "key", "left_anti")
    row = F.struct(*misses.columns)
    once = misses.where("key is not null").groupBy("key").agg(F.min_by(row, F.to_json(row)).alias("__row")).select("__row.*")
    return hits, once.unionByName(misses.where("key is null"))


def append(log: DataFrame, path: str) -> None:
    """Write responses through to the log, one set of files a batch."""
    log.select(*[c.split()[0] for c in LOG.split(", ")]).write.mode("append").parquet(path)


def answered(requests: DataFrame, path: str, call: Callable[[dict], Mapping], at: int) -> DataFrame:
    """requests(key, ...) with their responses, from the log at path or else by ``call`` on the executors.

    call gets a request as a dict and returns model, text, input_tokens and output_tokens. Responses are written to the
    log by the tasks that paid for them, before anything is joined: what one run has asked for, no later run asks again.
    ``at`` is the number of this run, larger than those before.
    """
    spark = requests.sparkSession
    runtime.send(spark)
    _, misses = replayed(requests, opened(spark, path))

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_dict("records"):
                got = call(r)
                out.append((r["key"], got["model"], got["text"], got["input_tokens"], got["output_tokens"], at))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in LOG.split(", ")])

    append(misses.mapInPandas(run, LOG), path)
    return requests.join(newest(opened(spark, path)), "key", "left")


def costs(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n_calls, input_tokens, output_tokens, usd) of calls(model, input_tokens, output_tokens) by prices a million tokens; unknown models cost 0.

    Calls are summed up first, so that the price table meets one row a model.
    """
    total = calls.groupBy("model").agg(F.count("*").alias("n_calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"))
    usd = (F.col("input_tokens") * F.coalesce("input_rate", F.lit(0.0)) + F.col("output_tokens") * F.coalesce("output_rate", F.lit(0.0))) / 1e6
    return total.join(prices, "model", "left").select("model", "n_calls", "input_tokens", "output_tokens", usd.alias("usd"))


def cost_lines(rows: DataFrame, label: str = "in the log") -> list[str]:
    """The cost report of ``costs``: a line a model, in the order of their names, and the sum. One row a model reaches the driver."""
    got = sorted((r["model"] or "", r) for r in rows.collect())
    out = [f"cost by the tokens used {label}:"]
    out += [f"  {m:<24}{r['n_calls']:>8} calls  {r['input_tokens']:>12} in  {r['output_tokens']:>12} out  ${r['usd']:.4f}" for m, r in got]
    return [*out, f"  {'total':<24}{sum(r['n_calls'] for _, r in got):>8} calls  ${sum(r['usd'] for _, r in got):.4f}"]


def smoke_estimate(calls: DataFrame, prices: DataFrame, n_cases: int, repeats: int = 1) -> DataFrame:
    """(n_measured, usd_per_case, n_calls, usd) of a whole run, from the calls(case_id, model, ...) of a trial alone.

    A measured case has a call a model, so its price is that of all models together; it isn't divided by their number.
    """
    measured = calls.agg(F.count_distinct("case_id").alias("n_measured"), F.count_distinct("model").alias("__models"))
    usd = costs(calls, prices).agg(F.coalesce(F.sum("usd"), F.lit(0.0)).alias("__usd"))
    each = F.when(F.col("n_measured") > 0, F.col("__usd") / F.col("n_measured")).otherwise(0.0)
    both = measured.crossJoin(F.broadcast(usd))  # one row each
    return both.select("n_measured", each.alias("usd_per_case"), (F.col("__models") * n_cases * repeats).alias("n_calls"), (each * n_cases * repeats).alias("usd"))


def chained(asks: DataFrame, log: DataFrame, answer_key: Column, judge_key: Callable[[Column], Column], order: str = "at") -> DataFrame:
    """asks with ``answer``, ``ruling`` and ``passed``: the logged answer of each, and the logged verdict on that answer.

    answer_key: the key of the answer by columns of asks; judge_key(answer): the key of the verdict, given the answer's
    column. passed is null where an answer or a verdict is absent, or the verdict is neither PASS nor FAIL.
    """
    last = newest(log, order)
    of = lambda name: last.select(F.col("key").alias(f"__{name}_key"), F.col("text").alias(name))
    first = asks.withColumn("__ask", answer_key).join(of("answer"), F.col("__ask") == F.col("__answer_key"), "left")
    second = first.withColumn("__judge", F.when(F.col("answer").isNotNull(), judge_key(F.col("answer")))).join(of("ruling"), F.col("__judge") == F.col("__ruling_key"), "left")
    return second.drop("__ask", "__judge", "__answer_key", "__ruling_key").withColumn("passed", verdict("ruling"))


def audit(trail: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The trail of some cases, from ``chained``: all its columns, and what it comes to in one word or two."""
    said = F.when(F.col("answer").isNull(), "no answer").when(F.col("ruling").isNull(), "no verdict").when(F.col("passed"), "PASS").when(~F.col("passed"), "FAIL").otherwise("unreadable verdict")
    return trail.where(F.col("case_id").isin(list(ids))).withColumn("outcome", said)


def trail_lines(rows: DataFrame) -> list[str]:
    """``audit`` of (case_id, input, expected, model, ...) as text to read, by case and model."""
    out, case = [], None
    for r in rows.orderBy("case_id", "model_ix").collect():
        if r["case_id"] != case:
            case = r["case_id"]
            out += ["", f"case {case}", f"  input: {r['input']}", f"  expected: {r['expected']}"]
        out += [f"  {r['model']}: {r['outcome']}"]
        if r["answer"] is not None:
            out.append(f"    answer: {r['answer']}")
        if r["ruling"] is not None:
            out.append(f"    judge: {r['ruling']}")
    return out[1:]


def stability_strings(verdicts: DataFrame, repeats: int) -> DataFrame:
    """(case_id, model_ix, runs): P, F, or . for a repeat that is missing, in order of the repeats."""
    letter = F.when(F.col("passed"), "P").when(~F.col("passed"), "F")
    found = verdicts.groupBy("case_id", "model_ix").agg(F.map_from_entries(F.collect_set(F.struct("repeat", letter.alias("l")))).alias("m"))
    runs = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda r: F.coalesce(F.col("m")[r], F.lit("."))), "")
    return found.select("case_id", "model_ix", runs.alias("runs"))


def stability_report(verdicts: DataFrame, repeats: int, weak: int = 0, strong: int = 1) -> DataFrame:
    """(case_id, weak, strong, n_inverted, status, always_inverted) of each case, for two of the models.

    n_inverted counts the repeats in which the weak model passed and the strong one failed; it is null, and the status
    'incomplete', where a verdict is missing. Else the status is 'unstable' if either model's verdicts differ between
    repeats, and 'stable'; always_inverted are stable cases that are inverted, which alone are evidence.
    """
    runs = stability_strings(verdicts, repeats)
    of = lambda k: F.coalesce(F.max(F.when(F.col("model_ix") == k, F.col("runs"))), F.lit("." * repeats))
    both = runs.groupBy("case_id").agg(of(weak).alias("weak"), of(strong).alias("strong"))
    at = lambda c: F.split(c, "")
    inverted = F.size(F.filter(F.arrays_zip(at("weak").alias("w"), at("strong").alias("s")), lambda p: (p["w"] == "P") & (p["s"] == "F")))
    missing = F.contains(F.concat("weak", "strong"), F.lit("."))
    mixed = lambda c: F.contains(c, F.lit("P")) & F.contains(c, F.lit("F"))
    status = F.when(missing, "incomplete").when(mixed(F.col("weak")) | mixed(F.col("strong")), "unstable").otherwise("stable")
    rows = both.select("*", F.when(~missing, inverted).cast("long").alias("n_inverted"), status.alias("status"))
    return rows.withColumn("always_inverted", (F.col("status") == "stable") & (F.coalesce("n_inverted", F.lit(0)) == repeats))


def judge_notes(judge: str, models: Sequence[str], sizes: Mapping[str, float] | None = None, other_provider: bool = False) -> list[str]:
    """What a choice of judge leaves open. sizes: billions of parameters of the models that are known."""
    sizes, family = sizes or {}, lambda m: m.split(":")[0]
    if other_provider:
        return [
            f"'{judge}' comes from another provider than the models it grades: it does not favour its own, but may favour a style; a change against a local judge shows that the grader changed, not which one is right",
            "this judge takes no temperature, so equal answers can get different verdicts: repeat runs to measure that",
        ]
    notes = []
    if judge in models:
        notes.append(f"'{judge}' grades its own answers: its pass rate is an upper bound, and a weak judge may be lenient to all")
    own, graded = sizes.get(judge), [sizes.get(m) for m in models]
    if own is None:
        notes.append(f"the size of '{judge}' isn't known, so it can't be told whether it is abler than what it grades")
    elif None not in graded and own < max(graded):
        notes.append(f"'{judge}' ({own}B) is smaller than the largest model it grades ({max(graded)}B): its mistakes look like those of the models")
    elif None not in graded and judge not in models:
        notes.append(f"'{judge}' ({own}B) is at least as large as the models it grades (at most {max(graded)}B) and none of them; a wrong verdict still looks like a failed case")
    if family(judge) not in {family(m) for m in models}:
        notes.append(f"'{judge}' is of another family than the models it grades: no liking for its relatives, but a taste of its own")
    return notes
