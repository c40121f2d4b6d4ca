"""Readers: JSONL, JSON, CSV, Parquet and DataFrames, all to a set of cases.

Text formats go through a strict Python parser on the executors, so that values keep their Python form and errors
their place. JSONL is splittable; a JSON or CSV file is one document and so one task.
"""

from __future__ import annotations

import csv
import io
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from setaudit import runtime
from setaudit.functions import is_blank, stripped
from setaudit.mapping import FieldMapping, apply_mapping, resolve_mapping
from setaudit.model import CASES, EvalCase, EvalSet, LoadError, SchemaError

_RECORDS = "file string, block long, nth long, place long, record string, error string"


def _record(value) -> tuple[str | None, str | None]:
    if not isinstance(value, dict):
        return None, f"expected an object, got {type(value).__name__}"
    return json.dumps(value), None


def _jsonl(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Lines of a block, counted as they come: ``place`` counts all lines of the block, ``nth`` those that aren't blank."""
    lines: dict = {}
    for batch in batches:
        out = []
        for file, block, text in zip(batch["file"], batch["block"], batch["value"]):
            nth, place = lines.get((file, block), (0, 0))
            place += 1
            if text is None:
                out.append((file, block, nth + 1, place, None, "not UTF-8"))
                lines[file, block] = nth + 1, place
                continue
            text = text.lstrip("﻿") if place == 1 and block == 0 else text
            if text.strip():
                nth += 1
                try:
                    out.append((file, block, nth, place, *_record(json.loads(text))))
                except ValueError as e:
                    out.append((file, block, nth, place, None, f"invalid JSON ({e})"))
            lines[file, block] = nth, place
        yield pd.DataFrame(out, columns=["file", "block", "nth", "place", "record", "error"])


def _whole(parse):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for file, text in zip(batch["file"], batch["value"]):
                if text is None:
                    out.append((file, 0, 1, 0, None, "not UTF-8"))
                    continue
                try:
                    out += [(file, 0, n, n, *_record(r)) for n, r in enumerate(parse(text.lstrip("﻿")), 1)]
                except (ValueError, csv.Error) as e:
                    out.append((file, 0, 1, 0, None, str(e)))
            yield pd.DataFrame(out, columns=["file", "block", "nth", "place", "record", "error"])

    return run


def _json_items(text: str) -> list:
    try:
        value = json.loads(text)
    except ValueError as e:
        raise ValueError(f"invalid JSON ({e})") from e
    if isinstance(value, dict):
        if "cases" not in value:
            raise ValueError("a JSON object needs a 'cases' list")
        value = value["cases"]
        if not isinstance(value, list):
            raise ValueError("'cases' must be a list")
    if not isinstance(value, list):
        raise ValueError(f"expected a list of cases, got {type(value).__name__}")
    return value


def _csv_rows(text: str) -> Iterator[dict]:
    reader = csv.DictReader(io.StringIO(text, newline=""))
    if not reader.fieldnames:
        raise ValueError("no header row")
    for row in reader:
        yield {k: v for k, v in row.items() if k is not None and isinstance(v, str) and v.strip()}


def _to_case(mapping: FieldMapping, where: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for pos, place, record, error in zip(batch["pos"], batch["place"], batch["record"], batch["error"]):
                row = (pos, None, None, None, None, None, None)
                if error is None:
                    try:
                        r = apply_mapping(json.loads(record), mapping)
                        if "input" not in r:
                            raise SchemaError("'input' is missing")
                        case_id, nested = r.pop("id", None), r.pop("metadata", None)
                        extra = {k: v for k, v in r.items() if k not in ("input", "expected", "label")}
                        if nested is not None:
                            extra = extra | nested if isinstance(nested, dict) else nested
                        row = EvalCase(f"case_{pos}" if case_id is None else str(case_id), r["input"], r.get("expected"), r.get("label"), extra).row(pos)
                    except SchemaError as e:
                        error = str(e)
                out.append((*row, f"{where} {place}: {error}" if error is not None and place else error))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in CASES.split(", ")] + ["error"])

    return run


def _text_records(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Records with global ``pos`` and ``place``, from the counts of each block: one row a block."""
    read = spark.read.text(path, wholetext=kind != "jsonl")
    block = F.col("_metadata.file_block_start") if kind == "jsonl" else F.lit(0)
    lines = read.select(F.col("_metadata.file_path").alias("file"), block.cast("long").alias("block"), F.when(F.is_valid_utf8("value"), F.col("value")).alias("value"))
    parser = {"jsonl": _jsonl, "json": _whole(_json_items), "csv": _whole(_csv_rows)}[kind]
    runtime.send(spark)
    rows = lines.mapInPandas(parser, _RECORDS)
    if kind == "jsonl":
        counts = lines.groupBy("file", "block").agg(F.count_if(F.col("value").isNull() | ~is_blank("value")).alias("n"), F.count("*").alias("m"))
    else:
        counts = rows.groupBy("file", "block").agg(F.count("*").alias("n"), F.lit(0).cast("long").alias("m"))
    order = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("file", "block", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("n0"), F.coalesce(F.sum("m").over(in_file), F.lit(0)).alias("m0"))
    return rows.join(base, ["file", "block"]).select((F.col("n0") + F.col("nth")).alias("pos"), (F.col("m0") + F.col("place")).alias("place"), "record", "error")


_KINDS = {".jsonl": ("jsonl", "line"), ".ndjson": ("jsonl", "line"), ".json": ("json", "item"), ".csv": ("csv", "row"), ".parquet": ("parquet", "row")}


def load_with_mapping(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> tuple[EvalSet, FieldMapping]:
    """(set, mapping) of a file. All columns of all records are considered for the mapping."""
    name = os.path.basename(path)
    if "://" not in path and not os.path.exists(path):
        raise LoadError(f"{path}: no such file")
    suffix = os.path.splitext(path)[1].lower()
    if suffix not in _KINDS:
        raise LoadError(f"{name}: unsupported format '{suffix}'; known: {', '.join(_KINDS)}")
    kind, where = _KINDS[suffix]
    if kind == "parquet":
        return from_dataframe(spark.read.parquet(path), field_map, source=path)
    records = _text_records(spark, path, kind).persist()
    first = records.where("error is not null").orderBy("pos").first()
    if first:
        raise LoadError(f"{name} {where} {first['place']}: {first['error']}" if first["place"] else f"{name}: {first['error']}")
    keys = F.posexplode(F.json_object_keys("record")).alias("k", "key")
    seen = records.select("pos", keys).groupBy("key").agg(F.min(F.struct("pos", "k")).alias("at")).orderBy("at")
    columns = [r["key"] for r in seen.collect()]
    if not columns and not records.limit(1).count():
        raise LoadError(f"{name}: no cases")
    mapping = resolve_mapping(columns, field_map)
    cases = records.mapInPandas(_to_case(mapping, where), CASES + ", error string").persist()
    bad = cases.where("error is not null").orderBy("pos").first()
    if bad:
        raise LoadError(f"{name} {bad['error']}")
    try:
        return EvalSet(cases.drop("error"), path), mapping
    except SchemaError as e:
        raise LoadError(f"{name}: {e}") from e


def load(spark: SparkSession, path: str, field_map: dict[str, str] | None = None) -> EvalSet:
    return load_with_mapping(spark, path, field_map)[0]


@F.pandas_udf(StringType())
def _python_text(value: pd.Series) -> pd.Series:
    return value.map(lambda v: str(json.loads(v)["v"]))


@F.pandas_udf(StringType())
def _value_json(value: pd.Series) -> pd.Series:
    return value.map(lambda v: json.dumps(json.loads(v)["v"]))


def project(df: DataFrame, mapping: FieldMapping) -> DataFrame:
    """The mapped columns of a DataFrame as id, input, expected_text, expected_json, label, metadata."""
    cell = lambda f: F.col(f"`{mapping.resolved[f]}`") if f in mapping.resolved else F.lit(None)
    kinds = dict(df.dtypes)

    def text(f: str):
        if kinds.get(mapping.resolved.get(f, "")) == "boolean":
            return F.when(cell(f), "True").when(~cell(f), "False")
        return cell(f).cast("string")

    used = set(mapping.resolved.values())
    extra = [F.col(f"`{c}`").alias(mapping.displaced.get(c, c)) for c in df.columns if c not in used or c in mapping.displaced]
    meta = F.to_json(F.struct(*extra)) if extra else F.lit(None).cast("string")
    kind = kinds.get(mapping.resolved.get("expected", ""), "string")
    if kind == "double" or kind == "float" or "<" in kind:  # Python's text of these isn't the cast's, so both kinds of source take Python's
        runtime.send(df.sparkSession)
        value = F.to_json(F.struct(cell("expected").alias("v")), {"ignoreNullFields": "false"})
        expected, as_json = F.when(cell("expected").isNotNull(), _python_text(value)), F.when(cell("expected").isNotNull(), _value_json(value))
    else:
        expected, as_json = text("expected"), F.lit(None).cast("string")
    return df.select(text("id").alias("id"), text("input").alias("input"), expected.alias("expected_text"), as_json.alias("expected_json"), stripped(text("label")).alias("label"), meta.alias("metadata"))


def from_dataframe(df: DataFrame, field_map: dict[str, str] | None = None, order_by: str | None = None, source: str = "dataframe", check: bool = True) -> tuple[EvalSet, FieldMapping]:
    """(set, mapping) of a DataFrame, its rows in the order of order_by or as they come."""
    mapping = resolve_mapping(df.columns, field_map)
    kind = dict(df.dtypes)[mapping.resolved["input"]]
    if kind != "string":
        raise LoadError(f"{source}: column '{mapping.resolved['input']}' must be text, is {kind}")
    rows = runtime.numbered(project(df.orderBy(order_by) if order_by else df, mapping))
    rows = rows.withColumn("id", F.coalesce("id", F.concat(F.lit("case_"), F.col("pos")))).select(*[c.split()[0] for c in CASES.split(", ")])
    if check:
        bad = rows.where(is_blank("id") | is_blank("input") | (F.col("label").isNotNull() & is_blank("label"))).orderBy("pos").first()
        if bad:
            raise LoadError(f"{source} row {bad['pos']}: id, input and a label that is given must not be blank")
    try:
        return EvalSet(rows, source, check), mapping
    except SchemaError as e:
        raise LoadError(f"{source}: {e}") from e
