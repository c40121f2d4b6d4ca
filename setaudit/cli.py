"""python -m setaudit PATH: exit 0 fine, 1 gate tripped, 2 usage, 3 couldn't audit (or not in full)."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession

from setaudit import __version__, gate, report
from setaudit.config import ConfigError, find_config, load_config
from setaudit.mapping import MappingError
from setaudit.model import LoadError, SchemaError
from setaudit.operators.duplicates import THRESHOLD, DuplicateCheck
from setaudit.operators.imbalance import ImbalanceCheck
from setaudit.operators.leakage import MIN_ANSWER_CHARS, WIDESPREAD_SHARE, LeakageCheck
from setaudit.sources import load_with_mapping

log = logging.getLogger("setaudit")
DEFAULTS = {"fail_on": "never", "min_class_share": 0.10, "min_class_count": 5, "duplicate_threshold": THRESHOLD, "skip_duplicates": False, "max_imbalance_ratio": 3.0, "min_answer_chars": MIN_ANSWER_CHARS, "widespread_share": WIDESPREAD_SHARE}
NOT_RUN = "discrimination: needs a scorer and models, so it runs from the library only"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="setaudit", description="Audit an evaluation set.")
    p.add_argument("path")
    p.add_argument("--json", action="store_true", dest="as_json")
    p.add_argument("--config")
    p.add_argument("--map", action="append", default=[], metavar="FIELD=COLUMN", dest="maps")
    p.add_argument("--fail-on", choices=gate.FAIL_ON)
    p.add_argument("--min-class-share", type=float)
    p.add_argument("--min-class-count", type=int)
    p.add_argument("--max-imbalance-ratio", type=float)
    p.add_argument("--duplicate-threshold", type=float)
    p.add_argument("--min-answer-chars", type=int)
    p.add_argument("--widespread-share", type=float)
    p.add_argument("--skip-duplicates", action="store_const", const=True)
    p.add_argument("-v", "--verbose", action="count", default=0)
    p.add_argument("--version", action="version", version=__version__)
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None, embedder=None) -> int:
    args = _parser().parse_args(argv)
    if not os.path.exists(args.path):
        print(f"setaudit: {args.path}: no such file", file=sys.stderr)
        return gate.USAGE
    if args.verbose:
        handler = logging.StreamHandler(sys.stderr)
        log.addHandler(handler)
        log.setLevel(logging.DEBUG if args.verbose > 1 else logging.INFO)
    try:
        found = args.config or find_config(os.path.dirname(os.path.abspath(args.path)))
        flags = {k: getattr(args, k) for k in DEFAULTS if getattr(args, k) is not None}
        s = DEFAULTS | (load_config(found) if found else {}) | flags
        pairs = [m.partition("=") for m in args.maps]
        if any(not eq for _, eq, _ in pairs):
            raise MappingError("--map takes FIELD=COLUMN")
        checks = [
            ImbalanceCheck(min_class_share=s["min_class_share"], min_class_count=s["min_class_count"], max_imbalance_ratio=s["max_imbalance_ratio"]),
            LeakageCheck(min_answer_chars=s["min_answer_chars"], widespread_share=s["widespread_share"]),
        ]
        duplicates = DuplicateCheck(threshold=s["duplicate_threshold"], embedder=embedder)
        spark = spark or SparkSession.builder.appName("setaudit").getOrCreate()
        cases, mapping = load_with_mapping(spark, args.path, {f: c for f, _, c in pairs})
        log.info("loaded %d cases from %s", len(cases), args.path)
        results = [c.run(cases) for c in checks]
    except (ConfigError, MappingError, LoadError, SchemaError, ValueError) as e:
        print(f"setaudit: {e}", file=sys.stderr)
        return gate.BROKEN
    notes = [NOT_RUN] + ([] if mapping.is_identity() and not mapping.alternatives else mapping.explain())
    incomplete = False
    if s["skip_duplicates"]:
        notes.append("duplicates: skipped on request")
    else:
        try:
            results.append(duplicates.run(cases))
        except Exception as e:  # noqa: BLE001 - said in the report, and the exit code tells
            incomplete = True
            notes.append(f"duplicates: could not run ({str(e).splitlines()[0] if str(e) else type(e).__name__})")
    code = gate.exit_code(results, s["fail_on"], incomplete)
    if args.as_json:
        extra = {"gate": {"fail_on": s["fail_on"], "exit_code": code, "tripped": gate.tripped(results, s["fail_on"]), "incomplete": incomplete}}
        print(json.dumps(report.to_dict(results, source=args.path, notes=notes) | extra, indent=2, ensure_ascii=False))
    else:
        print(report.render_text(results, source=args.path, notes=notes))
    if code == gate.BROKEN:
        print("setaudit: incomplete, a check could not run", file=sys.stderr)
    elif code == gate.TRIPPED:
        print(f"setaudit: gate '{s['fail_on']}' tripped", file=sys.stderr)
    return code
