"""Audit evaluation datasets with Spark."""

from __future__ import annotations

import logging

__version__ = "0.1.0"

from setaudit.mapping import AmbiguousMappingError, FieldMapping, MappingError, resolve_mapping  # noqa: E402
from setaudit.model import Check, CheckResult, EvalCase, EvalSet, Finding, LoadError, MissingEmbeddingsError, SchemaError, ScorerError, Severity  # noqa: E402
from setaudit.operators.discrimination import DiscriminationCheck, Scorer  # noqa: E402
from setaudit.operators.duplicates import DuplicateCheck, Embedder  # noqa: E402
from setaudit.operators.imbalance import ImbalanceCheck  # noqa: E402
from setaudit.operators.leakage import LeakageCheck  # noqa: E402
from setaudit.report import render_text, to_dict  # noqa: E402
from setaudit.sources import from_dataframe, load, load_with_mapping  # noqa: E402

logging.getLogger("setaudit").addHandler(logging.NullHandler())
__all__ = [
    "AmbiguousMappingError", "Check", "CheckResult", "DiscriminationCheck", "DuplicateCheck", "Embedder", "EvalCase", "EvalSet", "FieldMapping", "Finding", "ImbalanceCheck", "LeakageCheck", "LoadError", "MappingError",
    "MissingEmbeddingsError", "SchemaError", "Scorer", "ScorerError", "Severity", "from_dataframe", "load", "load_with_mapping", "render_text", "resolve_mapping", "to_dict",
]
