"""Settings from setaudit.toml or pyproject.toml."""

from __future__ import annotations

import tomllib
from pathlib import Path
from typing import Any

from setaudit.gate import FAIL_ON

TOOL = "setaudit"
KNOWN: dict[str, tuple[type, ...]] = {
    "fail_on": (str,), "min_class_share": (int, float), "min_class_count": (int,), "duplicate_threshold": (int, float), "skip_duplicates": (bool,),
    "max_imbalance_ratio": (int, float), "min_answer_chars": (int,), "widespread_share": (int, float),
}


class ConfigError(ValueError):
    """A settings file has what it shouldn't."""


def find_config(start: str | Path) -> Path | None:
    """The nearest file up from ``start``; in one folder setaudit.toml comes before pyproject.toml."""
    here = Path(start).resolve()
    for folder in [here, *here.parents]:
        if (own := folder / f"{TOOL}.toml").is_file():
            return own
        project = folder / "pyproject.toml"
        if project.is_file():
            try:
                if TOOL in tomllib.loads(project.read_text("utf-8")).get("tool", {}):
                    return project
            except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                continue
    return None


def load_config(path: str | Path) -> dict[str, Any]:
    path = Path(path)
    try:
        got = tomllib.loads(path.read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e
    if path.name == "pyproject.toml":
        got = got.get("tool", {}).get(TOOL, {})
    for key, value in got.items():
        if key not in KNOWN:
            raise ConfigError(f"{path}: unknown setting '{key}'; known: {', '.join(KNOWN)}")
        if not isinstance(value, KNOWN[key]) or isinstance(value, bool) and bool not in KNOWN[key]:
            raise ConfigError(f"{path}: '{key}' has the wrong type {type(value).__name__}")
    if got.get("fail_on", FAIL_ON[0]) not in FAIL_ON:
        raise ConfigError(f"{path}: fail_on must be one of {', '.join(FAIL_ON)}")
    return got
