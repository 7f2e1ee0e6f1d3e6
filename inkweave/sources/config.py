"""Project settings: what the call gives comes before the manifest, the manifest before the environment, that before defaults."""

from __future__ import annotations

import glob
import tomllib
from collections.abc import Mapping
from pathlib import Path

DEFAULTS = {"min_jaccard": 0.55, "min_lines": 4, "min_monotone": 0.8, "review_lines": 2}
VARIABLES = {"min_jaccard": "INKWEAVE_MIN_JACCARD", "min_lines": "INKWEAVE_MIN_LINES", "min_monotone": "INKWEAVE_MIN_MONOTONE", "review_lines": "INKWEAVE_REVIEW_LINES"}


def checked(settings: dict) -> dict:
    for name in ("min_jaccard", "min_monotone"):
        if not 0 <= settings[name] <= 1:
            raise ValueError(f"{name} has to be from 0 to 1")
    for name in ("min_lines", "review_lines"):
        if int(settings[name]) != settings[name] or settings[name] < 1:
            raise ValueError(f"{name} has to be a positive whole number")
    return settings


def load(manifest: str | None = None, given: Mapping = {}, environment: Mapping[str, str] = {}) -> dict:
    """The settings, and ``pages``: the manifest's globs, sorted, from its own folder, each file once."""
    told = tomllib.loads(Path(manifest).read_text(encoding="utf-8")) if manifest else {}
    out = dict(DEFAULTS)
    for name, variable in VARIABLES.items():
        if variable in environment:
            out[name] = type(DEFAULTS[name])(environment[variable])
    out |= told.get("alignment", {}) | {k: v for k, v in given.items() if v is not None}
    base = Path(manifest).resolve().parent if manifest else Path.cwd()
    out["pages"] = list(dict.fromkeys(f for p in told.get("pages", {}).get("images", []) for f in sorted(glob.glob(str(base / p)))))
    return checked(out)
