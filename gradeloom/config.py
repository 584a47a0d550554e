"""Search weights from configuration files: the nearest project file, then the user's, then the defaults."""

from __future__ import annotations

import tomllib
import warnings
from pathlib import Path

from gradeloom.operators.search import PRESETS, check_weights

FOLDER, NAME = ".gradeloom", "config"
#: Weights of a configuration file are at least this.
LEAST = 0.1


class ConfigError(ValueError):
    """A configuration file that can't be used."""


def project_file(start: str | Path) -> Path | None:
    """The configuration file of the nearest folder upwards that has one."""
    here = Path(start).resolve()
    return next((f for d in (here, *here.parents) if (f := d / FOLDER / NAME).is_file()), None)


def weights_of(path: str | Path) -> tuple[float, float, float]:
    """(grading, clip, tag) of the [search] table: `default_mode` balanced is a preset; else grading_weight, clip_weight and tag_weight count, missing ones as in grading-first."""
    try:
        table = tomllib.loads(Path(path).read_text(encoding="utf-8")).get("search", {})
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from None
    mode = table.get("default_mode", "grading-first")
    if mode == "balanced":
        return PRESETS["balanced"]
    if mode != "grading-first":
        warnings.warn(f"{path}: unknown default_mode {mode!r}, the weights count", stacklevel=2)
    named = {k: table.get(f"{k}_weight", w) for k, w in zip(("grading", "clip", "tag"), PRESETS["grading-first"])}
    try:
        return check_weights(named, LEAST)
    except (TypeError, ValueError) as e:
        raise ConfigError(f"{path}: {e}") from None


def search_weights(start: str | Path = ".", user_file: str | Path | None = None, given: dict[str, float] | None = None) -> tuple[float, float, float]:
    """Given weights, else the project's, else the user's, else grading-first."""
    if given is not None:
        return check_weights(given)
    own = project_file(start)
    if own is not None:
        return weights_of(own)
    common = Path(user_file) if user_file is not None else Path.home() / FOLDER / NAME
    return weights_of(common) if common.is_file() else PRESETS["grading-first"]
