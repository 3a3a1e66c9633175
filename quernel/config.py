"""Configuration: YAML files merged in order, then overrides, then typed settings."""

from __future__ import annotations

import dataclasses
import typing
from collections.abc import Mapping
from pathlib import Path
from typing import Any

import yaml


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    """base with the values of over; mappings are merged key by key, anything else is replaced."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def load(*files: str | Path, overrides: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """The files merged in order; later ones and then overrides win. A missing file is an error."""
    out: dict[str, Any] = {}
    for f in files:
        out = merged(out, yaml.safe_load(Path(f).read_text()) or {})
    return merged(out, overrides or {})


def typed(cls: type, values: Mapping[str, Any]) -> Any:
    """An instance of a dataclass from nested mappings; unknown keys are errors."""
    hints = typing.get_type_hints(cls)
    known = {f.name for f in dataclasses.fields(cls)}
    if extra := sorted(set(values) - known):
        raise ValueError(f"unknown settings for {cls.__name__}: {', '.join(extra)}")
    return cls(**{k: typed(hints[k], v) if dataclasses.is_dataclass(hints[k]) and isinstance(v, Mapping) else v for k, v in values.items()})


@dataclasses.dataclass(frozen=True)
class DataSettings:
    path: str | None = None
    target: str = "target"
    test_size: float = 0.2
    seed: int = 42


@dataclasses.dataclass(frozen=True)
class ModelSettings:
    kind: str = "logistic"
    impute: str = "mean"
    balanced: bool = True
    params: dict[str, Any] = dataclasses.field(default_factory=dict)


@dataclasses.dataclass(frozen=True)
class BaselineSettings:
    data: DataSettings = DataSettings()
    model: ModelSettings = ModelSettings()


def artifact_path(root: str | Path, *parts: str) -> Path:
    """A path for an artifact; its folder is made."""
    out = Path(root, *parts)
    out.parent.mkdir(parents=True, exist_ok=True)
    return out
