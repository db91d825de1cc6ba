"""Configuration on the driver: YAML or JSON layers, dotted overrides, strict shapes."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any


class ConfigError(ValueError):
    pass


def deep_merge(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, Mapping) and isinstance(out.get(k), Mapping) else v
    return out


def parse_override(text: str) -> dict[str, Any]:
    """a.b=value -> {"a": {"b": value}}; values are JSON where they parse as such."""
    path, sign, value = text.partition("=")
    keys = path.strip().split(".")
    if not sign or not all(keys):
        raise ConfigError(f"an override reads a.b=value, not {text!r}")
    try:
        parsed: Any = json.loads(value)
    except json.JSONDecodeError:
        parsed = value
    for k in reversed(keys):
        parsed = {k: parsed}
    return parsed


def load(path: str | Path) -> dict[str, Any]:
    text = Path(path).read_text()
    if str(path).endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML files need PyYAML; JSON works without it") from e
    return yaml.safe_load(text) or {}


def layered(path: str | Path, profile: str | None = None, overrides: Sequence[str] = ()) -> dict[str, Any]:
    """The file, then its profile's block, then its chosen dataset's block, then overrides."""
    config = load(path)
    profiles, datasets = config.pop("profiles", {}), config.pop("datasets", {})
    if profile is not None:
        if profile not in profiles:
            raise ConfigError(f"unknown profile {profile}")
        config = deep_merge(config, profiles[profile])
    if name := config.get("dataset_name"):
        config = deep_merge(config, datasets.get(name, {}))
    for x in overrides:
        config = deep_merge(config, parse_override(x))
    return config


def strict(kind: type, values: Mapping[str, Any], where: str = "config") -> Any:
    """A dataclass from a mapping: unknown and missing keys, and bool for int or int for bool, are errors."""
    fields = {f.name: f for f in dataclasses.fields(kind)}
    if unknown := set(values) - set(fields):
        raise ConfigError(f"{where}: unknown keys {sorted(unknown)}")
    missing = [n for n, f in fields.items() if n not in values and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
    if missing:
        raise ConfigError(f"{where}: missing keys {missing}")
    hints = typing.get_type_hints(kind)
    return kind(**{k: _coerced(hints[k], v, f"{where}.{k}") for k, v in values.items()})


def _coerced(hint: Any, value: Any, where: str) -> Any:
    origin, args = typing.get_origin(hint), typing.get_args(hint)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        return _coerced(next(a for a in args if a is not type(None)), value, where)
    if dataclasses.is_dataclass(hint):
        return strict(hint, value, where)
    if origin in (list, tuple):
        inner = [_coerced(args[0], v, where) for v in value]
        return inner if origin is list else tuple(inner)
    if origin is dict:
        return {k: _coerced(args[1], v, where) for k, v in value.items()}
    if hint is float and isinstance(value, int) and not isinstance(value, bool):
        return float(value)
    if hint is Path:
        return Path(value)
    if hint in (int, bool, str, float) and type(value) is not hint:
        raise ConfigError(f"{where}: {hint.__name__} expected, not {value!r}")
    return value


def resolve_column(available: Sequence[str], candidates: Sequence[str], kind: str) -> str:
    """The first candidate among the columns, whatever its case and outer spaces."""
    known = {c.strip().lower(): c for c in available}
    for c in candidates:
        if c.strip().lower() in known:
            return known[c.strip().lower()]
    raise ConfigError(f"no {kind} column among {list(available)}; tried {list(candidates)}")


def forbidden(config: Any, names: Sequence[str]) -> list[str]:
    """Paths of forbidden transform names anywhere in a configuration, whatever their case (X11)."""
    low = {n.lower() for n in names}

    def walk(x: Any, path: str) -> list[str]:
        if isinstance(x, Mapping):
            return [p for k, v in x.items() for p in ([f"{path}.{k}"] if str(k).lower() in low else []) + walk(v, f"{path}.{k}")]
        if isinstance(x, (list, tuple)):
            return [p for i, v in enumerate(x) for p in walk(v, f"{path}[{i}]")]
        return [path] if isinstance(x, str) and x.lower() in low else []

    return walk(config, "config")
