"""A typed configuration from one file: closed (no key too many or too few), without repeated keys. JSON always, YAML if its library is there."""

from __future__ import annotations

import dataclasses
import json
import types
from collections.abc import Mapping
from pathlib import Path
from typing import Any, TypeVar, get_args, get_origin, get_type_hints

try:
    import yaml
except ImportError:
    yaml = None

T = TypeVar("T")


def _unique(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out: dict[str, Any] = {}
    for key, value in pairs:
        if key in out:
            raise ValueError(f"the key {key} is repeated")
        out[key] = value
    return out


def parse(text: str, kind: str = "json") -> Any:
    """Plain values of a text; a repeated key is refused."""
    if kind == "json":
        return json.loads(text, object_pairs_hook=_unique)
    if yaml is None:
        raise ImportError("YAML files need a YAML library")

    class Loader(yaml.SafeLoader):
        pass

    Loader.add_constructor("tag:yaml.org,2002:map", lambda loader, node: _unique([(loader.construct_object(k, True), loader.construct_object(v, True)) for k, v in node.value]))
    return yaml.load(text, Loader)  # noqa: S506


def build(cls: type[T], value: Any, where: str = "") -> T:
    """A dataclass of plain values: each field of its type, defaults where a key is missing, and nothing else."""
    if not isinstance(value, Mapping):
        raise ValueError(f"{where or 'the file'} holds no keys")
    hints, fields = get_type_hints(cls), {f.name: f for f in dataclasses.fields(cls)}
    unknown = sorted(set(value) - set(fields))
    missing = sorted(n for n, f in fields.items() if n not in value and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING)
    if unknown or missing:
        raise ValueError(f"{where or 'the file'}: unknown {unknown}, missing {missing}")
    return cls(**{n: _value(hints[n], v, f"{where}.{n}".lstrip(".")) for n, v in value.items()})


def _value(kind: Any, v: Any, where: str) -> Any:
    origin = get_origin(kind)
    if dataclasses.is_dataclass(kind):
        return build(kind, v, where)
    if origin in (types.UnionType,) or str(origin) == "typing.Union":
        if v is None and type(None) in get_args(kind):
            return None
        return _value(next(k for k in get_args(kind) if k is not type(None)), v, where)
    if origin in (list, tuple):
        if not isinstance(v, list):
            raise ValueError(f"{where} is a list")
        return origin(_value(get_args(kind)[0], x, f"{where}[{i}]") for i, x in enumerate(v))
    if origin in (dict, Mapping) or getattr(origin, "__name__", "") == "Mapping":
        if not isinstance(v, Mapping):
            raise ValueError(f"{where} holds keys")
        return {k: _value(get_args(kind)[1], x, f"{where}.{k}") for k, x in v.items()}
    if kind is float and isinstance(v, int) and not isinstance(v, bool):
        return float(v)
    if isinstance(kind, type) and (not isinstance(v, kind) or isinstance(v, bool) and kind is not bool):
        raise ValueError(f"{where} is of type {kind.__name__}")
    return v


def load(cls: type[T], path: str) -> T:
    return build(cls, parse(Path(path).read_text(encoding="utf-8"), "yaml" if path.endswith((".yaml", ".yml")) else "json"))
