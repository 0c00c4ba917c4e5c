"""Named serializers for payloads that only bodies decode: dataclasses as canonical JSON, and whatever is registered."""

from __future__ import annotations

import dataclasses
import json
import types
import typing
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Serializer:
    name: str
    accepts: Callable[[type], bool]
    encode: Callable[[Any], bytes]
    decode: Callable[[bytes, type], Any]


class ValidationError(ValueError):
    """A payload that doesn't have the type's shape."""


def _plain(value: Any) -> Any:
    if dataclasses.is_dataclass(value):
        return {f.name: _plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
    if isinstance(value, list):
        return [_plain(x) for x in value]
    if isinstance(value, dict):
        if any(not isinstance(k, str) for k in value):
            raise ValidationError("keys are text")
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, (set, frozenset)):
        raise ValidationError("a set has no stable order")
    return value


def _typed(value: Any, want: Any, at: str) -> Any:
    origin, args = typing.get_origin(want), typing.get_args(want)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        (inner,) = [a for a in args if a is not type(None)]
        return _typed(value, inner, at)
    if dataclasses.is_dataclass(want):
        if not isinstance(value, dict):
            raise ValidationError(f"{at}: not an object")
        hints, fields = typing.get_type_hints(want), {f.name: f for f in dataclasses.fields(want)}
        if unknown := set(value) - set(fields):
            raise ValidationError(f"{at}: {len(unknown)} unknown fields")
        missing = [n for n, f in fields.items() if n not in value and f.default is dataclasses.MISSING and f.default_factory is dataclasses.MISSING]
        if missing:
            raise ValidationError(f"{at}: {missing[0]} is missing")
        return want(**{n: _typed(v, hints[n], f"{at}.{n}") for n, v in value.items()})
    if origin is list:
        if not isinstance(value, list):
            raise ValidationError(f"{at}: not a list")
        return [_typed(v, args[0], f"{at}[{k}]") for k, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise ValidationError(f"{at}: not an object")
        return {k: _typed(v, args[1], f"{at}.{k}") for k, v in value.items()}
    if want is float and type(value) is int:
        return float(value)
    if type(value) is not want:
        raise ValidationError(f"{at}: not {want.__name__}")
    return value


def canonical(value: Any) -> bytes:
    """JSON with sorted keys, no white space, no NaN."""
    return json.dumps(_plain(value), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()


DATACLASS = Serializer("dataclass", dataclasses.is_dataclass, canonical, lambda data, t: _typed(json.loads(data), t, t.__name__))


class Registry:
    """Serializers by name; the first that accepts a type is its own."""

    def __init__(self) -> None:
        self.known: dict[str, Serializer] = {DATACLASS.name: DATACLASS}

    def add(self, serializer: Serializer) -> None:
        if serializer.name in self.known:
            raise ValueError(f"{serializer.name} is registered")
        self.known[serializer.name] = serializer

    def of(self, type_: type) -> Serializer:
        for s in self.known.values():
            if s.accepts(type_):
                return s
        raise TypeError(f"no serializer takes {type_.__name__}")
