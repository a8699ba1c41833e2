"""Prompts with named gaps, and strict shapes of answers."""

from __future__ import annotations

import dataclasses
import hashlib
import re
import types
import typing
from dataclasses import dataclass


class GatewayError(ValueError):
    """A call that can't be made or trusted."""


GAP = re.compile(r"\{\{|\}\}|\{([^{}]*)\}|[{}]")


@dataclass(frozen=True)
class Prompt:
    """``{name}`` is a gap, ``{{`` and ``}}`` are braces."""

    id: str
    version: str
    system: str
    user: str

    def gaps(self) -> set[str]:
        found = {m[0]: m[1] for part in (self.system, self.user) for m in GAP.finditer(part) if m[0] not in ("{{", "}}")}
        if bad := [whole for whole, name in found.items() if name is None or not name.isidentifier()]:
            raise GatewayError(f"{self.id}: {bad} can't be filled")
        return set(found.values())

    def render(self, values: dict[str, str]) -> tuple[str, str]:
        """(system, user) with all gaps filled; values without a gap are errors like gaps without a value."""
        if odd := self.gaps() ^ set(values):
            raise GatewayError(f"{self.id} {self.version}: {sorted(odd)} don't fit")
        fill = lambda m: {"{{": "{", "}}": "}"}.get(m[0]) or values[m[1]]
        return GAP.sub(lambda m: fill(m) or "", self.system), GAP.sub(lambda m: fill(m) or "", self.user)

    def digest(self) -> str:
        return hashlib.sha256("\x00".join((self.id, self.version, self.system, self.user)).encode()).hexdigest()


KINDS = {str: "string", int: "integer", bool: "boolean"}


def shape(kind: object) -> dict:
    """JSON schema of a dataclass: every field is required, no others are allowed, nothing has a default."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind in KINDS:
        return {"type": KINDS[kind]}
    if origin is typing.Literal:
        return {"enum": list(args)}
    if origin in (list, tuple):
        return {"type": "array", "items": shape(args[0])}
    if origin in (typing.Union, types.UnionType):
        if len(args) != 2 or type(None) not in args:
            raise GatewayError(f"{kind}: only one kind or nothing")
        return {"anyOf": [shape(next(a for a in args if a is not type(None))), {"type": "null"}]}
    if dataclasses.is_dataclass(kind):
        hints, fields = typing.get_type_hints(kind), dataclasses.fields(kind)
        if loose := [f.name for f in fields if f.default is not dataclasses.MISSING or f.default_factory is not dataclasses.MISSING]:
            raise GatewayError(f"{kind.__name__}: {loose} have defaults")
        return {"type": "object", "properties": {f.name: shape(hints[f.name]) for f in fields}, "required": [f.name for f in fields], "additionalProperties": False}
    raise GatewayError(f"{kind}: no strict shape")


def without(schema: object, drop: frozenset[str]) -> object:
    """A schema without keywords a provider doesn't know; names of properties aren't keywords."""
    if isinstance(schema, list):
        return [without(x, drop) for x in schema]
    if not isinstance(schema, dict):
        return schema
    return {k: {n: without(p, drop) for n, p in v.items()} if k == "properties" else without(v, drop) for k, v in schema.items() if k not in drop}


def problems(value: object, schema: dict, at: str = "$") -> list[str]:
    """Why a value doesn't fit; kinds are exact, so true is no integer and "1" no number."""
    if "anyOf" in schema:
        tries = [problems(value, s, at) for s in schema["anyOf"]]
        return [] if any(not t for t in tries) else tries[0]
    if "enum" in schema:
        return [] if any(value == e and type(value) is type(e) for e in schema["enum"]) else [f"{at}: not one of {schema['enum']}"]
    fits = {"string": str, "integer": int, "boolean": bool, "array": list, "object": dict, "null": type(None)}[schema["type"]]
    if type(value) is not fits:
        return [f"{at}: not {schema['type']}"]
    if fits is list:
        return [p for k, x in enumerate(value) for p in problems(x, schema["items"], f"{at}[{k}]")]
    if fits is dict:
        out = [f"{at}: no {k}" for k in schema["required"] if k not in value] + [f"{at}: {k} isn't asked for" for k in value if k not in schema["properties"]]
        return out + [p for k, s in schema["properties"].items() if k in value for p in problems(value[k], s, f"{at}.{k}")]
    return []
