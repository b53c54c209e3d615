"""Type expressions -> Spark types with merge rules, and how two port types relate.

A port type says both what a value is and how a delta is merged into a store: numbers add,
``overwrite[T]`` and everything opaque replace, lists extend, maps change known keys only.
Spark keeps the first part as a ``DataType`` and the second in the field's metadata.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIASES = {"int": "integer", "number": "float", "double": "float", "bool": "boolean", "array": "list", "object": "map", "dict": "map"}
SCALARS = {"float": (T.DoubleType, "add"), "integer": (T.LongType, "add"), "boolean": (T.BooleanType, "set"), "string": (T.StringType, "set"), "quote": (T.StringType, "set"), "node": (T.StringType, "set"), "any": (T.StringType, "set"), "schema": (T.StringType, "set"), "path": (lambda: T.ArrayType(T.StringType()), "set")}


@dataclass(frozen=True)
class PortType:
    """What a port carries: type, merge rule (add, set, extend, keys), default, units, nullability."""

    name: str
    data: T.DataType
    apply: str
    default: object = None
    units: str | None = None
    optional: bool = False
    parts: tuple = field(default=())

    def to_field(self, column: str) -> T.StructField:
        extra = {"apply": self.apply} | ({"units": self.units} if self.units else {}) | ({"default": self.default} if self.default is not None else {})
        return T.StructField(column, self.data, True, extra)

    def filled(self, column: Column) -> Column:
        """``column`` with the type's default in place of nulls."""
        return column if self.default is None else F.coalesce(column, F.lit(self.default).cast(self.data))


def _split(text: str) -> list[str]:
    parts, depth, last = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "[({") - (c in "])}")
        if c == "," and not depth:
            parts.append(text[last:i].strip())
            last = i + 1
    return [p for p in [*parts, text[last:].strip()] if p]


def parse_type(expression) -> PortType:
    """A type expression such as ``map[float]``, ``float{1.0}``, ``maybe[string]`` or a dict with _type, _default, _units."""
    if isinstance(expression, dict):
        if "_type" in expression:
            base = parse_type(expression["_type"])
            return PortType(base.name, base.data, base.apply, expression.get("_default", base.default), expression.get("_units"), base.optional, base.parts)
        fields = [(k, parse_type(v)) for k, v in expression.items() if not k.startswith("_")]
        return PortType("{" + ",".join(f"{k}:{p.name}" for k, p in fields) + "}", T.StructType([p.to_field(k) for k, p in fields]), "set", parts=tuple(p for _, p in fields))
    text = expression.strip()
    if m := re.fullmatch(r"(.+?)\{([^{}]*)\}", text):
        base = parse_type(m[1])
        default = {T.DoubleType: float, T.LongType: int, T.BooleanType: lambda s: s.lower() == "true"}.get(type(base.data), str)(m[2]) if m[2] or isinstance(base.data, T.StringType) else None
        return PortType(base.name, base.data, base.apply, default, base.units, base.optional, base.parts)
    m = re.fullmatch(r"([\w ]+?)(?:\[(.*)\])?", text, re.S)
    if not m:
        raise ValueError(f"not a type expression: {expression!r}")
    head = ALIASES.get(m[1], m[1])
    inner = _split(m[2]) if m[2] is not None else []
    inner = [re.sub(r"^\w+:(?!:)", "", p) for p in inner]
    if head in SCALARS and not inner:
        kind, apply = SCALARS[head]
        return PortType(head, kind(), apply)
    if head == "overwrite":
        base = parse_type(inner[0])
        return PortType(f"overwrite[{base.name}]", base.data, "set", base.default, base.units, base.optional, (base,))
    if head == "maybe":
        base = parse_type(inner[0])
        return PortType(f"maybe[{base.name}]", base.data, base.apply, base.default, base.units, True, (base,))
    if head == "map":
        base = parse_type(inner[-1]) if inner else parse_type("any")
        return PortType(f"map[{base.name}]", T.MapType(T.StringType(), base.data), "keys", parts=(base,))
    if head == "list":
        if inner and inner[0].startswith("("):  # array[(shape), T]: elements add
            base = parse_type(inner[-1])
            return PortType(f"array[{base.name}]", T.ArrayType(base.data), "add", parts=(base,))
        base = parse_type(inner[0]) if inner else parse_type("any")
        return PortType(f"list[{base.name}]", T.ArrayType(base.data), "extend", parts=(base,))
    if head == "tuple":
        parts = tuple(parse_type(p) for p in inner)
        return PortType(f"tuple[{','.join(p.name for p in parts)}]", T.StructType([p.to_field(f"_{k + 1}") for k, p in enumerate(parts)]), "set", parts=parts)
    if head == "tree":
        return PortType(f"tree[{','.join(inner)}]", T.StringType(), "set")
    raise ValueError(f"unknown type: {expression!r}")


class Crossing(Enum):
    EXACT = "exact"
    WIDENED = "widened"
    SHIFTED = "semantics_shifted"
    IRRECONCILABLE = "irreconcilable"


def _wrapper(p: PortType) -> str:
    return p.name.split("[")[0] if p.name.startswith(("overwrite", "quote")) else ""


def crossing(producer, consumer) -> Crossing:
    """How a value of one port type arrives at a port of another one.

    A merge rule or unit that only one side states is a shift of meaning whatever the types.
    """
    p, c = parse_type(producer), parse_type(consumer)
    if _wrapper(p) != _wrapper(c) or p.units != c.units:
        return Crossing.SHIFTED
    if p.name == c.name and p.default == c.default:
        return Crossing.EXACT
    return Crossing.WIDENED if _joinable(p, c) else Crossing.IRRECONCILABLE


def _joinable(p: PortType, c: PortType) -> bool:
    number = (T.LongType, T.DoubleType)
    if p.name == c.name or "any" in (p.name, c.name):
        return True
    if isinstance(p.data, number) and isinstance(c.data, number):
        return True
    if p.optional != c.optional:
        inner = lambda x: x.parts[0] if x.optional else x
        return _joinable(inner(p), inner(c))
    same = p.name.split("[")[0] == c.name.split("[")[0] and "[" in p.name and "[" in c.name
    return same and len(p.parts) == len(c.parts) and all(map(_joinable, p.parts, c.parts))


TRUE_WORDS, FALSE_WORDS = ("true", "yes", "on", "1"), ("false", "no", "off", "0")


def coerce_value(value, declared: str, name: str = "value"):
    """``value`` as the declared type, or ValueError where something would be lost."""
    kind = ALIASES.get(declared, declared)

    def refuse(why):
        raise ValueError(f"{name} is {kind}, not {value!r}: {why}")

    if value is None:
        refuse("no value")
    if kind in ("float", "integer"):
        if isinstance(value, bool):
            refuse("a boolean is no number")
        try:
            number = float(value) if kind == "float" else int(value)
        except (TypeError, ValueError):
            refuse("no number")
        if kind == "integer" and isinstance(value, float) and number != value:
            refuse("it has a fraction")
        return number
    if kind == "boolean":
        if isinstance(value, str):
            word = value.strip().lower()
            if word not in TRUE_WORDS + FALSE_WORDS:
                refuse("no boolean word")
            return word in TRUE_WORDS
        if not isinstance(value, int):
            refuse("no boolean")
        return bool(value)
    if kind in ("list", "map") and not isinstance(value, {"list": list, "map": dict}[kind]):
        refuse(f"no {kind}")
    return str(value) if kind == "string" else value


def coerce_column(column: Column, declared: str) -> Column:
    """The same for a string column: null where the value doesn't fit."""
    kind = ALIASES.get(declared, declared)
    if kind == "boolean":
        word = F.lower(F.trim(column))
        return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
    return column.try_cast({"float": "double", "integer": "bigint", "string": "string"}[kind])
