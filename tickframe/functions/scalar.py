"""Scalar functions on columns and on driver-side values."""

from __future__ import annotations

import hashlib
import json
import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Factors to the base unit of each dimension.
UNITS = {"g": ("mass", 1.0), "kg": ("mass", 1e3), "mg": ("mass", 1e-3), "ug": ("mass", 1e-6), "ng": ("mass", 1e-9), "pg": ("mass", 1e-12), "fg": ("mass", 1e-15), "s": ("time", 1.0), "ms": ("time", 1e-3), "min": ("time", 60.0), "h": ("time", 3600.0), "m": ("length", 1.0), "mm": ("length", 1e-3), "um": ("length", 1e-6), "nm": ("length", 1e-9), "L": ("volume", 1.0), "mL": ("volume", 1e-3), "uL": ("volume", 1e-6), "fL": ("volume", 1e-15)}


def unit_factor(source: str, target: str) -> float:
    """What to multiply a value in ``source`` units by to have it in ``target`` units."""
    (a, x), (b, y) = UNITS[source], UNITS[target]
    if a != b:
        raise ValueError(f"{source} and {target} measure different things")
    return float(f"{x / y:.12g}")


def scaled(column: Column, source: str, target: str) -> Column:
    return column * F.lit(unit_factor(source, target))


def axis_label(name: str, units: str | None) -> str:
    """``name (units)``; units that are there already are not added again."""
    return name if not units or name.endswith(f"({units})") else f"{name} ({units})"


def whole(value):
    """Floats without a fraction become integers, at any depth; booleans stay."""
    if isinstance(value, dict):
        return {k: whole(v) for k, v in value.items()}
    if isinstance(value, list | tuple):
        return [whole(v) for v in value]
    return int(value) if isinstance(value, float) and math.isfinite(value) and value == int(value) else value


def canonical_json(value) -> str:
    """One spelling for equal values: sorted keys, no blanks, whole floats as integers."""
    return json.dumps(whole(value), sort_keys=True, separators=(",", ":"))


def artifact_address(name: str, config: dict | None, inputs=(), commit: str | None = "") -> str:
    """16 hex digits that depend on what was computed from what."""
    lines = [name, canonical_json(config or {}), "\n".join(sorted(inputs or ())), commit or ""]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:16]


def address_column(name: Column, config: Column, inputs: Column, commit: Column) -> Column:
    """The same for columns; ``config`` is canonical JSON text, ``inputs`` an array of addresses."""
    return F.substring(F.sha2(F.concat_ws("\n", name, config, F.array_join(F.array_sort(inputs), "\n"), F.coalesce(commit, F.lit(""))), 256), 1, 16)


def canonical_struct(**columns: Column) -> Column:
    """Canonical JSON text of named columns: names in order, null for nulls."""
    return F.to_json(F.struct(*[columns[k].alias(k) for k in sorted(columns)]), {"ignoreNullFields": "false"})


def narrowed(column: Column) -> Column:
    """A double as text, whole numbers without a fraction."""
    return F.when(column == F.floor(column), F.floor(column).cast("string")).otherwise(column.cast("string"))


def fingerprint(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


_PLACE = re.compile(r"\$\{(\w+)\}")


def substitute(document, values: dict):
    """Fill ``${name}`` in every string; a string that is one placeholder takes the value's own type."""
    if isinstance(document, dict):
        return {k: substitute(v, values) for k, v in document.items()}
    if isinstance(document, list):
        return [substitute(v, values) for v in document]
    if not isinstance(document, str):
        return document
    if m := _PLACE.fullmatch(document):
        return values[m[1]]
    return _PLACE.sub(lambda m: str(values[m[1]]), document)


def substitute_column(template: Column, **values: Column) -> Column:
    for name, value in values.items():
        template = F.replace(template, F.lit("${" + name + "}"), value.cast("string"))
    return template


def parameter_key(value) -> str:
    """A readable key of nested parameters: {a:1,b:{c:2}}."""
    return "{" + ",".join(f"{k}:{parameter_key(v)}" for k, v in value.items()) + "}" if isinstance(value, dict) else str(value)


def run_label(params: Column, name: Column, run_id: Column) -> Column:
    """k=v pairs of a map of parameters; else the name; else the last six characters of the id."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries(params)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    return F.coalesce(F.nullif(pairs, F.lit("")), F.nullif(name, F.lit("")), F.right(run_id, F.lit(6)))


def html_escape(column: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        column = F.replace(column, F.lit(raw), F.lit(safe))
    return column


def element_id(column: Column) -> Column:
    return F.substring(F.sha1(column), 1, 8)


def path_column(path: Column) -> Column:
    """a.b/c -> a_b_c, with - as _."""
    return F.translate(path, "./-", "___")


def path_prefixes(path: str) -> list[str]:
    """Every prefix of a path, the empty one included."""
    parts = [p for p in path.split("/") if p]
    return ["/".join(parts[:k]) for k in range(len(parts) + 1)]


def git_address(column: Column) -> Column:
    """owner/repo@ref#module:function, taken apart."""
    pattern = r"^([^/@#]+)/([^/@#]+)@([^#]+)#([^:]+):(.+)$"
    return F.struct(*[F.regexp_extract(column, pattern, k + 1).alias(n) for k, n in enumerate(("owner", "repo", "ref", "module", "function"))])


def interval_values(spec) -> list:
    """[lo, hi], {0: lo, 1: hi}, {"low": lo, "high": hi} or one number, as a list."""
    if isinstance(spec, dict):
        if set(spec) <= {"low", "high"}:
            return [spec[k] for k in ("low", "high") if k in spec]
        return [spec[k] for k in sorted(spec, key=lambda k: int(k))]
    return list(spec) if isinstance(spec, list | tuple) else [spec]


def rounded(column: Column, digits: int) -> Column:
    """Half-up rounding that agrees between engines: floor(x * 10**d + 0.5) / 10**d."""
    scale = float(10**digits)
    return F.floor(column * scale + 0.5) / scale


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def add_arrays(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def add_at(a: Column, deltas: Column) -> Column:
    """An array plus a map of index -> delta."""
    return F.transform(a, lambda x, i: x + F.coalesce(F.element_at(deltas, i.cast("string")), F.lit(0.0)))
