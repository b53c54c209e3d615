"""Templates: documents with holes, and pull-or-compute of their parts."""

from __future__ import annotations

import copy
import json
from collections.abc import Callable

from pyspark.sql import DataFrame

from tickframe.plans.dag import topological_order


def is_site(value) -> bool:
    return isinstance(value, dict) and value.get("_type") == "site"


def open_sites(document, path=()) -> dict[tuple, dict]:
    """path -> site for every hole."""
    if is_site(document):
        return {path: document}
    found = {}
    if isinstance(document, dict):
        for k, v in document.items():
            found |= open_sites(v, (*path, k))
    return found


def required_sites(document) -> dict[tuple, dict]:
    return {p: s for p, s in open_sites(document).items() if "_default" not in s}


def is_ground(document) -> bool:
    return not open_sites(document)


def fill(document, values: dict):
    """The document with holes filled, by name of the last path segment; defaults fill the others."""
    missing = []

    def walk(node, path):
        if is_site(node):
            if path and path[-1] in values:
                return copy.deepcopy(values[path[-1]])
            if "_default" in node:
                return copy.deepcopy(node["_default"])
            missing.append("/".join(path))
            return node
        return {k: walk(v, (*path, k)) for k, v in node.items()} if isinstance(node, dict) else node

    out = walk(document, ())
    if missing:
        raise ValueError(f"holes without a value: {missing}")
    return out


def prune(members: dict[str, dict]) -> tuple[dict[str, dict], set[str]]:
    """(members that can run, blocked names): a member with a hole blocks all downstream of it.

    A member is {"upstream": [...], ...}.
    """
    blocked = {k for k, m in members.items() if required_sites(m)}
    while more := {k for k, m in members.items() if set(m.get("upstream", ())) & blocked} - blocked:
        blocked |= more
    return {k: m for k, m in members.items() if k not in blocked}, blocked


def ancestors(members: dict[str, dict], target: str) -> list[str]:
    """The target's transitive upstream members, first things first; a cycle raises CycleError."""
    needed, todo = set(), [target]
    while todo:
        name = todo.pop()
        for up in members[name].get("upstream", ()):
            if up not in needed:
                needed.add(up)
                todo.append(up)
    return [n for n in topological_order({k: set(members[k].get("upstream", ())) & (needed | {target}) for k in needed | {target}}) if n != target]


def trigger(members: dict[str, dict], target: str, stored: Callable[[str], DataFrame | None], compute: Callable[[str, dict[str, DataFrame]], DataFrame], on_missing: str = "compute") -> tuple[DataFrame, dict[str, str]]:
    """Run one member: upstream results that are stored are read, others are computed (or refused).

    Nothing above a stored result is touched. Returns the result and what was done by name.
    """
    done: dict[str, str] = {}
    results: dict[str, DataFrame] = {}

    def need(name: str) -> DataFrame:
        if name not in results:
            held = stored(name) if name != target else None
            if held is None and name != target and on_missing == "fail":
                raise LookupError(f"{name} is not stored")
            done[name] = "computed" if held is None else "pulled"
            results[name] = held if held is not None else compute(name, {u: need(u) for u in members[name].get("upstream", ())})
        return results[name]

    ancestors(members, target)  # a cycle is an error before anything runs
    out = need(target)
    return out, {k: done.get(k, "pruned") for k in members}


def load_mapping(path: str) -> dict:
    """A JSON (or, with PyYAML, YAML) file that holds a mapping."""
    with open(path) as f:
        text = f.read()
    if path.endswith((".yaml", ".yml")):
        import yaml

        data = yaml.safe_load(text)
    else:
        data = json.loads(text)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no mapping")
    return data


def save_template(document: dict, path: str) -> None:
    """Written only if its defaults fill every hole."""
    fill(document, {})
    with open(path, "w") as f:
        json.dump(document, f, indent=2, sort_keys=True)
