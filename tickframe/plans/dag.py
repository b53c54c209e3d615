"""Steps and processes wired into a graph of layers.

A step is a function DataFrame -> columns; the graph orders steps by what they read and
write. Each layer becomes one projection, so a whole cascade stays one Spark plan.
"""

from __future__ import annotations

import graphlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """``compute`` maps input port -> Column to output port -> Column; wires map ports to columns.

    ``when`` skips rows (their outputs stay); ``silent`` inputs are read but don't trigger;
    ``priority`` breaks cycles; ``draft`` steps compute nothing.
    """

    name: str
    inputs: dict[str, str]
    outputs: dict[str, str]
    compute: Callable[[dict[str, Column]], dict[str, Column]]
    apply: str = "set"
    when: Callable[[dict[str, Column]], Column] | None = None
    silent: frozenset = frozenset()
    priority: float = 0.0
    draft: bool = False

    def triggers(self) -> set[str]:
        return {c for p, c in self.inputs.items() if p not in self.silent}


@dataclass
class Graph:
    steps: dict[str, Step] = field(default_factory=dict)

    def add(self, *steps: Step) -> Graph:
        for s in steps:
            if s.name in self.steps:
                raise ValueError(f"two steps are named {s.name}")
            self.steps[s.name] = s
        return self

    def needs(self) -> dict[str, set[str]]:
        """Which steps each step waits for: those that write, at or under or over, what it reads."""
        out = {}
        for a in self.steps.values():
            out[a.name] = {b.name for b in self.steps.values() if b is not a and any(overlaps(r, w) for r in a.inputs.values() for w in b.outputs.values())}
        return out

    def layers(self) -> list[list[str]]:
        """Steps by depth; in a cycle the step of highest priority goes first."""
        needs, done, out = self.needs(), set(), []
        while len(done) < len(needs):
            ready = sorted(n for n, d in needs.items() if n not in done and d <= done)
            if not ready:
                left = [self.steps[n] for n in needs if n not in done]
                ready = [max(left, key=lambda s: (s.priority, s.name)).name]
            out.append(ready)
            done |= set(ready)
        return out

    def triggered(self, changed: set[str]) -> list[list[str]]:
        """The layers that a change of these columns sets off, each step once."""
        touched, out = set(changed), []
        for layer in self.layers():
            hit = [n for n in layer if any(overlaps(t, c) for t in self.steps[n].triggers() for c in touched)]
            if hit:
                out.append(hit)
                for n in hit:
                    touched |= set(self.steps[n].outputs.values())
        return out

    def downstream(self, names: set[str]) -> set[str]:
        """These steps and all that depend on them."""
        needs, found = self.needs(), set(names)
        while more := {n for n, d in needs.items() if d & found} - found:
            found |= more
        return found

    def run(self, state: DataFrame, changed: set[str] | None = None) -> DataFrame:
        for layer in self.layers() if changed is None else self.triggered(changed):
            # All steps of a layer read the state before it; what they write to one column is folded in their order.
            columns: dict[str, Column] = {}
            for name in layer:
                columns |= self._outputs(self.steps[name], state, columns)
            state = state.withColumns(columns)
        return state

    @staticmethod
    def _outputs(step: Step, state: DataFrame, written: dict[str, Column]) -> dict[str, Column]:
        if step.draft:
            return {}
        ports = {p: F.col(c) if c in state.columns else F.lit(0.0) for p, c in step.inputs.items()}
        out = {}
        for port, value in step.compute(ports).items():
            name = step.outputs[port]
            old = written.get(name, F.col(name) if name in state.columns else None)
            if step.apply == "add" and old is not None:
                value = F.coalesce(old, F.lit(0.0)) + value
            if step.when is not None:
                value = F.when(step.when(ports), value).otherwise(old if old is not None else F.lit(None))
            out[name] = value
        return out


def overlaps(a: str, b: str) -> bool:
    """Two paths meet if one is a prefix of the other; ``*`` stands for any segment."""
    return all(x == y or "*" in (x, y) for x, y in zip(a.split("/"), b.split("/"), strict=False))


def operator_step(name: str, operator: str, a: str, b: str, c: str) -> Step:
    how = {"+": lambda p: p["a"] + p["b"], "-": lambda p: p["a"] - p["b"], "*": lambda p: p["a"] * p["b"], "/": lambda p: p["a"] / p["b"]}[operator]
    return Step(name, {"a": a, "b": b}, {"c": c}, lambda p: {"c": how(p)})


def topological_order(needs: dict[str, set[str]]) -> list[str]:
    """Dependencies first, ties by name; a cycle raises graphlib.CycleError."""
    sorter = graphlib.TopologicalSorter(needs)
    sorter.prepare()
    out, ready = [], []
    while sorter.is_active():
        ready = sorted([*ready, *sorter.get_ready()])
        out.append(ready.pop(0))
        sorter.done(out[-1])
    return out


class Registry:
    """Named steps and generators, with a decorator for functions on columns."""

    def __init__(self):
        self.steps: dict[str, Callable[..., Step]] = {}
        self.generators: dict[str, tuple[Callable, dict]] = {}

    def step(self, inputs: list[str], outputs: list[str], **options):
        """Register a function (ports, **config) -> columns; its keyword defaults are the configuration."""

        def wrap(function):
            defaults = dict(function.__kwdefaults__ or {})

            def make(name: str, wires_in: dict[str, str], wires_out: dict[str, str], **config) -> Step:
                if unknown := set(config) - set(defaults):
                    raise ValueError(f"{function.__name__} has no configuration {sorted(unknown)}")
                if missing := set(inputs) - set(wires_in) | set(outputs) - set(wires_out):
                    raise ValueError(f"{name}: ports without a wire: {sorted(missing)}")
                settings = defaults | config
                return Step(name, wires_in, wires_out, lambda p: function(p, **settings), **options)

            self.steps[function.__name__] = make
            return function

        return wrap

    def generator(self, **parameters):
        """Register a function of parameters that builds a Graph; name=(type, default)."""

        def wrap(function):
            self.generators[function.__name__] = (function, parameters)
            return function

        return wrap

    def build(self, name: str, **overrides) -> Graph:
        from tickframe.functions.typing import coerce_value

        function, parameters = self.generators[name]
        if unknown := set(overrides) - set(parameters):
            raise ValueError(f"{name} has no parameter {sorted(unknown)}")
        return function(**{k: coerce_value(overrides.get(k, default), kind, k) for k, (kind, default) in parameters.items()})

    def snapshot(self) -> dict[str, list[str]]:
        return {"steps": sorted(self.steps), "generators": sorted(self.generators)}


def without(graph: Graph, names: set[str]) -> Graph:
    """The graph without these steps and what depends on them."""
    gone = graph.downstream(names)
    return Graph({k: s for k, s in graph.steps.items() if k not in gone})


def rewired(graph: Graph, name: str, **outputs: str) -> Graph:
    step = graph.steps[name]
    return Graph(graph.steps | {name: replace(step, outputs=step.outputs | outputs)})
