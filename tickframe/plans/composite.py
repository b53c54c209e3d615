"""A composite: a document of stores and nodes, run over a virtual clock as DataFrames.

Stores are tables keyed by run and entity. Steps run in layers after each change; processes
run on their own intervals: a process reads the state at t and its delta lands at t +
interval. All entities of all runs advance together, so a tick is one plan.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.operators.delta import merged
from tickframe.plans.clock import check_interval, checkpointed
from tickframe.plans.dag import Graph


@dataclass(frozen=True)
class Process:
    """``update(state, interval)`` -> deltas by column; ``rules`` say how each is merged."""

    name: str
    interval: float
    update: Callable[[DataFrame, float], dict]
    rules: dict[str, str] = field(default_factory=dict)


@dataclass
class Composite:
    state: DataFrame
    steps: Graph = field(default_factory=Graph)
    processes: list[Process] = field(default_factory=list)
    bridge: dict[str, str] = field(default_factory=dict)
    emit: Callable[[DataFrame, float], None] | None = None
    time: float = 0.0

    def __post_init__(self):
        for p in self.processes:
            check_interval(p.interval, p.name)
        self.state = self.steps.run(self.state)
        self._due = {p.name: self.time + p.interval for p in self.processes}
        self._pending: dict[str, list[str]] = {}
        for p in self.processes:
            self._read(p)

    def _read(self, p: Process) -> None:
        """The delta is computed from the state now and kept in columns until it lands."""
        deltas = p.update(self.state, p.interval)
        self._pending[p.name] = list(deltas)
        self.state = self.state.withColumns({f"_{p.name}_{c}": d for c, d in deltas.items()})

    def run(self, interval: float, cut_every: int = 10) -> Composite:
        end, rounds = self.time + interval, 0
        while self._due and (now := min(self._due.values())) <= end + 1e-9:
            due = [p for p in self.processes if abs(self._due[p.name] - now) < 1e-9]
            columns = {}
            for p in due:
                for c in self._pending[p.name]:
                    rule = p.rules.get(c, "add")
                    columns[c] = merged(columns.get(c, F.col(c)), F.col(f"_{p.name}_{c}"), rule)
            changed = {c for p in due for c in self._pending[p.name]}
            self.state = self.steps.run(self.state.withColumns(columns), changed)
            self.time = now
            if self.emit:
                self.emit(self.visible(), now)
            for p in due:
                self._due[p.name] = now + p.interval
                self._read(p)
            rounds += 1
            if rounds % cut_every == 0:
                self.state = checkpointed(self.state)
        self.time = end
        return self

    def visible(self) -> DataFrame:
        return self.state.select(*[c for c in self.state.columns if not c.startswith("_")])

    def read_bridge(self) -> DataFrame:
        """Only what the bridge exposes: outer name <- column."""
        return self.state.select(*[F.col(c).alias(outer) for outer, c in self.bridge.items()])

    def save(self, folder: str) -> None:
        self.visible().write.mode("overwrite").parquet(f"{folder}/state")
        text = json.dumps({"time": self.time, "bridge": self.bridge, "schema": json.loads(self.visible().schema.json())})
        self.state.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/document")
