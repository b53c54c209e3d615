"""Sweeps with a result store: each match is computed once, whatever runs ask for it."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.functions.scalar import address_column
from tickframe.plans.dag import topological_order
from tickframe.sources.artifacts import Store


@dataclass(frozen=True)
class RunResult:
    name: str
    status: str
    seconds: float
    result: DataFrame | None = None
    error: str | None = None


def run_workflow(nodes: dict[str, tuple[list[str], Callable[..., DataFrame]]]) -> list[RunResult]:
    """Nodes (name -> (needs, function)) in dependency order; a failure is a result, and blocks what needs it."""
    done: dict[str, RunResult] = {}
    for name in topological_order({k: set(n) for k, (n, _) in nodes.items()}):
        needs, function = nodes[name]
        if bad := [n for n in needs if done[n].status != "succeeded"]:
            done[name] = RunResult(name, "blocked", 0.0, error=f"needs {bad}")
            continue
        began = time.perf_counter()
        try:
            done[name] = RunResult(name, "succeeded", 0.0, function(*[done[n].result for n in needs]))
        except Exception as e:  # noqa: BLE001  a node's failure is the workflow's data
            done[name] = RunResult(name, "failed", time.perf_counter() - began, error=f"{type(e).__name__}: {e}")
            continue
        done[name] = RunResult(name, "succeeded", time.perf_counter() - began, done[name].result)
    return list(done.values())


def provenance(results: list[RunResult], spark) -> DataFrame:
    return spark.createDataFrame([(r.name, r.status, r.seconds, r.error) for r in results], "node string, status string, seconds double, error string")


def addressed(matches: DataFrame, name: str, config: list[str], commit: str = "") -> DataFrame:
    """``matches`` with the content address of each one's configuration."""
    text = F.to_json(F.struct(*sorted(config)), {"ignoreNullFields": "false"})
    return matches.withColumn("address", address_column(F.lit(name), text, F.array().cast("array<string>"), F.lit(commit)))


def sweep_with_store(matches: DataFrame, name: str, config: list[str], compute: Callable[[DataFrame], DataFrame], store: Store) -> DataFrame:
    """(match columns, outputs, address, cache_hit): stored matches are read, the others computed in one job and stored.

    ``compute`` adds columns to the matches it is given. Every run adds one part to the store
    and never rewrites another, so a run that is lost leaves what others stored.
    """
    wanted = addressed(matches, name, config)
    key = f"sweep-{name}"
    parts = [store.read(p) for p in store.parts(key)]
    if not parts:
        return store.write(f"{key}/{uuid.uuid4().hex}", compute(wanted)).withColumn("cache_hit", F.lit(False))
    held = reduce(DataFrame.unionByName, parts).dropDuplicates(["address"])
    new = store.write(f"{key}/{uuid.uuid4().hex}", compute(wanted.join(held.select("address"), "address", "left_anti")))
    old = wanted.select("address").join(held, "address").withColumn("cache_hit", F.lit(True))
    return old.unionByName(new.withColumn("cache_hit", F.lit(False)))


class Memo:
    """Results kept by step name and inputs' addresses, for the life of the object."""

    def __init__(self):
        self.held: dict[tuple, DataFrame] = {}
        self.hits = 0

    def __call__(self, name: str, inputs: tuple[str, ...], compute: Callable[[], DataFrame]) -> DataFrame:
        key = (name, *sorted(inputs))
        if key in self.held:
            self.hits += 1
        else:
            self.held[key] = compute()
        return self.held[key]
