"""Rewriting a place graph kept as a node table (run, node, parent, control), and stochastic choice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class MoveRule:
    """A node of ``control`` inside a parent of control ``inside`` moves to a sibling of control ``into``."""

    label: str
    control: str
    inside: str
    into: str
    rate: float = 1.0


def matches(nodes: DataFrame, rules: list[MoveRule]) -> DataFrame:
    """(run, rule, label, rate, node, target): every place where a rule's pattern occurs."""
    spark = nodes.sparkSession
    table = spark.createDataFrame([(k, r.label, r.control, r.inside, r.into, float(r.rate)) for k, r in enumerate(rules)], "rule int, label string, control string, inside string, into string, rate double")
    child = nodes.select("run", F.col("node"), F.col("parent"), F.col("control"))
    parent = nodes.select("run", F.col("node").alias("parent"), F.col("control").alias("inside"))
    # Only the nodes that can be targets of some rule meet the movers of their parent.
    target = nodes.select("run", F.col("parent"), F.col("node").alias("target"), F.col("control").alias("into"))
    movers = child.join(parent, ["run", "parent"]).join(F.broadcast(table), ["control", "inside"])
    return movers.join(target, ["run", "parent", "into"]).filter("node != target").select("run", "rule", "label", "rate", "node", "target")


def first_match(found: DataFrame) -> DataFrame:
    """Per run the first match of the first rule: one aggregate, no sort."""
    pick = F.min(F.struct("rule", "node", "target", "label")).alias("m")
    return found.groupBy("run").agg(pick).select("run", "m.rule", "m.label", "m.node", "m.target")


def weighted_pick(found: DataFrame, run: list[str], order: list[str], weight: str, draw) -> DataFrame:
    """Per run the first candidate whose cumulative weight reaches draw * total; ``draw`` is a Column in [0, 1)."""
    upto = Window.partitionBy(*run).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*run)
    ranked = found.withColumn("cumulative", F.sum(weight).over(upto)).withColumn("total", F.sum(weight).over(whole))
    return ranked.filter(F.col("cumulative") >= draw * F.col("total")).groupBy(*run).agg(F.min(F.struct(*order, "cumulative", "total")).alias("m")).select(*run, "m.*")


def fire(nodes: DataFrame, picked: DataFrame) -> DataFrame:
    """The node table after the picked moves."""
    moved = picked.select("run", "node", F.col("target").alias("_target"))
    return nodes.join(moved, ["run", "node"], "left").withColumn("parent", F.coalesce("_target", "parent")).drop("_target")


def gillespie(nodes: DataFrame, rules: list[MoveRule], interval: float, most: int = 100_000, seed: int = 0) -> DataFrame:
    """(run, event, time, label, node, target): exact stochastic simulation of each run over ``interval``.

    Rates depend on the state after each event, so a run is simulated by one task; runs are
    spread over tasks. An event changes the match counts of two parents only. Draws are seeded
    by run, so reruns agree. A run that is not at its end after ``most`` events is an error.
    """
    import hashlib
    import math
    import random
    from bisect import insort

    import pandas as pd

    def simulate(pdf: pd.DataFrame) -> pd.DataFrame:
        run = pdf["run"].iloc[0]
        rng = random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{run}".encode()).digest()[:8], "big"))
        place, kind = dict(zip(pdf["node"], pdf["parent"], strict=True)), dict(zip(pdf["node"], pdf["control"], strict=True))
        inside: dict = {}
        for n in sorted(place):
            inside.setdefault(place[n], {}).setdefault(kind[n], []).append(n)
        rate: dict = {}

        def count(p):
            for k, r in enumerate(rules):
                if kind.get(p) == r.inside:
                    here = inside.get(p, {})
                    rate[k, p] = r.rate * len(here.get(r.control, ())) * max(0, len(here.get(r.into, ())) - (r.control == r.into))

        for p in sorted(p for p in inside if p in kind):
            count(p)
        t, events = 0.0, []
        while (total := sum(rate.values())) > 0:
            t += -math.log(1.0 - rng.random()) / total
            if t > interval:
                break
            if len(events) == most:
                raise ValueError(f"run {run}: not at the end after {most} events")
            left = rng.random() * total
            possible = [x for x in rate if rate[x] > 0]
            for x in possible:
                if left < rate[x]:
                    break
                left -= rate[x]
            rule, p = rules[x[0]], x[1]
            movers, targets = inside[p][rule.control], inside[p][rule.into]
            same = rule.control == rule.into
            others = len(targets) - same
            pair = min(int(left / rule.rate), len(movers) * others - 1)
            i, j = divmod(pair, others)
            n, s = movers[i], targets[j + (same and j >= i)]
            movers.remove(n)
            insort(inside.setdefault(s, {}).setdefault(kind[n], []), n)
            place[n] = s
            count(p)
            count(s)
            events.append((run, len(events), t, rule.label, n, s))
        return pd.DataFrame(events, columns=["run", "event", "time", "label", "node", "target"])

    return nodes.groupBy("run").applyInPandas(simulate, "run string, event long, time double, label string, node string, target string")
