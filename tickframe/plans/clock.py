"""Advancing time: closed folds per row, recursive SQL, schedules, and loops over ticks."""

from __future__ import annotations

import math
import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def check_interval(interval, name: str = "process") -> float:
    """An interval that advances time, or ValueError naming the node."""
    if isinstance(interval, bool) or not isinstance(interval, int | float) or math.isnan(interval) or interval <= 0:
        raise ValueError(f"{name}: the interval {interval!r} does not advance time")
    return float(interval)


def fold(initial: Column, ticks: int, step: Callable[[Column, Column], Column]) -> Column:
    """The state after ``ticks`` steps of a row that reads only itself: one expression, no shuffle."""
    if ticks <= 0:
        return initial
    return F.aggregate(F.sequence(F.lit(1), F.lit(ticks)), initial, step)


def trajectory(df: DataFrame, initial: Column, ticks: int, step: Callable[[Column, Column], Column], kind: str = "double", value: str = "value") -> DataFrame:
    """One row per tick, 0 to ``ticks``: the states of a row-local recurrence."""
    start = F.array(initial.cast(kind))
    grow = lambda acc, i: F.array_append(acc, step(F.element_at(acc, -1), i))
    states = F.aggregate(F.sequence(F.lit(1), F.lit(ticks)), start, grow) if ticks > 0 else start
    return df.select("*", F.posexplode(states).alias("step", value))


def schedule(processes: DataFrame, end: float, name: str = "process", interval: str = "interval", precision: int = 9) -> DataFrame:
    """(process, fire, read_time, apply_time): each process reads at k * interval and its delta lands one interval later."""
    n = F.floor(F.lit(end) / F.col(interval) + 1e-9).cast("int")
    fires = processes.filter(n > 0).select(name, interval, F.explode(F.sequence(F.lit(0), n - 1)).alias("fire"))
    at = lambda k: F.round(k * F.col(interval), precision)
    return fires.select(name, "fire", at(F.col("fire")).alias("read_time"), at(F.col("fire") + 1).alias("apply_time"))


def next_event(fires: DataFrame, after: float) -> DataFrame:
    return fires.filter(F.col("apply_time") > after).agg(F.min("apply_time").alias("next_time"))


def hold(reader: DataFrame, writer: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Each reader row with the last value written at or before its time: one sort over the union."""
    rows = reader.withColumn("_reads", F.lit(1)).unionByName(writer.select(*keys, time, value).withColumn("_reads", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*keys).orderBy(time, "_reads").rowsBetween(Window.unboundedPreceding, 0)
    held = F.last(F.when(F.col("_reads") == 0, F.col(value)), ignorenulls=True).over(order)
    return rows.withColumn(value, held).filter("_reads = 1").drop("_reads")


def running_state(deltas: DataFrame, keys: list[str], time: list[str], delta: str) -> DataFrame:
    """The state after each additive delta."""
    order = Window.partitionBy(*keys).orderBy(*time).rowsBetween(Window.unboundedPreceding, 0)
    return deltas.withColumn("state", F.sum(delta).over(order))


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder where it is unset and Spark runs in one process."""
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "")
    if not folder and context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="tickframe-")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the plan in the shared checkpoint folder of the session (one of our own only if none is set)."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def loop(state: DataFrame, ticks: int, step: Callable[[DataFrame, int], DataFrame], every: int = 5, halt: Callable[[DataFrame, int], bool] | None = None) -> DataFrame:
    """Ticks that look across rows: ``step`` maps the whole state to the next one.

    The plan is cut every few ticks, so it stays small and a lost executor repeats a few
    ticks at most. ``halt`` may stop after a tick.
    """
    for tick in range(1, ticks + 1):
        state = step(state, tick)
        if tick % every == 0 and tick < ticks:
            state = checkpointed(state)
        if halt is not None and halt(state, tick):
            break
    return state


def varying_intervals(df: DataFrame, end: float, initial: Column, interval: Column, step: Callable[[Column, Column], Column], adapt: Callable[[Column], Column], most: int = 10_000) -> DataFrame:
    """Rows on clocks of their own: the state sets the next interval. Adds time, state, interval, fires.

    A row that is not at ``end`` after ``most`` fires is an error.
    """
    start = F.struct(F.lit(0.0).alias("time"), initial.cast("double").alias("state"), interval.cast("double").alias("interval"), F.lit(0).cast("long").alias("fires"))

    def advance(s, _):
        due = s["time"] + s["interval"] <= end + 1e-9
        new = step(s["state"], s["interval"]).cast("double")
        return F.when(due, F.struct((s["time"] + s["interval"]).alias("time"), new.alias("state"), adapt(new).cast("double").alias("interval"), (s["fires"] + 1).alias("fires"))).otherwise(s)

    return df.withColumn("_run", F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, advance)).select(
        *df.columns, F.when(F.col("_run.time") + F.col("_run.interval") <= end + 1e-9, F.raise_error(F.lit(f"not at the end after {most} fires"))).otherwise(F.col("_run")).alias("_run")
    ).select(*df.columns, "_run.*")


def recursive_closure(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(root, node, depth): everything downstream of each seed, by the shortest way.

    ``edges`` is (upstream, node), ``seeds`` is (node). A round takes only what the round before
    reached first, so many ways to one node count once, cycles end and no depth is too much.
    """
    edges = checkpointed(edges.select("upstream", "node").distinct())
    new = checkpointed(seeds.select(F.col("node").alias("root"), "node").distinct().withColumn("depth", F.lit(0)))
    reached, depth = new, 0
    while not new.isEmpty():
        depth += 1
        step = new.select("root", F.col("node").alias("upstream")).join(edges, "upstream").select("root", "node").distinct()
        new = checkpointed(step.join(reached, ["root", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(new)
        if depth % 10 == 0:
            reached = checkpointed(reached)
    return reached


def depth_layers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, layer): the longest way from a node without dependencies, for ``nodes`` and the ends of ``edges``.

    ValueError on a cycle.
    """
    left = checkpointed(edges.select("upstream", "node").distinct())
    todo = checkpointed(nodes.select("node").union(left.select("node")).union(left.select("upstream")).distinct())
    layers, layer = todo.withColumn("layer", F.lit(0)).limit(0), 0
    while not todo.isEmpty():
        ready = checkpointed(todo.join(left, "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError(f"a cycle holds {', '.join(str(r.node) for r in todo.orderBy('node').limit(5).collect())}")
        layers = layers.unionByName(ready.withColumn("layer", F.lit(layer)))
        todo = checkpointed(todo.join(ready, "node", "left_anti"))
        left = checkpointed(left.join(ready.select(F.col("node").alias("upstream")), "upstream", "left_anti"))
        layer += 1
        if layer % 10 == 0:
            layers = checkpointed(layers)
    return layers
