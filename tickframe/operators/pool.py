"""Populations whose members remove, spawn and rewire each other, tick by tick."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Policy:
    """Thresholds of a pool's members."""

    spawn_above: float = 3.0
    remove_below: float = -3.0
    most: int = 15
    spawn_value: float = 0.5
    spawn_factor: float = 0.625
    weak_growth: float = 0.6
    decline: float = -0.5


def pool_tick(pool: DataFrame, tick: int, policy: Policy = Policy()) -> DataFrame:
    """One tick of (run, agent, value, growth, spawn_growth); every member sees the pool as it was.

    In order: a member that would fall below the limit leaves; one that sees others below it
    removes them; one that would rise above the limit resets and spawns a member, if there is
    room; else it grows. One aggregate per pool and one explode; pools are never collected.
    """
    v, projected = F.col("value"), F.col("value") + F.col("growth")
    low, leaving = v < policy.remove_below, projected < policy.remove_below
    seen = pool.groupBy("run").agg(F.count("*").alias("_n"), F.sum(low.cast("int")).alias("_low"), F.sum((~leaving).cast("int")).alias("_stay"))
    rows = pool.join(seen, "run").withColumns({"_leaves": leaving, "_is_low": low})
    removed = F.col("_leaves") | (F.col("_is_low") & (F.col("_stay") - (~F.col("_leaves")).cast("int") > 0))
    sees_low = F.col("_low") - F.col("_is_low").cast("int") > 0
    spawns = ~sees_low & (projected > policy.spawn_above) & (F.col("_n") < policy.most) & (F.col("spawn_growth") != 0)
    rows = rows.filter(~removed).withColumn("_spawns", spawns)
    next_growth = F.col("spawn_growth") * policy.spawn_factor
    next_growth = F.when((next_growth > 0) & (next_growth < policy.weak_growth), policy.decline).otherwise(next_growth)
    child = F.explode(F.when(F.col("_spawns"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_child")
    rows = rows.select("*", child)
    new = F.col("_child") == 1
    return rows.select(
        "run",
        F.when(new, F.concat_ws("_", "agent", F.lit(tick))).otherwise(F.col("agent")).alias("agent"),
        F.when(F.col("_spawns"), F.lit(policy.spawn_value)).otherwise(projected).alias("value"),
        F.when(new, F.col("spawn_growth")).otherwise(F.col("growth")).alias("growth"),
        F.when(new, next_growth).otherwise(F.col("spawn_growth")).alias("spawn_growth"),
    )


def rewire(pool: DataFrame, run: str, member: str, value: str, threshold) -> DataFrame:
    """Adds ``target``: the peer with the largest value for members whose peers' sum exceeds the threshold, else the member itself."""
    from tickframe.operators.analysis import neighbourhood

    seen = neighbourhood(pool, run, member, value)
    target = F.when((F.col("others_sum") > threshold) & F.col("best_peer").isNotNull(), F.col("best_peer")).otherwise(F.col(member))
    return pool.join(seen.select(run, member, target.alias("target")), [run, member])


def deliver(pool: DataFrame, run: str, member: str, value: str, delta: Column) -> DataFrame:
    """Every member's delta added to the value of its target."""
    sent = pool.select(run, F.col("target").alias(member), delta.alias("_delta")).groupBy(run, member).agg(F.sum("_delta").alias("_delta"))
    return pool.join(sent, [run, member], "left").withColumn(value, F.col(value) + F.coalesce("_delta", F.lit(0))).drop("_delta")


def create_and_annihilate(pool: DataFrame, key: str, create: float, annihilate: float, seed: int) -> DataFrame:
    """Members leave with one probability and are copied under a new key with another; draws are hashes of key and seed."""
    u = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    rows = pool.withColumn("_u", u).filter(F.col("_u") >= annihilate)
    copies = F.explode(F.when(F.col("_u") >= 1 - create, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy")
    rows = rows.select("*", copies)
    return rows.withColumn(key, F.when(F.col("_copy") == 1, F.concat(F.col(key), F.lit("'"))).otherwise(F.col(key))).drop("_u", "_copy")
