"""Reductions of histories and sweeps: what the plots show, without the plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(samples: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """bin (from 0), lower edge and count; values outside [low, high) fall in no bin."""
    width = (high - low) / bins
    inside = samples.filter((F.col(value) >= low) & (F.col(value) < high))
    k = F.floor((F.col(value) - low) / width).cast("bigint")
    return inside.groupBy(k.alias("bin")).agg(F.count("*").alias("n")).select("bin", (low + F.col("bin") * width).alias("lower"), "n")


def heatmap(sweep: DataFrame, x: str, y: str, z: Column, columns: list) -> DataFrame:
    """One row per y, one column per x; the x values are stated, so Spark needs no extra pass."""
    return sweep.groupBy(y).pivot(x, columns).agg(z)


def final_by_parameter(history: DataFrame, run: str, parameter: str, time: list[str], value: str) -> DataFrame:
    """(parameter, last value) of every run, sorted."""
    last = history.groupBy(run).agg(F.max_by(parameter, F.struct(*time)).alias("x"), F.max_by(value, F.struct(*time)).alias("y"))
    return last.select(run, "x", "y").orderBy("x", "y", run)


def phase_space(history: DataFrame, run: list[str], time: str, observable: str, value: str, x, y) -> DataFrame:
    """(x, y) pairs of two observables at equal times, in one aggregation instead of a self-join."""
    pick = lambda name: F.max(F.when(F.col(observable) == name, F.col(value)))
    return history.filter(F.col(observable).isin(x, y)).groupBy(*run, time).agg(pick(x).alias("x"), pick(y).alias("y")).filter("x is not null and y is not null")


def time_series(history: DataFrame, run: list[str], time: str, values: list[str]) -> DataFrame:
    """Ordered arrays per run, one per observable, and the times."""
    rows = F.sort_array(F.collect_list(F.struct(time, *values)))
    return history.groupBy(*run).agg(rows.alias("_rows")).select(*run, *[F.col(f"_rows.{c}").alias(c) for c in (time, *values)])


def timing_summary(calls: DataFrame, path: str, seconds: Column) -> DataFrame:
    """Seconds and share of the total per path."""
    per = calls.groupBy(path).agg(F.sum(seconds).alias("seconds"))
    return per.withColumn("share", F.col("seconds") / F.sum("seconds").over(Window.partitionBy()))


def verdict(value: Column, threshold) -> Column:
    return F.when(value >= threshold, "pass").otherwise("fail")


def neighbourhood(pool: DataFrame, run: str, member: str, value: str) -> DataFrame:
    """Per member: sum and count of the others in its pool, and the other with the largest value (ties: smallest id).

    The pool's first two members are enough to know the best other one, so a pool is one
    aggregate row, whatever its size.
    """
    best = F.struct((-F.col(value)).alias("v"), F.col(member).alias("m"))
    first = pool.groupBy(run).agg(F.sum(value).alias("_sum"), F.count("*").alias("_n"), F.min(best).alias("_first"))
    joined = pool.join(first, run)
    second = joined.filter(F.col(member) != F.col("_first.m")).groupBy(run).agg(F.min(best).alias("_second"))
    joined = joined.join(second, run, "left")
    peer = F.when(F.col(member) == F.col("_first.m"), F.col("_second.m")).otherwise(F.col("_first.m"))
    return joined.select(run, member, (F.col("_sum") - F.col(value)).alias("others_sum"), (F.col("_n") - 1).alias("others_n"), peer.alias("best_peer"))


def value_summary(array: Column) -> Column:
    """Size, sum and the first five values of an array."""
    total = F.aggregate(array, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.struct(F.size(array).alias("size"), total.alias("total"), F.slice(array, 1, 5).alias("head"))
