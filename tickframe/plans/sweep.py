"""Parameter sweeps and scatter: runs are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def grid(spark: SparkSession, **ranges: list[float]) -> DataFrame:
    """(run_id, parameters...): one row per combination, the first parameter varying slowest.

    The ranges are literals, so the product is generated on the executors by explode.
    """
    df = spark.range(1).select()
    for name, values in ranges.items():
        df = df.select("*", F.explode(F.array(*[F.lit(float(v)) for v in values])).alias(name))
    return df.select(F.format_string(",".join(f"{n}=%s" for n in ranges), *[F.col(n).cast("string") for n in ranges]).alias("run_id"), *ranges)


def over(df: DataFrame, runs: DataFrame) -> DataFrame:
    """Every row in every run. ``runs`` comes from grid(), whose size is stated by the caller."""
    return df.crossJoin(runs)


def scatter(matches: DataFrame, key: str, compute: dict[str, Column]) -> DataFrame:
    """One run per match: (match_key, outputs)."""
    return matches.select(F.col(key).cast("string").alias("match_key"), *[c.alias(n) for n, c in compute.items()])


def gather(results: DataFrame, by: list[str], port: str) -> DataFrame:
    """The results of all matches as one map per group."""
    entries = F.sort_array(F.collect_list(F.struct("match_key", port)))
    return results.groupBy(*by).agg(F.map_from_entries(entries).alias(port))
