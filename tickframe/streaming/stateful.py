"""The streaming tier: additive state per key over unbounded deltas, and windowed sums."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def running_totals(deltas: DataFrame, key: str, value: str, scale: int = 2) -> DataFrame:
    """(key, n, total) after each micro-batch, for the keys it touched; state is two numbers per key.

    Values are summed as integers of 10**-scale, so the result doesn't depend on the batches.
    """
    unit = 10**scale
    rows = deltas.select(F.col(key).alias("key"), F.round(F.col(value) * unit).cast("long").alias("units"))

    def update(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0)
        for b in batches:
            n, total = n + len(b), total + int(b["units"].sum())
        state.update((n, total))
        yield pd.DataFrame({"key": [k[0]], "n": [n], "total": [total / unit]})

    kind = rows.schema["key"].dataType.simpleString()
    return rows.groupBy("key").applyInPandasWithState(update, f"key {kind}, n long, total double", "n long, units long", "update", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, width: str, delay: str, keys: list[str], aggregates: list) -> DataFrame:
    """Sums per tumbling window; events later than ``delay`` are dropped."""
    at = F.col(time).cast("timestamp")
    return events.withColumn("_at", at).withWatermark("_at", delay).groupBy(F.window("_at", width), *keys).agg(*aggregates).select(F.col("window.start").alias("start"), *keys, *[F.col(c) for c in _names(aggregates)])


def _names(aggregates) -> list[str]:
    return [a._jc.toString().rsplit(" AS ", 1)[-1] for a in aggregates]


def to_table(stream: DataFrame, name: str, mode: str, checkpoint: str) -> DataFrame:
    """Run what is available now into an in-memory table; for tests and bounded inputs."""
    query = stream.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
