"""The stream operators: mix, collect, combine, group, join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mix(*streams: DataFrame) -> DataFrame:
    """All rows of all streams, duplicates kept; columns go by name, missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), streams)


def collect(stream: DataFrame, *order: str, into: str = "collected") -> DataFrame:
    """The stream as one array in one row. It holds all rows, so it is for streams that fit a task."""
    keys = [*order, *(c for c in stream.columns if c not in order)]
    return stream.agg(F.sort_array(F.collect_list(F.struct(*keys))).alias(into))


def combine(a: DataFrame, b: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """Every pair of a row of ``a`` and a row of ``b``, as two structs. The product is the result asked for."""
    return a.select(F.struct("*").alias(left)).crossJoin(b.select(F.struct("*").alias(right)))


def group(stream: DataFrame, key: str, into: str = "items") -> DataFrame:
    """One row per key with the array of its rows, in row order of the columns."""
    rest = [c for c in stream.columns if c != key]
    return stream.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(*rest))).alias(into))


def join(left: DataFrame, right: DataFrame, on: list[str], null_keys_match: bool = True) -> DataFrame:
    """Inner equi-join on shared columns; matches fan out, and the right side wins on other shared columns.

    Null keys equal each other unless ``null_keys_match`` is off; the null-safe comparison is
    still an equi-join, so Spark hashes or sorts on the keys.
    """
    held = right.select(*[F.col(c).alias(f"_right_{c}") for c in right.columns])
    tests = [F.col(k).eqNullSafe(F.col(f"_right_{k}")) if null_keys_match else F.col(k) == F.col(f"_right_{k}") for k in on]
    both = left.join(held, reduce(lambda a, b: a & b, tests))
    names = [F.col(c) if c not in right.columns or c in on else F.col(f"_right_{c}").alias(c) for c in left.columns]
    return both.select(*names, *[F.col(f"_right_{c}").alias(c) for c in right.columns if c not in left.columns])
