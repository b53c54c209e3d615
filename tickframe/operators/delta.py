"""Deltas: reconcile them into one per key, apply them to a store, change which keys there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def reconcile(deltas: DataFrame, keys: list[str], rules: dict[str, str], order: list[str] = ()) -> DataFrame:
    """One delta per key: ``add`` sums, ``set`` takes the last by ``order``, ``extend`` concatenates in order."""
    last = F.struct(*order) if order else None
    how = {
        "add": lambda c: F.sum(c),
        "set": lambda c: F.max_by(c, last) if order else F.any_value(c),
        "extend": lambda c: F.flatten(F.transform(F.sort_array(F.collect_list(F.struct(*order, c))), lambda s: s[c])),
    }
    return deltas.groupBy(*keys).agg(*[how[rule](c).alias(c) for c, rule in rules.items()])


def merged(value: Column, delta: Column, rule: str) -> Column:
    """A value after a delta; a null delta changes nothing."""
    if rule == "add":
        return F.coalesce(value + delta, value, delta)
    if rule == "extend":
        return F.concat(F.coalesce(value, F.array()), F.coalesce(delta, F.array()))
    return F.coalesce(delta, value)


def apply_delta(store: DataFrame, delta: DataFrame, keys: list[str], rules: dict[str, str]) -> DataFrame:
    """``store`` with a reconciled delta merged in; keys that the store doesn't have are dropped."""
    held = delta.select(*keys, *[F.col(c).alias(f"_delta_{c}") for c in rules])
    both = store.join(held, keys, "left")
    return both.select(*[merged(F.col(c), F.col(f"_delta_{c}"), rules[c]).alias(c) if c in rules else F.col(c) for c in store.columns])


def apply_map(value: Column, delta: Column) -> Column:
    """A map of numbers plus a map of deltas; keys that it doesn't have are dropped."""
    return F.transform_values(value, lambda k, v: v + F.coalesce(F.element_at(delta, k), F.lit(0.0)))


def add_rows(store: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows come in; a row with a key that is there replaces it."""
    return store.join(new.select(*keys), keys, "left_anti").unionByName(new.select(*store.columns))


def remove_rows(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys), keys, "left_anti")


def divide_rows(store: DataFrame, condition: Column, key: str, shared: list[str], parts: int = 2) -> DataFrame:
    """Rows that meet the condition are replaced by ``parts`` daughters: key_0, key_1, ...; ``shared`` columns are split evenly.

    One pass without a join: each row is exploded to its daughters, or to itself.
    """
    child = F.explode(F.when(F.coalesce(condition, F.lit(False)), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(-1)))).alias("_child")
    rows = store.select("*", child)
    mother = F.col("_child") < 0
    values = [
        F.when(mother, F.col(c)).otherwise(F.concat_ws("_", F.col(c), F.col("_child"))).alias(c) if c == key else F.when(mother, F.col(c)).otherwise(F.col(c) / parts).alias(c) if c in shared else F.col(c)
        for c in store.columns
    ]
    return rows.select(*values)


def deep_merge(base: DataFrame, overlay: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer merge: the overlay's values win where they are not null. Types must agree."""
    clash = [c for c in base.columns if c in overlay.columns and dict(base.dtypes)[c] != dict(overlay.dtypes)[c]]
    if clash:
        raise ValueError(f"types differ: {clash}")
    held = overlay.select(*keys, *[F.col(c).alias(f"_over_{c}") for c in overlay.columns if c not in keys])
    both = base.join(held, keys, "full_outer")
    every = [*base.columns, *(c for c in overlay.columns if c not in base.columns)]
    return both.select(*[F.col(c) if c in keys else F.coalesce(*[F.col(x) for x in (f"_over_{c}", c) if x in both.columns]).alias(c) for c in every])


def tick_changes(history: DataFrame, run: list[str], step: str, columns: list[str]) -> DataFrame:
    """Each recorded value minus the one before it in its run."""
    from pyspark.sql import Window

    order = Window.partitionBy(*run).orderBy(step)
    return history.withColumns({f"{c}_change": F.col(c) - F.lag(c).over(order) for c in columns})


def distinct_prefixes(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths without those that another path is a proper prefix of."""
    prefixes = F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/"))), lambda k: F.array_join(F.slice(F.split(path, "/"), F.lit(1), k), "/"))
    held = paths.select(path).distinct()
    proper = held.select(path, F.explode(F.filter(prefixes, lambda p: p != F.col(path))).alias("_prefix"))
    covered = proper.join(held.select(F.col(path).alias("_prefix")), "_prefix", "left_semi").select(path)
    return held.join(covered, path, "left_anti")
