"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, target / source size.
Its whole part is taken; the fractions are rounded by pivotal steps: two documents are
paired, mass (copies times words) moves from one to the other in a random direction until
one of the two is at 0 or 1, and the other one goes on with the rest. Each step keeps the
sum of the mass exactly and each expectation, so what a source takes misses its target by
less than one document. Blocks of about ``FAN_IN`` documents are folded first, then their
residuals block by block, up a tree, so a source of any size is spread over many tasks and
each level has 1 / FAN_IN of the rows of the one below.

Randomness is a hash of ids and level, so reruns agree whatever the partitioning.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own,
last in order; repeated rows are rounded one by one; with no words at all every target is
0; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import cut, release

FAN_IN = 64
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, n, target: ``share`` of all words dealt by weight, at most ``most`` times a source.

    The repeated resharing of what is above a limit ends at target = least(limit, level *
    weight) with one level for all; the level is found by one pass over the sources sorted
    by limit / weight. This table has one row per source.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", most * F.col("source_size")).withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    every = Window.partitionBy()
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", level).withColumn("place", F.row_number().over(order))
    per = per.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(every))
    return per.select("source", "source_size", "n", F.least("limit", F.col("level") * F.col("weight")).alias("target"))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _uniform(seed: int, *keys: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)).cast("double") / float(1 << 52)


def _settled(x: Column, copies: float) -> Column:
    return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), F.lit(copies).cast("int").alias("extra"))


def _moved(x: Column, mass: Column) -> Column:
    """``x`` with another mass."""
    part = F.least(F.lit(1.0), F.greatest(F.lit(0.0), mass / x["size"]))
    return F.struct(x["key"].alias("key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["whole"].alias("whole"), part.alias("part"))


def _pivot(acc: Column, b: Column, seed: int) -> Column:
    """One pivotal step of the residual of ``acc`` and the next unit ``b``."""

    def step(m: Column) -> Column:
        a = acc["rest"]
        room_a, room_b = a["size"] - m["a"], b["size"] - m["b"]
        up, down = F.least(room_a, m["b"]), F.least(m["a"], room_b)
        to_a = _uniform(seed, a["key"], b["key"]) * (up + down) < down

        def state(rest: Column, done: Column) -> Column:
            return F.struct(rest.alias("rest"), F.array_append(acc["done"], done).alias("done"))

        return F.when(
            to_a,
            F.when(room_a <= m["b"], state(_moved(b, m["b"] - room_a), _settled(a, 1))).otherwise(state(_moved(a, m["a"] + m["b"]), _settled(b, 0))),
        ).otherwise(F.when(m["a"] <= room_b, state(_moved(b, m["a"] + m["b"]), _settled(a, 0))).otherwise(state(_moved(a, m["a"] - room_b), _settled(b, 1))))

    mass = F.struct((acc["rest"]["part"] * acc["rest"]["size"]).alias("a"), (b["part"] * b["size"]).alias("b"))
    return _let(mass, step)


def _fold(rows: DataFrame, seed: int) -> DataFrame:
    """Rows (source, block, unit) -> one row per (source, block): rest and the settled units."""
    done = "array<struct<doc_id:bigint,size:bigint,whole:int,extra:int>>"
    units = rows.groupBy("source", "block").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    start = F.struct(F.element_at("units", 1).alias("rest"), F.array().cast(done).alias("done"))
    return units.select("source", "block", F.aggregate(F.slice("units", F.lit(2), F.size("units")), start, lambda acc, b: _pivot(acc, b, seed)).alias("out"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken for every document."""
    sizes = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size")))
    targets = cut(source_targets(sizes, weights, share, most))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = sizes.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    dealt = dealt.withColumn("rate", rate).withColumn("whole", F.floor(F.col("rate") + 1e-12).cast("int")).withColumn("part", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole")))
    fractional = (F.col("part") > 0) & (F.col("size") > 0)
    settled = [dealt.filter(~fractional).select("source", "doc_id", "size", "whole", F.lit(0).alias("extra"))]

    key = F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("size"))
    blocks = F.ceil(F.col("n") / FAN_IN)
    level = dealt.filter(fractional).select("source", F.pmod(key, blocks).alias("block"), F.struct(key.alias("key"), "doc_id", "size", "whole", "part").alias("unit"))
    widest = targets.agg(F.max(F.ceil(F.col("n") / FAN_IN))).first()[0] or 0
    depth = 0
    while True:
        folded = cut(_fold(level, seed + 1 + depth))
        settled.append(folded.select("source", F.explode("out.done").alias("d")).select("source", "d.*"))
        depth += 1
        if widest <= 1:
            break
        widest = -(-widest // FAN_IN)
        level = folded.select("source", F.floor(F.col("block") / FAN_IN).alias("block"), F.col("out.rest").alias("unit"))
    last = _uniform(seed, F.col("out.rest.key")) < F.col("out.rest.part")
    settled.append(folded.select("source", "out.rest.doc_id", "out.rest.size", "out.rest.whole", last.cast("int").alias("extra")))

    out = settled[0]
    for x in settled[1:]:
        out = out.unionByName(x)
    release(docs.sparkSession)
    out = out.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")))
    copies = F.col("whole") + F.col("extra")
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))
