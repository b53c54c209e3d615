"""Session helpers shared by the operators: worker import path, checkpoints, table names."""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession, batch_rows: int = 1000) -> None:
    """Let Python workers import this package and bound the rows of an Arrow batch.

    The import path covers a package that is installed at one path on every host; on
    other clusters the package is shipped with ``--py-files``.
    """
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in parts:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *parts])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch_rows))
    # Shuffle files go when the action that wrote them ends; a stage that needs them again is repeated.
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    A folder of our own is set only where that setting is missing and none was set by hand,
    as in local tests.
    """
    context = spark.sparkContext
    folder = context.getConf().get("spark.checkpoint.dir", "") or getattr(context, "_tickframe_folder", "")
    held = context._jsc.sc().getCheckpointDir()
    if not folder and held.isDefined():
        folder = held.get()
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = context._tickframe_folder = tempfile.mkdtemp(prefix="tickframe-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    # Unless the cluster says otherwise, checkpoints go when nothing refers to them any more.
    context._jsc.sc().conf().setIfMissing("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the cluster's checkpoint folder and go on from those files.

    The files go when Spark's cleaner finds the returned frame unreachable.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def together(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` with equal ``keys`` in one partition, sorted by them.

    The partitions follow a hash of the keys, not the keys: after a join on the keys the
    optimiser would take the join's partitions for these, and then give those up when it
    turns the join into a broadcast one or splits it at run time.
    """
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys)


def copies(keys: DataFrame, rows: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """``rows`` without those that repeat all ``columns``, and the others (None if there is none).

    ``keys`` has the same ``columns``, for a cheap search for repeats. Repeats are numbered
    and the least number is found by an aggregate, so a row with very many copies is no group
    in one task.
    """
    twice = cut(keys.groupBy(*columns).count().filter("count > 1").select(*[F.col(c).alias(f"_{c}") for c in columns]))
    if twice.isEmpty():
        return rows, None
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in columns]
    numbered = cut(rows.join(twice, same, "left_semi").withColumn("_number", F.monotonically_increasing_id()))
    least = cut(numbered.groupBy(*columns).agg(F.min("_number").alias("_number")).select("_number"))
    first = numbered.join(least, "_number", "left_semi").drop("_number")
    return rows.join(twice, same, "left_anti").unionByName(first), numbered.join(least, "_number", "left_anti").drop("_number")


def release(spark: SparkSession) -> None:
    """Let Spark delete shuffle and checkpoint files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column):
    """Lower-case A-Z only; other letters stay."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(column, modulus: int):
    """crc32 of the id as text, modulo ``modulus``: the split between learning and held-out rows."""
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus))
