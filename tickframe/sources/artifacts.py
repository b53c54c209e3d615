"""A catalogue of results by content address: pull what is stored, compute what is not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickframe.functions.scalar import artifact_address

_LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register_loader(kind: str, loader: Callable[[SparkSession, str], DataFrame]) -> None:
    _LOADERS[kind] = loader


class Store:
    """Results under ``root/<address>``; any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(place)

    def has(self, address: str) -> bool:
        return self._exists(f"{self.root}/{address}/data/_SUCCESS")

    def parts(self, address: str) -> list[str]:
        """The addresses of the finished results below ``address``, in order."""
        jvm = self.spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{address}")
        files = place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in files.listStatus(place)] if files.exists(place) else []
        return [f"{address}/{n}" for n in sorted(found) if self.has(f"{address}/{n}")]

    def read(self, address: str, kind: str = "parquet") -> DataFrame:
        path = f"{self.root}/{address}/data"
        return _LOADERS[kind](self.spark, path) if kind in _LOADERS else self.spark.read.parquet(path)

    def write(self, address: str, df: DataFrame, fingerprint: bool = False) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{address}/data")
        out = self.read(address)
        if fingerprint:
            self.spark.createDataFrame([(content_fingerprint(out),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/{address}/fingerprint")
        return out

    def fingerprint(self, address: str) -> str | None:
        path = f"{self.root}/{address}/fingerprint"
        return self.spark.read.text(path).first().value if self._exists(path) else None

    def pull_or_compute(self, name: str, config: dict, inputs: list[str], compute: Callable[[], DataFrame], commit: str = "") -> tuple[DataFrame, str, bool]:
        """(result, address, pulled)."""
        address = artifact_address(name, config, inputs, commit)
        if self.has(address):
            return self.read(address), address, True
        return self.write(address, compute()), address, False

    def is_reproducible(self, address: str, again: DataFrame) -> bool:
        """Does a recomputation have the stored fingerprint?"""
        return self.fingerprint(address) == content_fingerprint(again)


def content_fingerprint(df: DataFrame) -> str:
    """16 hex digits of the rows as a multiset: per-row hashes are summed, so order and partitioning don't matter."""
    row = F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)]), {"ignoreNullFields": "false"})
    halves = [F.sum(F.conv(F.substring(F.sha2(row, 256), 1 + 8 * k, 8), 16, 10).cast("decimal(30,0)")) for k in range(4)]
    return df.agg(F.substring(F.sha2(F.concat_ws(":", F.count("*").cast("string"), *[F.coalesce(h, F.lit(0)).cast("string") for h in halves]), 256), 1, 16)).first()[0]


def split_by_catalogue(wanted: DataFrame, catalogue: DataFrame, address: str = "address") -> tuple[DataFrame, DataFrame]:
    """(stored, missing) rows of ``wanted``."""
    held = catalogue.select(address)
    return wanted.join(held, address, "left_semi"), wanted.join(held, address, "left_anti")
