"""Bundles: a document with its large arrays beside it as Parquet."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REFERENCE = "$table"


def save_bundle(spark: SparkSession, document: dict, tables: dict[str, DataFrame], folder: str) -> dict:
    """``document`` as JSON, each table as Parquet under arrays/; strings {"$table": name} refer to them.

    Returns rows and bytes-free summary by table.
    """
    summary = {}
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/arrays/{name}")
        summary[name] = spark.read.parquet(f"{folder}/arrays/{name}").count()
    text = json.dumps(document, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/document")
    return summary


def load_bundle(spark: SparkSession, folder: str) -> dict:
    """The document with each reference replaced by a lazy DataFrame."""
    document = json.loads("\n".join(r.value for r in spark.read.text(f"{folder}/document").collect()))

    def resolve(node):
        if isinstance(node, dict):
            return spark.read.parquet(f"{folder}/arrays/{node[REFERENCE]}") if set(node) == {REFERENCE} else {k: resolve(v) for k, v in node.items()}
        return [resolve(v) for v in node] if isinstance(node, list) else node

    return resolve(document)


def matrix_rows(df: DataFrame, array: str, index: str) -> DataFrame:
    """A column of vectors as (index, j, value) rows: the dense form joins and aggregates."""
    return df.select(index, F.posexplode(array).alias("j", "value"))
