"""python -m tickframe QUERY --data DIR [--out PATH] [--explain]: run one registered query."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from tickframe import catalogue


def main() -> None:
    p = argparse.ArgumentParser(prog="tickframe", description=__doc__)
    p.add_argument("query", choices=sorted(catalogue.QUERIES))
    p.add_argument("--data", required=True, help="folder with the tables as Parquet")
    p.add_argument("--out", help="where to write the rows as Parquet; else they are shown")
    p.add_argument("--explain", action="store_true")
    a = p.parse_args()
    spark = SparkSession.builder.appName(f"tickframe {a.query}").getOrCreate()
    df = catalogue.QUERIES[a.query](spark, a.data)
    if a.explain:
        df.explain("formatted")
    if a.out:
        df.write.mode("overwrite").parquet(a.out)
    else:
        df.show(50, truncate=False)


if __name__ == "__main__":
    main()
