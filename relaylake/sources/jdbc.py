"""JDBC source ingestion.

A partitioned read: the key range is split into ``num_partitions`` strides
so every executor reads one slice in parallel (``partitionColumn`` /
``lowerBound`` / ``upperBound``); the bounds are found with a pushed-down
``min/max`` query, not by scanning the table through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def key_bounds(spark: SparkSession, url: str, table: str, column: str, props: dict | None = None) -> tuple[int, int]:
    q = f"(SELECT MIN({column}) AS lo, MAX({column}) AS hi FROM {table}) b"
    row = spark.read.jdbc(url, q, properties=props or {}).first()
    return int(row["lo"] or 0), int(row["hi"] or 0)


def read_partitioned(spark: SparkSession, url: str, table: str, column: str, num_partitions: int,
                     props: dict | None = None, fetchsize: int = 10000,
                     bounds: tuple[int, int] | None = None) -> DataFrame:
    lo, hi = bounds if bounds is not None else key_bounds(spark, url, table, column, props)
    opts = dict(props or {})
    opts["fetchsize"] = str(fetchsize)
    return spark.read.jdbc(url, table, column=column, lowerBound=lo, upperBound=hi + 1,
                           numPartitions=num_partitions, properties=opts)
