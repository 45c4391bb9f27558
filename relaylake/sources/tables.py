"""Parquet table access for the driver-provided tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


SCAN_PARTITIONS = "relaylake.scan.partitions"


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """Read one table; Catalyst prunes columns and pushes filters into the scan.

    ``spread=True`` marks views whose first operators are heavy per-row
    projections (regular expressions, hashes, array lambdas). Where the session
    sets ``relaylake.scan.partitions``, their scan is dealt round-robin over
    that many tasks: for tables stored as few large row groups, which no scan
    setting can split. Unset, as on a cluster whose tables have many files,
    the scan's own splits are used.
    """
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    partitions = spark.conf.get(SCAN_PARTITIONS, None) if spread else None
    return df.repartition(int(partitions)) if partitions else df
