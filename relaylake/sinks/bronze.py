"""Bronze-layer writes (B1-B4): namespace bootstrap, append / overwrite,
re-processing overwrite without duplicates, schema-evolving append.

Writes go through Spark's job commit protocol, so a lost executor's task is
retried and only committed files become visible.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def bootstrap(spark: SparkSession, schema: str, table: str, ddl: str, location: str,
              partitioned_by: list[str] | None = None) -> None:
    """Idempotent ``CREATE SCHEMA / CREATE TABLE IF NOT EXISTS`` (parquet).
    ``CREATE CATALOG`` has no open-source equivalent; catalogs are configured
    with ``spark.sql.catalog.<name>``."""
    spark.sql(f"CREATE SCHEMA IF NOT EXISTS {schema}")
    part = f" PARTITIONED BY ({', '.join(partitioned_by)})" if partitioned_by else ""
    spark.sql(f"CREATE TABLE IF NOT EXISTS {schema}.{table} ({ddl}) USING parquet{part} LOCATION '{location}'")


def write_bronze(df: DataFrame, path: str, mode: str, partition_by: list[str] | None = None) -> None:
    """B1: append or overwrite, as the plan's ingestion mode says."""
    if mode not in ("append", "overwrite"):
        raise ValueError(f"unsupported ingestion mode {mode!r}")
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def dedupe_deterministic(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key; among duplicates the one with the greatest remaining
    columns is kept. Unlike ``dropDuplicates`` (first arrival) the survivor
    does not depend on shuffle order, so a recomputed partition after an
    executor loss writes the same rows."""
    others = [c for c in df.columns if c not in keys]
    if not others:
        return df.distinct()
    kept = df.groupBy(*keys).agg(F.max(F.struct(*others)).alias("_r")).select(*keys, "_r.*")
    return kept.select(*df.columns)


def overwrite_partitions(df: DataFrame, path: str, keys: list[str], partition_by: list[str]) -> None:
    """B2: re-processing overwrite that leaves no duplicate rows: rows are
    de-duplicated on the business keys, and only the partitions present in
    ``df`` are replaced (dynamic partition overwrite)."""
    (dedupe_deterministic(df, keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(*partition_by).parquet(path))


def append_evolving(df: DataFrame, path: str) -> None:
    """Append a batch whose schema may have new columns; the table is
    read back with ``mergeSchema`` (older files show NULL for new columns)."""
    df.write.mode("append").parquet(path)


def read_evolving(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(path)


def union_evolving(a: DataFrame, b: DataFrame) -> DataFrame:
    """B3 in memory: union by name, columns missing on one side become NULL."""
    return a.unionByName(b, allowMissingColumns=True)

