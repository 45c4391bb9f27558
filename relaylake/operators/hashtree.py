"""Two versions of a table compared by trees of hash ranges (Q7).

Rows are dealt by a hash of their key into ``2**bits`` ranges, the leaves.
Each leaf, and each range of 256 lower ranges above it, has a fingerprint: the
number of its rows and the sums of two independent row hashes. To compare two
versions only the branches whose fingerprints differ are followed down, and
only the leaves that differ are read again, row by row. A version's tree is
written once, with its rows beside it in folders by the upper hash bits, so
comparing it with many later versions reads little more than what changed.
Rows are written by the tasks that read them: they aren't shuffled, so a hot
key is cut as the input is. Their hashes aren't kept, only the tree's sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

FOLDER_BITS = 6
FAN_BITS = 8
MARK = ["n", "x", "y"]


def _range(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, 64 - bits).cast("long") if bits else F.lit(0).cast("long")


def _rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A version's rows (with its schema, as an empty one has no file to tell it)."""
    kind = StructType([StructField("row", schema), StructField("leaf", LongType()), StructField("folder", IntegerType())])
    return spark.read.schema(kind).parquet(f"{path}/rows")


def write_tree(df: DataFrame, path: str, keys: list[str], bits: int = 16) -> None:
    """Write the rows and the tree of one version."""
    if bits % FAN_BITS or bits < FOLDER_BITS:
        raise ValueError(f"bits must be a multiple of {FAN_BITS} and at least {FOLDER_BITS}")
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys])
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), _range(key, bits).alias("leaf"))
    rows.withColumn("folder", F.shiftright("leaf", bits - FOLDER_BITS).cast("int")).write.partitionBy("folder").parquet(f"{path}/rows")
    spark = df.sparkSession
    columns = [F.col("row")[c] for c in df.columns]
    marked = _rows(spark, path, df.schema).select("leaf", F.xxhash64(*columns).alias("x"), F.xxhash64(F.lit("second"), *reversed(columns)).alias("y"))
    level = (marked.groupBy(F.col("leaf").alias("node"))
             .agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("x", "y")]))
    for depth in range(bits, -1, -FAN_BITS):
        level.write.parquet(f"{path}/tree/{depth}")
        level = (spark.read.parquet(f"{path}/tree/{depth}").groupBy(F.shiftright("node", FAN_BITS).alias("node"))
                 .agg(*[F.sum(c).cast("decimal(38,0)" if c != "n" else "long").alias(c) for c in MARK]))


def changed_leaves(spark: SparkSession, before: str, after: str, bits: int = 16) -> DataFrame:
    """``node``: the leaves that differ, found from the root down."""
    changed = None
    for depth in range(0, bits + 1, FAN_BITS):
        a, b = (spark.read.parquet(f"{p}/tree/{depth}") for p in (before, after))
        if changed is not None:
            a, b = (t.join(changed.select(F.col("node").alias("up")), F.shiftright("node", FAN_BITS) == F.col("up"), "left_semi") for t in (a, b))
        sides = a.select("node", F.struct(*MARK).alias("a")).join(b.select("node", F.struct(*MARK).alias("b")), "node", "full_outer")
        changed = sides.where(~F.col("a").eqNullSafe(F.col("b"))).select("node")
        if changed.isEmpty():
            break
    return changed


def changed_rows(spark: SparkSession, before: str, after: str, schema: StructType, bits: int = 16) -> DataFrame:
    """Rows that one version has more often than the other: the columns of
    ``schema``, which both versions have, ``change`` (added or removed) and ``copies``."""
    leaves = changed_leaves(spark, before, after, bits)
    folders = [r.f for r in leaves.select(F.shiftright("node", bits - FOLDER_BITS).cast("int").alias("f")).distinct().collect()]  # 64 numbers at most

    def opened(path: str, sign: int) -> DataFrame:
        rows = _rows(spark, path, schema).where(F.col("folder").isin(folders))
        return rows.join(leaves, rows["leaf"] == leaves["node"], "left_semi").select("row", F.lit(sign).alias("sign"))

    both = opened(before, -1).unionByName(opened(after, 1))
    left = both.groupBy("row").agg(F.sum("sign").alias("sign")).where(F.col("sign") != 0)
    return left.select("row.*", F.when(F.col("sign") > 0, F.lit("added")).otherwise(F.lit("removed")).alias("change"), F.abs("sign").alias("copies"))
