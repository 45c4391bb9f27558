"""Column profiles of landed versions and what changed between them (Q9).

A landed value is text. Its kind is one bit; a column's profile is the union
of its values' bits, with counts, so profiles of parts are merged by OR and
sums. The inferred type is the least one that holds all kinds: bigint below
decimal, date below timestamp, string above all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# a value's kind: bit, name, pattern; the first that fits
KINDS = [(1, "bigint", r"^[+-]?[0-9]{1,18}$"), (2, "decimal", r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+|[0-9]{19,})$"), (4, "date", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"),
         (8, "timestamp", r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?$"), (16, "boolean", r"^([Tt]rue|[Ff]alse)$")]
TEXT = 32
TYPES = [(0, "void"), (1, "bigint"), (2, "decimal"), (3, "decimal"), (4, "date"), (8, "timestamp"), (12, "timestamp"), (16, "boolean")]


def kind_bit(value: Column) -> Column:
    """0 for null."""
    out = F.when(value.isNull(), F.lit(0))
    for bit, _, pattern in KINDS:
        out = out.when(value.rlike(pattern), F.lit(bit))
    return out.otherwise(F.lit(TEXT))


def inferred_type(bits: Column) -> Column:
    out = F.when(bits.isNull(), F.lit(None).cast("string"))
    for n, name in TYPES:
        out = out.when(bits == n, F.lit(name))
    return out.otherwise(F.lit("string"))


def column_profiles(landed: DataFrame) -> DataFrame:
    """``version, name, type, n_rows, n_nulls`` of rows ``version, values``
    (a map from column name to text; a column that a version lacks isn't a key)."""
    cells = landed.select("version", F.explode("values").alias("name", "value"))
    return cells.groupBy("version", "name").agg(
        F.bit_or(kind_bit(F.col("value"))).alias("bits"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_nulls")
    ).select("version", "name", inferred_type(F.col("bits")).alias("type"), "n_rows", "n_nulls")


def drift(profiles: DataFrame) -> DataFrame:
    """Q9: ``version, name, change, type_before, type_after`` for each version
    but the first against the one before it: added, removed or retyped. A
    column without any value has no type to change."""
    versions = profiles.select("version").distinct()
    before = Window.partitionBy(F.lit(0)).orderBy("version")  # a row a version
    pairs = versions.withColumn("previous", F.lag("version").over(before)).where(F.col("previous").isNotNull())
    now = profiles.join(pairs, "version").select("version", "name", F.col("type").alias("type_after"))
    old = (profiles.withColumnRenamed("version", "previous").join(pairs, "previous")
           .select("version", "name", F.col("type").alias("type_before")))
    both = old.join(now, ["version", "name"], "full_outer")
    change = (F.when(F.col("type_before").isNull(), F.lit("added")).when(F.col("type_after").isNull(), F.lit("removed"))
              .when((F.col("type_before") != F.col("type_after")) & (F.col("type_before") != "void") & (F.col("type_after") != "void"), F.lit("retyped")))
    return both.withColumn("change", change).where(F.col("change").isNotNull()).select("version", "name", "change", "type_before", "type_after")
