"""Shared pieces of the training-data operators: tables, keys, Arrow slices.

Row identity. Operators key a document by ``(doc_id, xxhash64(text))``: a null
``doc_id`` sorts behind every other, and repeated rows (same id, same text)
get the same results because they are the same document.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NULL_ID = (1 << 63) - 1


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share, as named by ``spark.checkpoint.dir``; a
    scratch folder is set only where a local session names none (tests), and
    elsewhere its lack raises."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="relaylake-llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts
    the lineage, and a lost executor costs only the tasks that were running."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unbroadcast(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is sorted and merged. For joins of two
    tables that grow with the corpus, where Spark sizes a side too low: it takes
    a table for as large as its compressed file, and exploded rows for as many
    as there were before. What it then broadcasts goes through the driver."""
    return df.hint("merge")


def id_key(col: str = "doc_id") -> Column:
    """The id as a non-null long (null last)."""
    return F.coalesce(F.col(col).cast("long"), F.lit(NULL_ID))


def base_columns(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id``, ``text`` and the row key ``_id``, ``_h`` only, and the columns
    named: others of the input, whatever their names, take no part."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       id_key().alias("_id"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("_h"), *more)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also where ``body`` names
    it inside other lambdas."""
    return F.transform(F.array(value), body)[0]


def slices(batch: pa.RecordBatch, column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows with about ``max_bytes`` of
    ``column`` each (a longer row comes alone)."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, used = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and used + size > max_bytes:
            yield batch.slice(start, i - start)
            start, used = i, 0
        used += size
    if start < batch.num_rows:
        yield batch.slice(start)


def utf8(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array without copying, and its row offsets."""
    if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type):
        kind = np.int64
    else:
        kind = np.int32
    if array.null_count:
        array = array.fill_null("")
    buffers = array.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[array.offset: array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    if len(offsets) == 0:
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0]: offsets[-1]], offsets - offsets[0]


def bucket_sums(df: DataFrame, group: list[str], bucket: str, value: str) -> DataFrame:
    """Exclusive running totals of ``value`` per bucket within ``group``.

    ``bucket`` holds small non-negative integers. Totals are summed in two
    levels (spans of 4096 buckets, then buckets within a span), so that no
    task sees more than one span of buckets or one row per span.
    """
    from pyspark.sql import Window

    totals = (df.groupBy(*group, bucket).agg(F.sum(value).alias("_t"))
              .withColumn("_span", F.shiftright(F.col(bucket).cast("long"), 12)))
    spans = totals.groupBy(*group, "_span").agg(F.sum("_t").alias("_st"))
    outer = Window.partitionBy(*(group or [F.lit(0)])).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(*group, "_span", F.coalesce(F.sum("_st").over(outer), F.lit(0)).alias("_before_span"))
    inner = Window.partitionBy(*group, "_span").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_in_span", F.coalesce(F.sum("_t").over(inner), F.lit(0)))
    return (totals.join(spans, [*group, "_span"])
            .select(*group, bucket, (F.col("_before_span") + F.col("_in_span")).alias("_before")))
