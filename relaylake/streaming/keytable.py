"""Keys that are done, in files that a batch rarely has to open.

Keys are sorted by their hash over all files of a write. For each file the
table keeps the least and greatest hash and a Bloom filter in blocks, one for
about ``BLOCK_KEYS`` keys. To find which keys of a micro-batch are in the table,
the batch meets these first: a key can only be in a file whose range holds its
hash and whose filter block has its bits. Only such files are opened. New keys
come as small deltas, each with ranges and filters of its own; ``compact``
merges them into one sorted snapshot.

All steps are joins on keys (range bucket, file and block); nothing is
broadcast, and what comes to the driver is the names of the files to open,
at most one for each key of the batch and write.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.sinks.versioned import VersionedTable

BLOCK_BITS = 1 << 15  # of a filter block, as Spark's bitmaps have
BLOCK_KEYS = 3000
PROBES = 4  # about one key in a hundred that isn't there passes
RANGE_SHIFT = 52  # hash ranges are found by their upper 12 bits


def _probe(k: int) -> Column:
    return F.shiftrightunsigned("_g", 15 * k).bitwiseAND(F.lit(BLOCK_BITS - 1))


def _hashed(keys: DataFrame, key: str) -> DataFrame:
    return keys.withColumns({"_h": F.xxhash64(key), "_g": F.xxhash64(key, F.lit("filter"))})


def _block(n: Column) -> Column:
    return F.pmod(F.hash("_g"), F.ceil(n / F.lit(BLOCK_KEYS)).cast("int"))


class KeyTable:
    def __init__(self, spark: SparkSession, path: str, keys_per_file: int = 1 << 20, max_deltas: int = 16):
        self.spark = spark
        self.keys_per_file, self.max_deltas = keys_per_file, max_deltas
        self.table = VersionedTable(spark, path, "key string, _h long")

    def _staged(self, keys: DataFrame, kind: str) -> dict:
        """Data, file ranges and filters of one write."""
        path = self.table.path
        rows = keys.select(F.col("key").cast("string").alias("key")).where("key IS NOT NULL").distinct().withColumn("_h", F.xxhash64("key"))
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        (rows.repartitionByRange("_h").sortWithinPartitions("_h").write.option("maxRecordsPerFile", self.keys_per_file)
         .parquet(f"{path}/{folder}/keys"))
        entry = {"kind": kind, "folder": f"{folder}/keys", "files": f"{folder}/files", "filters": f"{folder}/filters"}
        written = _hashed(self.spark.read.schema("key string, _h long").parquet(f"{path}/{folder}/keys")
                          .select("key", F.col("_metadata.file_path").alias("file")), "key")
        written.groupBy("file").agg(F.min("_h").alias("lo"), F.max("_h").alias("hi"), F.count(F.lit(1)).alias("n")) \
            .write.parquet(f"{path}/{entry['files']}")
        files = self.spark.read.parquet(f"{path}/{entry['files']}")
        bits = (written.join(files.select("file", "n"), "file").select("file", _block(F.col("n")).alias("block"), F.explode(F.array(*[_probe(k) for k in range(PROBES)])).alias("bit")))
        bits.groupBy("file", "block").agg(F.bitmap_construct_agg("bit").alias("bits")).write.parquet(f"{path}/{entry['filters']}")
        return entry

    def add(self, keys: DataFrame, batch: int | None = None) -> None:
        """Add the column ``key``'s values; a micro-batch that is in already is left out."""
        base = self.table.manifest()
        if batch is not None and base["batch"] is not None and batch <= base["batch"]:
            return
        self.table.commit(base, base["entries"] + [self._staged(keys, "delta")], batch)
        if sum(e["kind"] == "delta" for e in base["entries"]) + 1 > self.max_deltas:
            self.compact()

    def compact(self) -> None:
        base = self.table.manifest()
        self.table.commit(base, [self._staged(self.table.read(base["version"]).select("key"), "snapshot")])

    def _parts(self, manifest: dict, what: str) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.table.path}/{e[what]}" for e in manifest["entries"]])

    def files_for(self, keys: DataFrame, manifest: dict | None = None) -> list[str]:
        """The files that may hold one of the keys."""
        manifest = manifest or self.table.manifest()
        if not manifest["entries"]:
            return []
        files = self._parts(manifest, "files").withColumn("range", F.explode(F.sequence(
            F.shiftright("lo", RANGE_SHIFT), F.shiftright("hi", RANGE_SHIFT))))
        asked = _hashed(keys.select("key").distinct(), "key").withColumn("range", F.shiftright("_h", RANGE_SHIFT))
        near = asked.join(files, "range").where("_h BETWEEN lo AND hi").withColumn("block", _block(F.col("n")))
        near = near.join(self._parts(manifest, "filters"), ["file", "block"])
        for k in range(PROBES):
            byte = F.conv(F.hex(F.substring("bits", (F.shiftright(_probe(k), 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            bit = F.call_function("shiftleft", F.lit(1), _probe(k).bitwiseAND(F.lit(7)).cast("int"))
            near = near.where(byte.bitwiseAND(bit) != 0)
        return [r.file for r in near.select("file").distinct().collect()]

    def without_known(self, rows: DataFrame, column: str) -> DataFrame:
        """The rows whose key isn't in the table; a null key never is."""
        manifest = self.table.manifest()
        files = self.files_for(rows.select(F.col(column).cast("string").alias("key")).where("key IS NOT NULL"), manifest)
        if not files:
            return rows
        known = self.spark.read.schema("key string").parquet(*files).select(F.col("key").alias(column)).distinct()
        return rows.join(known, column, "left_anti").select(*rows.columns)
