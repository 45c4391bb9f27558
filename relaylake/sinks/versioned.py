"""Tables with versions: staged files and a manifest that switches atomically.

A write first stages a folder of Parquet files under ``data/``. It becomes
visible only with the manifest of the next version, a small JSON file that is
written beside the others and then renamed to its number: readers see the old
version or the new one, and a write that fails or is repeated leaves the old
one. A manifest names the snapshot and the deltas that make up the table, and
the latest micro-batch it holds, so a batch that is replayed after a failure
is recognised. Two writers that start from one version can't both commit.

``UpsertTable`` keeps one row a key. An upsert stages only its own rows, as a
delta; after ``max_deltas`` of them they are merged into a new snapshot. A read
costs the snapshot and at most ``max_deltas`` deltas, however many batches
there were.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class ConcurrentWrite(RuntimeError):
    """Another writer has committed the version this one was to become."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType | str):
        self.spark, self.path = spark, path.rstrip("/")
        self.schema = schema if isinstance(schema, StructType) else spark.createDataFrame([], schema).schema

    # ---- manifests ----
    def _hadoop(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, log = self._hadoop("log")
        if not fs.exists(log):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(log)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def version(self) -> int:
        """The current version, -1 where nothing was committed yet."""
        return max(self.versions(), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "batch": None, "entries": []}
        fs, path = self._hadoop(f"log/{version:012d}.json")
        stream = fs.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return json.loads(text)

    def commit(self, base: dict, entries: list[dict], batch: int | None = None) -> int:
        """Make ``entries`` the version after ``base``."""
        number = base["version"] + 1
        fs, staged = self._hadoop(f"log/.{uuid.uuid4().hex}.tmp")
        out = fs.create(staged, False)
        out.write(bytearray(json.dumps({"version": number, "batch": base["batch"] if batch is None else batch, "entries": entries}).encode()))
        out.close()
        _, final = self._hadoop(f"log/{number:012d}.json")
        if fs.exists(final) or not fs.rename(staged, final):
            fs.delete(staged, False)
            raise ConcurrentWrite(f"version {number} of {self.path} exists")
        return number

    # ---- data ----
    def stage(self, df: DataFrame, kind: str) -> dict:
        """Write the rows to a folder of their own; returns its manifest entry."""
        folder = f"data/{kind}-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{folder}")
        return {"kind": kind, "folder": folder}

    def folders(self, manifest: dict) -> list[str]:
        return [f"{self.path}/{e['folder']}" for e in manifest["entries"]]

    def read(self, version: int | None = None) -> DataFrame:
        folders = self.folders(self.manifest(version))
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def overwrite(self, df: DataFrame, batch: int | None = None) -> int:
        base = self.manifest()
        if batch is not None and base["batch"] is not None and batch <= base["batch"]:
            return base["version"]  # a replay
        return self.commit(base, [self.stage(df.select(*self.schema.names), "snapshot")], batch)

    def append(self, df: DataFrame, batch: int | None = None) -> int:
        """Add rows; a micro-batch that is already in is left out."""
        base = self.manifest()
        if batch is not None and base["batch"] is not None and batch <= base["batch"]:
            return base["version"]
        return self.commit(base, base["entries"] + [self.stage(df.select(*self.schema.names), "delta")], batch)

    def vacuum(self, keep: int = 2) -> None:
        """Delete manifests but the latest ``keep`` and the folders that none of
        these names. Not while another writer is staging."""
        versions = self.versions()
        named = {e["folder"].split("/")[1] for v in versions[-keep:] for e in self.manifest(v)["entries"]}
        fs, data = self._hadoop("data")
        for v in versions[:-keep]:
            fs.delete(self._hadoop(f"log/{v:012d}.json")[1], False)
        for x in fs.listStatus(data) if fs.exists(data) else []:
            if x.getPath().getName() not in named:
                fs.delete(x.getPath(), True)


class UpsertTable(VersionedTable):
    """One row per ``keys``: of several the one with the greatest ``order``.

    Equal orders are decided by the other columns' values, so replays and
    recomputed partitions give the same rows. A null order comes before all."""

    def __init__(self, spark: SparkSession, path: str, schema: StructType | str, keys: list[str], order: list[str], max_deltas: int = 8):
        super().__init__(spark, path, schema)
        self.keys, self.order, self.max_deltas = keys, order, max_deltas

    def _latest(self, rows: DataFrame) -> DataFrame:
        names = self.schema.names
        last: Column = F.struct(*self.order, *[c for c in names if c not in (*self.keys, *self.order)])
        return rows.groupBy(*self.keys).agg(F.max(last).alias("_last")).select(
            *[F.col(c) if c in self.keys else F.col(f"_last.{c}").alias(c) for c in names])

    def upsert(self, rows: DataFrame, batch: int | None = None) -> int:
        base = self.manifest()
        if batch is not None and base["batch"] is not None and batch <= base["batch"]:
            return base["version"]
        delta = self.stage(self._latest(rows.select(*self.schema.names)), "delta")
        version = self.commit(base, base["entries"] + [delta], batch)
        return self.compact() if sum(e["kind"] == "delta" for e in base["entries"]) + 1 > self.max_deltas else version

    def latest(self, version: int | None = None) -> DataFrame:
        return self._latest(self.read(version))

    def compact(self) -> int:
        """Merge all deltas into a new snapshot."""
        base = self.manifest()
        return self.commit(base, [self.stage(self.latest(base["version"]), "snapshot")])
