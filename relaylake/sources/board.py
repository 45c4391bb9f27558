"""Board payloads as a stream (A2, X1): a Python data source with offsets.

Payload files land under ``<path>/changed=<date>/``, one payload a line; a
date's folder is complete when it appears, and later changes land under later
dates. The offset is the last date read, so a restarted query goes on behind
it, and the files of a batch are dealt over tasks. The source only reads
lines; Spark's own JSON reader parses them (``files.board_items``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from relaylake.sources import files

FOLDER = "changed="
FILES_PER_TASK = 16
LINES_PER_BATCH = 256


class Files(InputPartition):
    def __init__(self, names: list[tuple[str, str]]):
        super().__init__(names)


class BoardFeedReader(DataSourceStreamReader):
    def __init__(self, path: str, files_per_task: int):
        self.path, self.files_per_task = path, files_per_task

    def listed(self, recursive: bool = False, below: str = "") -> list[fs.FileInfo]:
        system, root = fs.FileSystem.from_uri(self.path)
        return system.get_file_info(fs.FileSelector(f"{root}/{below}", allow_not_found=True, recursive=recursive))

    def dates(self) -> list[str]:
        return sorted(x.base_name[len(FOLDER):] for x in self.listed() if x.base_name.startswith(FOLDER))

    def initialOffset(self) -> dict:
        return {"changed": ""}

    def latestOffset(self) -> dict:
        return {"changed": max(self.dates(), default="")}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        dates = [d for d in self.dates() if start["changed"] < d <= end["changed"]]
        names = [(d, x.path) for d in dates for x in sorted(self.listed(True, FOLDER + d), key=lambda x: x.path)
                 if x.is_file and not x.base_name.startswith(("_", "."))]
        return [Files(names[i:i + self.files_per_task]) for i in range(0, len(names), self.files_per_task)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        for date, name in partition.value:
            with system.open_input_stream(name) as raw:
                lines: list[bytes] = []
                rest = b""
                while block := raw.read(1 << 20):
                    *whole, rest = (rest + block).split(b"\n")
                    lines += [x for x in whole if x.strip()]
                    while len(lines) >= LINES_PER_BATCH:
                        yield batch_of(date, lines[:LINES_PER_BATCH])
                        lines = lines[LINES_PER_BATCH:]
                yield batch_of(date, lines + ([rest] if rest.strip() else []))


def batch_of(date: str, lines: list[bytes]) -> pa.RecordBatch:
    texts = pa.array([x.decode("utf-8", "replace") for x in lines], pa.string())
    return pa.RecordBatch.from_arrays([pa.array([date] * len(lines), pa.string()), texts], names=["changed", "payload"])


class BoardFeed(DataSource):
    """Options: ``path``; ``files_per_task``."""

    @classmethod
    def name(cls) -> str:
        return "board_feed"

    def schema(self) -> str:
        return "changed string, payload string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BoardFeedReader(self.options["path"], int(self.options.get("files_per_task", FILES_PER_TASK)))


def board_feed(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of tickets under ``path`` with the date they ``changed``. A
    line that isn't a payload gives no ticket."""
    spark.dataSource.register(BoardFeed)
    raw = spark.readStream.format("board_feed").option("path", path).options(**options).load()
    parsed = raw.select("changed", F.from_json("payload", files.BOARD_SCHEMA).alias("p")).select("changed", "p.value")
    return files.board_items(parsed, "changed")
