"""Running a stream to completion and exactly-once batch sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from relaylake.sinks.versioned import UpsertTable

# transformWithState needs it, and its state isn't held in the executors' heap
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def idempotent_sink(path: str, transform: Callable[[DataFrame, int], DataFrame] | None = None):
    """``foreachBatch`` writer: each micro-batch overwrites its own
    ``batch=<id>`` folder, so a batch replayed after a failure replaces its
    earlier output instead of duplicating it. A ``transform`` may look at the
    batch more than once: it is kept until it is written, so that the stream's
    own operators run once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        if transform is None:
            batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
            return
        batch.persist()
        try:
            transform(batch, batch_id).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        finally:
            batch.unpersist()
    return write


def upsert_sink(table: UpsertTable):
    """``foreachBatch`` writer: each micro-batch is merged into the table, once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch, batch_id)
    return write


def run_available_now(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str,
                      output_mode: str = "append") -> None:
    """Process everything available now, then stop (same code path as a
    continuous trigger; only the trigger differs)."""
    stream.sparkSession.conf.set(*STATE_STORE)
    q = (stream.writeStream.outputMode(output_mode).foreachBatch(sink)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
