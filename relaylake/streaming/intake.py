"""Continuous intake (X1) with run-key de-duplication.

Tickets arrive as files. Exact repeats are dropped with
``dropDuplicatesWithinWatermark`` on the run key (state bounded by the
watermark on the ingestion time); tickets whose key already succeeded in
the run ledger are skipped inside ``foreachBatch`` by an anti-join with a table
of succeeded keys, of which a batch opens only the files that may hold its own.
The remaining tickets are planned and appended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from relaylake.operators import intake, planning
from relaylake.streaming.keytable import KeyTable


def intake_stream(tickets: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Normalise, board-filter and key the ticket stream; drop exact repeats.
    ``tickets`` carries an ``ingested_at`` timestamp used for the watermark."""
    t = intake.board_filter(intake.normalize_tickets(tickets))
    keyed = intake.with_run_key(t)
    return keyed.withWatermark("ingested_at", lateness).dropDuplicatesWithinWatermark(["run_key"])


def succeeded_keys(ledger: DataFrame, table: KeyTable, batch: int | None = None) -> None:
    """Add the run keys whose latest status is ``succeeded``."""
    done = intake.latest_run_status(ledger).where(F.col("status") == "succeeded")
    table.add(done.select(F.col("run_key").alias("key")), batch)


def plan_batch(done: Callable[[], KeyTable]):
    """``foreachBatch`` transform: skip keys that already succeeded, then plan.
    Of the key table that ``done`` gives at that time, only the files that may
    hold one of the batch's keys are opened."""
    def transform(batch: DataFrame, batch_id: int) -> DataFrame:
        return planning.with_plan(done().without_known(batch, "run_key")).drop("ingested_at")
    return transform
