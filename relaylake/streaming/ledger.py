"""Pipeline status polling as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from relaylake import constants as K

RUN = ["work_item_id", "ord", "attempt"]


BLOCK = 16  # stages, and attempts, of a ticket that share a state value
TICKETS = 256  # neighbouring tickets that share one where many of them come in a batch
NONE = -(1 << 40)  # for a null stage or attempt: pandas would make floats of the column
NEVER = 1 << 62  # for a null time: behind all others
ROW = ["ticket", "ord", "attempt", "us", "status"]


class FirstStatus(StatefulProcessor):
    """Per run the least ``(us, status)``: emitted in the micro-batch that
    brings it, and again only if an earlier one turns up. The state of a run
    goes ``retention_seconds`` after that time.

    A state call costs far more than a row, so the runs of a ticket, or of
    neighbouring tickets, share a value and a timer, at most ``BLOCK`` x
    ``BLOCK`` of a ticket. Rows come as pandas frames, which take a fraction of
    the time of rows; nulls of their numbers are ``NONE`` and ``NEVER``."""

    def __init__(self, retention_seconds: int):
        self.retention = retention_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getValueState("first", "runs array<struct<work_item_id:bigint,ord:bigint,attempt:bigint,us:bigint,status:string>>")

    def _known(self) -> dict:
        found = self.first.get()
        return {} if found is None else {(x[0], x[1], x[2]): (x[3], x[4]) for x in found[0]}

    def _keep(self, known: dict) -> None:
        self.first.update(([(*run, *least) for run, least in known.items()],))
        self.handle.registerTimer((min(us for us, _ in known.values()) + self.retention) // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known, changed = self._known(), {}
        for frame in rows:
            for *run, us, status in zip(*[frame[c].tolist() for c in ROW]):
                run, now = tuple(run), (us, status)
                before = changed.get(run) or known.get(run)
                if before is None or now < before:
                    changed[run] = now
        if changed:
            self._keep(known | changed)
            yield pd.DataFrame([(key[1], *run, *now) for run, now in changed.items()], columns=["no_ticket", *ROW])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        left = {run: x for run, x in self._known().items() if x[0] + self.retention >= watermark}
        if left:
            self._keep(left)
        else:
            self.first.clear()
        return iter(())

    def close(self) -> None:
        pass


def first_terminal_status(status_events: DataFrame, lateness: str = "1 hour", retention_seconds: int = 30 * 86400,
                          tickets: int = 1) -> DataFrame:
    """Per run, the first status that is not ``inProgress`` /
    ``notStarted`` (status = result, else state), with its time. The result's
    latest row per run is the one with the least time; there is more than one
    only where an earlier status came in after a later one.

    So many neighbouring ``tickets`` share a state value. A batch reads and
    writes the values of its tickets: more are worth it where a batch has many
    of them. A checkpoint keeps the number it was begun with."""
    ts = F.col("ts").cast("timestamp")
    # the watermark's column also goes to pandas, which has nanoseconds
    ts_ns = F.when(F.col("us").isNotNull(), F.timestamp_micros(F.least(F.greatest("us", F.lit(-9_000_000_000_000_000)), F.lit(9_000_000_000_000_000))))
    ev = status_events.withColumn("us", F.unix_micros(ts)).withColumn("ts", ts_ns).withWatermark("ts", lateness)
    status = F.coalesce(F.col("result"), F.col("state"))
    terminal = ev.where(~F.lower(status).isin(*K.NON_TERMINAL_STATUSES))
    run = {c: F.coalesce(F.col(c).cast("long"), F.lit(NONE)) for c in RUN[1:]}
    first = F.col(RUN[0]) - F.pmod(F.col(RUN[0]), F.lit(tickets))  # of its neighbours
    blocks = terminal.select(
        F.coalesce(first, F.lit(0)).cast("long").alias(RUN[0]), F.col(RUN[0]).isNull().alias("no_ticket"), F.coalesce(F.col(RUN[0]), F.lit(0)).alias("ticket"),
        *[F.floor(v / BLOCK).alias(f"{c}_block") for c, v in run.items()], *[v.alias(c) for c, v in run.items()],
        "ts", F.coalesce("us", F.lit(NEVER)).alias("us"), status.alias("status"))
    out = blocks.groupBy(RUN[0], "no_ticket", *[f"{c}_block" for c in RUN[1:]]).transformWithStateInPandas(
        FirstStatus(retention_seconds), "no_ticket boolean, ticket long, ord long, attempt long, us long, status string", "Append", "EventTime")
    null = lambda c, none: F.when(F.col(c) != none, F.col(c))
    return out.select(F.when(~F.col("no_ticket"), F.col("ticket")).alias(RUN[0]), *[null(c, NONE).cast("int").alias(c) for c in RUN[1:]],
                      F.timestamp_micros(null("us", NEVER)).alias("ts"), "status")
