"""Approval and clarification waits with a deadline as a stateful stream
(X2, X3, X4, X7). Clarifications use the same processor with ``answered``
as the terminal event.

``transformWithState`` keeps, per request, one value (its creation, the earliest
in-time and the latest decision, the row last emitted) and a list of the
decisions seen. The result is a function of the rows seen so far and the
watermark, not of how they were cut into micro-batches: decisions that come
before their request wait for it, an earlier in-time decision revises the
outcome, and a request is ``timed_out`` (by ``system-timeout``) only when the
watermark has passed ``created_at + timeout`` without a decision, since before
that one could still arrive. Later decisions overwrite that status
(``late_decision='overwrite'``) or are dropped (``'ignore'``).

A state call costs far more than a row, so the requests of a block, by the hash
of their id, share a value, a list and a timer, the earliest of theirs. A batch
reads and writes the values of the blocks it has rows of; events of other kinds,
which only move the watermark, don't come to the processor. The list is only
appended to, so a batch costs its own decisions, however many there were before.
It is read again only if a request row comes after decisions, or an earlier one
moves the creation back; once the watermark has passed the creation, none can,
and the request's decisions may go: the list is cleared when all may, and
written anew when most may. A request is due at its deadline and then
``retention_seconds`` after it, when its state is released. (Spark's own
time-to-live of state counts processing time, on which results would depend.)

Every change is emitted as a new version of the request's row; the current
view is the latest version per request (W2).
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT_SCHEMA = ("request_id string, stage string, created_us long, outcome string, "
                 "outcome_actor string, final_status string, version int")
NAMES = ["created_us", "created_seq", "stage", "version", "in_us", "in_seq", "in_event", "in_actor", "last_us", "last_seq", "last_event",
         "out_us", "out_stage", "out_outcome", "out_actor", "out_final", "listed", "due"]
DUE, LISTED = NAMES.index("due"), NAMES.index("listed")  # in ms; how many decisions of the list are the request's
BLOCKS = 1 << 14  # of requests; a checkpoint keeps the number it was begun with
DECISIONS = ("approved", "rejected")
TIMED_OUT = ("timed_out", "system-timeout")


class DeadlineProcessor(StatefulProcessor):
    """See above; rows need ``request_id, us, seq, event, actor, stage``."""

    def __init__(self, timeout_seconds: int, late_decision: str = "overwrite", retention_seconds: int | None = None,
                 decisions: tuple[str, ...] = DECISIONS):
        if late_decision not in ("overwrite", "ignore"):
            raise ValueError("late_decision must be 'overwrite' or 'ignore'")
        self.timeout = timeout_seconds * 1_000_000
        self.retention = (timeout_seconds if retention_seconds is None else retention_seconds) * 1_000_000
        self.late_decision, self.decisions = late_decision, tuple(decisions)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.block = handle.getValueState("block", "timer long, listed long, requests binary")
        self.seen = handle.getListState("seen", "decisions binary")  # a part a batch: id, us, seq, event, actor

    def _open(self) -> None:
        found = self.block.get()
        self.timer, self.listed, requests = (None, 0, None) if found is None else found
        self.requests: dict[str | None, tuple] = {} if requests is None else pickle.loads(requests)
        self.told, self.before = [], None

    def _close(self) -> None:
        """Writes the block, and its timer if that has changed."""
        keep = sum(s[LISTED] for s in self.requests.values())
        self.listed += len(self.told)
        if not keep and self.listed:
            self.seen.clear()
            self.listed = 0
        elif self.listed > 2 * keep + 64:  # most are of requests that need them no more
            left = [x for x in self._decisions() if x[0] in self.requests and self.requests[x[0]][LISTED]]
            self.seen.put([(pickle.dumps(left),)])
            self.listed = len(left)
        elif self.told:
            self.seen.appendValue((pickle.dumps(self.told),))
        due = min((s[DUE] for s in self.requests.values()), default=None)
        if due != self.timer:
            if self.timer is not None:
                self.handle.deleteTimer(self.timer)
            if due is not None:
                self.handle.registerTimer(due)
        if self.requests:
            self.block.update((due, self.listed, pickle.dumps(self.requests)))
        else:
            self.block.clear()

    def _decisions(self) -> list[tuple]:
        """Those of the list, and of this batch."""
        if self.before is None:
            self.before = [d for x in self.seen.get() for d in pickle.loads(x[0])]
        return self.before + self.told

    def _get(self, request: str | None) -> dict:
        found = self.requests.get(request)
        return dict.fromkeys(NAMES) | {"version": 0, "listed": 0} if found is None else dict(zip(NAMES, found))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs() * 1000
        self._open()
        asked, told = {}, {}
        for r in rows:
            request = r.request_id
            if r.event == "requested":
                if request not in asked or (r.us, r.seq) < asked[request][:2]:
                    asked[request] = (r.us, r.seq, r.stage)
            elif r.event in self.decisions:
                told.setdefault(request, []).append((r.us, r.seq, r.event, r.actor))
        for request in asked | told:
            yield from self._rows(request, asked.get(request), told.get(request, []), watermark)
        self._close()

    def _rows(self, request: str | None, asked: tuple | None, told: list[tuple], watermark: int) -> Iterator[Row]:
        """What a batch has of a request: its first request row, its decisions."""
        s = self._get(request)
        created, listed = s["created_us"], s["listed"]
        if told and (created is None or watermark <= created):  # an earlier request can still arrive
            self.told += [(request, *x) for x in told]
            s["listed"] += len(told)
        if asked is not None and (created is None or asked[:2] < (created, s["created_seq"])):
            created, s["created_seq"], s["stage"] = asked
            s |= dict.fromkeys(("in_us", "in_seq", "in_event", "in_actor", "last_us", "last_seq", "last_event"))
            s["created_us"] = created
            if listed:
                told = [x[1:] for x in self._decisions() if x[0] == request]  # anew, for the earlier creation
            s["due"] = (created + self.timeout) // 1000 + 1
        if created is None:  # decisions wait for their request
            latest = max((x[0] for x in told), default=None)
            if latest is not None and (s["last_us"] is None or latest > s["last_us"]):
                s["last_us"] = latest
                s["due"] = (latest + self.timeout + self.retention) // 1000 + 1
            self.requests[request] = tuple(s.values())
            return
        valid = [x for x in told if x[0] >= created]
        if valid:
            place = lambda x: tuple(x[:2])
            early = [x for x in valid if x[0] <= created + self.timeout]
            if early:
                first = min(early, key=place)
                if s["in_us"] is None or place(first) < (s["in_us"], s["in_seq"]):
                    s["in_us"], s["in_seq"], s["in_event"], s["in_actor"] = first
            last = max(valid, key=place)
            if s["last_us"] is None or place(last) > (s["last_us"], s["last_seq"]):
                s["last_us"], s["last_seq"], s["last_event"] = last[:3]
        yield from self._outcome(request, s, watermark)
        self.requests[request] = tuple(s.values())

    def _outcome(self, request: str | None, s: dict, watermark: int) -> Iterator[Row]:
        """A new version of the row, if it has changed."""
        in_time, created = s["in_us"] is not None, s["created_us"]
        outcome = (s["in_event"], s["in_actor"]) if in_time else TIMED_OUT if created + self.timeout <= watermark else None
        if outcome is None:
            return
        final = s["last_event"] if s["last_us"] is not None and (in_time or self.late_decision == "overwrite") else outcome[0]
        now = {"out_us": created, "out_stage": s["stage"], "out_outcome": outcome[0], "out_actor": outcome[1], "out_final": final}
        if not s["version"] or any(s[k] != v for k, v in now.items()):
            s |= now | {"version": s["version"] + 1}
            yield Row(request_id=request, stage=s["stage"], created_us=created, outcome=outcome[0], outcome_actor=outcome[1],
                      final_status=final, version=s["version"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = timerValues.getCurrentWatermarkInMs()
        self._open()
        if self.timer == expiredTimerInfo.getExpiryTimeInMs():
            self.timer = None  # Spark deletes it
        for request in [x for x, s in self.requests.items() if s[DUE] < now]:
            yield from self._due(request, now * 1000)
        self._close()

    def _due(self, request: str | None, watermark: int) -> Iterator[Row]:
        s = self._get(request)
        created = s["created_us"]
        release = (s["last_us"] if created is None else created) + self.timeout + self.retention
        if created is not None:
            yield from self._outcome(request, s, watermark)
        if created is not None or release < watermark:
            s["listed"] = 0
        if release < watermark:
            del self.requests[request]
        else:
            s["due"] = release // 1000 + 1
            self.requests[request] = tuple(s.values())

    def close(self) -> None:
        pass


def approval_outcomes(events: DataFrame, timeout_seconds: int, late_decision: str = "overwrite",
                      lateness: str = "1 hour", retention_seconds: int | None = None,
                      decisions: tuple[str, ...] = DECISIONS, blocks: int = BLOCKS) -> DataFrame:
    """Streaming approval events → versioned outcome rows.

    ``events`` needs request_id, stage, event, actor, ts (timestamp), seq. More
    ``blocks`` have fewer requests each, whose state a batch reads and writes."""
    ev = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness).withColumn("us", F.unix_micros("ts"))
    # the watermark is that of all events: a filter that names ``ts`` stays behind it
    ev = ev.where(F.when(F.col("ts").isNotNull(), F.col("event")).isin("requested", *decisions))
    ev = ev.select(F.pmod(F.xxhash64("request_id"), F.lit(blocks)).alias("block"), "request_id", "stage", "event", "actor", "ts", "us", "seq")
    out = ev.groupBy("block").transformWithState(
        DeadlineProcessor(timeout_seconds, late_decision, retention_seconds, decisions), OUTPUT_SCHEMA, "Append", "EventTime")
    return out.withColumn("created_us", F.timestamp_micros("created_us")).withColumnRenamed("created_us", "created_at")


def current_view(versions: DataFrame) -> DataFrame:
    """W2 over the emitted versions: the latest row per request."""
    cols = [c for c in versions.columns if c not in ("request_id", "version")]
    latest = versions.groupBy("request_id").agg(F.max_by(F.struct(*cols), F.col("version")).alias("r"))
    return latest.select("request_id", "r.*")
