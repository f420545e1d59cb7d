"""Stateful processors with value state and timers: work items with attempts and back-off, and sources that fall silent."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Attempts before an item is given up, and how long a failed one waits (fixed values).
ATTEMPTS, BACK_OFF_MS = 3, 24 * 3600 * 1000
WARN_MS, BAD_MS = 24 * 3600 * 1000, 7 * 24 * 3600 * 1000
LOG = "key long, event_id long, at long, seq long, from_status string, status string, attempts int, outcome string"
ALERTS = "key long, at long, state string"


class StatusMachine(StatefulProcessor):
    """Rows (key, event_id, at in ms, command) to a log of transitions (LOG), one row a command and one a timer.

    claim starts an attempt of a pending item, or of one in `retry` whose back-off is over; else `not_eligible`.
    fail ends the attempt: `retry` until the back-off is over, `failed_permanent` after the last attempt.
    finalise completes the item, requeue makes a given-up item pending again with no attempts used.
    Each command expects a status (fail and finalise: processing; requeue: failed_permanent); where the item has another
    one, nothing changes and the row says `lost_race`. A command older than the last one of its key changes nothing
    either: `out_of_order`. When the back-off ends without a command, a timer makes the item pending: `backed_off`.

    A key's commands of one micro-batch are put in the order of (at, event_id); the state is one row a key.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("item", "status string, attempts int, ready long, last long, seq long")

    def _read(self) -> list:
        return list(self.state.get()) if self.state.exists() else ["pending", 0, 0, -1, 0]

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        status, attempts, ready, last, seq = self._read()
        for at, event_id, command in sorted((r.at, r.event_id, r.command) for r in rows):
            before, outcome, seq = status, "lost_race", seq + 1
            if at < last:
                outcome = "out_of_order"
            elif command == "claim":
                outcome = "not_eligible"
                if status == "pending" or (status == "retry" and at >= ready):
                    status, attempts, outcome = "processing", attempts + 1, "claimed"
            elif command == "fail" and status == "processing":
                status, outcome = ("failed_permanent" if attempts >= ATTEMPTS else "retry"), "failed"
                ready = at + BACK_OFF_MS
            elif command == "finalise" and status == "processing":
                status, outcome = "completed", "finalised"
            elif command == "requeue" and status == "failed_permanent":
                status, attempts, outcome = "pending", 0, "requeued"
            last = max(last, at)
            yield Row(key=key[0], event_id=event_id, at=at, seq=seq, from_status=before, status=status, attempts=attempts, outcome=outcome)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "retry":
            self.handle.registerTimer(ready)
        self.state.update((status, attempts, ready, last, seq))

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, attempts, ready, last, seq = self._read()
        if status == "retry" and ready <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.update(("pending", attempts, ready, last, seq + 1))
            yield Row(key=key[0], event_id=None, at=ready, seq=seq + 1, from_status=status, status="pending", attempts=attempts, outcome="backed_off")

    def close(self) -> None:
        pass


class FreshnessAlert(StatefulProcessor):
    """Rows (key, at in ms) to alerts (ALERTS): `good` when rows come, `warn` and `bad` when none came for warn and bad ms.

    The last two come from timers, without any new row. With `live` the silence is measured on the machine's clock from the
    micro-batch that brought the last row (time mode ProcessingTime), else on the watermark from the last row's own time.
    """

    def __init__(self, warn: int = WARN_MS, bad: int = BAD_MS, live: bool = False):
        self.warn, self.bad, self.live = warn, bad, live

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("source", "since long")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = max(r.at for r in rows)
        since = timerValues.getCurrentProcessingTimeInMs() if self.live else newest
        if self.state.exists():
            since = max(since, self.state.get()[0])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.state.update((since,))
        self.handle.registerTimer(since + self.warn)
        self.handle.registerTimer(since + self.bad)
        yield Row(key=key[0], at=since, state="good")

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, since = expiredTimerInfo.getExpiryTimeInMs(), self.state.get()[0]
        if at in (since + self.warn, since + self.bad):
            yield Row(key=key[0], at=at, state="warn" if at == since + self.warn else "bad")

    def close(self) -> None:
        pass


def status_log(commands: DataFrame) -> DataFrame:
    """The transitions of a stream of commands(key, event_id, at, command) that has a watermark."""
    return commands.groupBy("key").transformWithState(StatusMachine(), LOG, "Append", "EventTime")


def freshness(rows: DataFrame, warn: int = WARN_MS, bad: int = BAD_MS, live: bool = False) -> DataFrame:
    """The alerts of a stream of rows(key, at); a watermark is needed unless live."""
    return rows.groupBy("key").transformWithState(FreshnessAlert(warn, bad, live), ALERTS, "Append", "ProcessingTime" if live else "EventTime")
