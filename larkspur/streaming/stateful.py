"""Stateful processors for decisions that depend on earlier decisions (STR3, STR8, STR10, STR11)."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from larkspur.operators.notify import accept_in_order

C = F.col
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state of these processors needs the RocksDB store; state then lives on disk, not on the heap."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def micros(series: pd.Series) -> pd.Series:
    return series.astype("datetime64[us]").astype("int64")


class RateLimiter(StatefulProcessor):
    """Allows an event when fewer than ``limit`` were allowed in the window before it; keeps allowed times only."""

    def __init__(self, limit: int, window_seconds: int):
        self.limit, self.window = limit, window_seconds * 1_000_000

    def init(self, handle) -> None:
        self.times = handle.getValueState("times", "times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat([r[["event_id", "created_at"]] for r in rows])
        pdf["_t"] = micros(pdf["created_at"])
        pdf = pdf.sort_values(["_t", "event_id"])
        recent = deque(self.times.get()[0]) if self.times.exists() else deque()
        allowed = accept_in_order(pdf["_t"].to_numpy(), self.limit, self.window, recent)
        self.times.update(([int(t) for t in recent],))
        yield pd.DataFrame({"scope": key[0], "event_id": pdf["event_id"].to_numpy(), "allowed": allowed})

    def close(self) -> None:
        pass


def rate_limit(events: DataFrame, *, scope: str, limit: int, window_seconds: int = 3600) -> DataFrame:
    """Streaming rate limit; the size of a micro-batch (files per trigger) bounds what one scope holds at once."""
    use_rocksdb(events.sparkSession)
    rows = events.select(C(scope).cast("string").alias("scope"), "event_id", "created_at")
    return rows.groupBy("scope").transformWithStateInPandas(
        RateLimiter(limit, window_seconds), "scope string, event_id bigint, allowed boolean", "Append", "None")


class BalanceAlerts(StatefulProcessor):
    """Running balance per organization: low and zero alerts once per crossing; a charge beyond the balance is rejected."""

    def __init__(self, low_cents: int):
        self.low = low_cents

    def init(self, handle) -> None:
        self.state = handle.getValueState("balance", "balance bigint, low_sent boolean, zero_sent boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))
        pdf["_t"] = micros(pdf["created_at"])
        pdf = pdf.sort_values(["_t", "transaction_id"])
        balance, low_sent, zero_sent = self.state.get() if self.state.exists() else (0, False, False)
        out = []
        for tx, kind, amount in zip(pdf["transaction_id"], pdf["kind"], pdf["amount_cents"]):
            after = balance + int(amount)
            if kind == "usage_deduction" and after < 0:
                out.append((int(tx), "rejected", balance))
                continue
            balance = after
            if int(amount) > 0:  # every credit makes room for new alerts and raises none
                low_sent = zero_sent = False
            elif balance <= 0 and not zero_sent:
                zero_sent = True
                out.append((int(tx), "zero", balance))
            elif 0 < balance <= self.low and not low_sent:
                low_sent = True
                out.append((int(tx), "low", balance))
        self.state.update((balance, low_sent, zero_sent))
        frame = pd.DataFrame(out, columns=["transaction_id", "alert", "balance"])
        yield frame.assign(organization_id=int(key[0]))[["organization_id", "transaction_id", "alert", "balance"]].astype({"transaction_id": "int64", "balance": "int64"})

    def close(self) -> None:
        pass


def balance_alerts(ledger: DataFrame, *, low_cents: int) -> DataFrame:
    use_rocksdb(ledger.sparkSession)
    rows = ledger.select("organization_id", "transaction_id", "kind", "amount_cents", "created_at")
    return rows.groupBy("organization_id").transformWithStateInPandas(
        BalanceAlerts(low_cents), "organization_id bigint, transaction_id bigint, alert string, balance bigint", "Append", "None")


class SlaMonitor(StatefulProcessor):
    """Warning and breach of a clock, each announced once when event time passes it; a pause moves both instants.

    One state holds all clocks of a bucket of findings with one timer, at the earliest instant that is still to come, so
    a micro-batch asks the state store once a bucket and not once a finding.
    """

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("clocks", "ids array<string>, warn_ms array<bigint>, due_ms array<bigint>, warned array<boolean>, breached array<boolean>, timer_ms bigint")

    def _load(self) -> tuple[dict, int | None]:
        """finding -> (warn, due, warned, breached), and the instant of the timer."""
        if not self.state.exists():
            return {}, None
        ids, *columns, timer = self.state.get()
        return dict(zip(ids, zip(*columns))), timer

    def _store(self, clocks: dict, timer: int | None) -> None:
        coming = [warn for warn, _, warned, _ in clocks.values() if not warned] + [due for _, due, _, breached in clocks.values() if not breached]
        nearest = min(coming, default=None)
        if timer is not None and timer != nearest:
            self.handle.deleteTimer(timer)
        if nearest is not None and timer != nearest:
            self.handle.registerTimer(nearest)
        if clocks:
            self.state.update((list(clocks), *(list(c) for c in zip(*clocks.values())), nearest))
        else:
            self.state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        clocks, timer = self._load()
        pdf = pd.concat(list(rows)).sort_values("event_time", kind="stable")
        for finding, kind, warn_ms, due_ms, shift_ms in zip(*(pdf[c] for c in ("finding_id", "kind", "warn_ms", "due_ms", "shift_ms"))):
            known = clocks.get(finding)
            if kind == "clock" and not known:
                clocks[finding] = (int(warn_ms), int(due_ms), False, False)
            elif kind == "resume" and known:
                warn, due, warned, breached = known
                clocks[finding] = (warn + int(shift_ms), due + int(shift_ms), warned, breached)
            elif kind == "close" and known:
                del clocks[finding]
        self._store(clocks, timer)
        yield pd.DataFrame({"finding_id": [], "alert": []}).astype({"finding_id": "str", "alert": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        clocks, _ = self._load()
        # timers expire up to the watermark; everything that is due by then is announced at once
        passed = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        out = []
        for finding, (warn, due, warned, breached) in clocks.items():
            if not warned and warn <= passed and (warn < due or due > passed):
                warned = True
                out.append((finding, "warning"))
            if not breached and due <= passed:
                warned = breached = True
                out.append((finding, "breach"))
            clocks[finding] = (warn, due, warned, breached)
        self._store(clocks, None)
        yield pd.DataFrame(out, columns=["finding_id", "alert"]).astype({"finding_id": "str", "alert": "str"})

    def close(self) -> None:
        pass


def sla_monitor(changes: DataFrame, *, delay: str = "0 seconds", buckets: int = 512) -> DataFrame:
    """``changes`` has finding_id, kind (clock, resume, close), event_time, warn_ms, due_ms, shift_ms.

    ``buckets`` shares the findings out over the state; a stream keeps the number it was started with.
    """
    use_rocksdb(changes.sparkSession)
    rows = changes.withColumn("event_time", C("event_time").cast("timestamp")).withWatermark("event_time", delay)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("finding_id"), F.lit(buckets)).cast("int"))
    return rows.groupBy("bucket").transformWithStateInPandas(SlaMonitor(), "finding_id string, alert string", "Append", "EventTime")


class RetryStuck(StatefulProcessor):
    """Re-queues an event that stays pending; gives up after the last attempt."""

    def __init__(self, wait_ms: int, max_attempts: int):
        self.wait_ms, self.max_attempts = wait_ms, max_attempts

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("attempts", "attempts int")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            if (pdf["status"] != "pending").any():
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.state.clear()
            elif not self.state.exists():
                self.state.update((0,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
        yield pd.DataFrame({"event_id": [], "action": []}).astype({"event_id": "int64", "action": "str"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        action = []
        if self.state.exists():
            attempts = self.state.get()[0]
            if attempts < self.max_attempts:
                action = ["retry"]
                self.state.update((attempts + 1,))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)
            else:
                action = ["failed"]
                self.state.clear()
        yield pd.DataFrame({"event_id": [int(key[0])] * len(action), "action": action}).astype({"event_id": "int64", "action": "str"})

    def close(self) -> None:
        pass


def retry_stuck(events: DataFrame, *, wait_minutes: float = 10, max_attempts: int = 3) -> DataFrame:
    use_rocksdb(events.sparkSession)
    rows = events.select("event_id", "status")
    return rows.groupBy("event_id").transformWithStateInPandas(RetryStuck(int(wait_minutes * 60_000), max_attempts), "event_id bigint, action string", "Append", "ProcessingTime")
