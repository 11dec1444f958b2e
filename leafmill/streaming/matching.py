"""Request matching on a stream: keyed first-in first-out state, one row of state per event."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "seq BIGINT, completion_seq BIGINT, status STRING, response_status INT"
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def request_events(requests: DataFrame, completions: DataFrame, key: str = "url") -> DataFrame:
    """Both inputs as one stream of (url, ts, seq, done, kind, code)."""
    opened = requests.select(F.col(key).cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"), "seq", F.lit(0).alias("done"),
                             F.lit(None).cast("string").alias("kind"), F.lit(None).cast("int").alias("code"))
    closed = completions.select(F.col(key).cast("string").alias("url"), F.col("ts").cast("timestamp").alias("ts"), "seq", F.lit(1).alias("done"),
                                "kind", F.col("status").alias("code"))
    return opened.unionByName(closed)


class Matcher(StatefulProcessor):
    """Queue of open requests of a key, fed in time order.

    An event waits under its time until the watermark has passed it; a timer at that time hands it over, and timers
    fire in the order of time. A request has a second timer, at the end of its ttl, set when it arrives: one set
    while timers fire would wait for the next batch. State:
    ``waiting`` maps a time in milliseconds to the events of that time, ``open`` maps a request's
    number to (seq, time), and ``ends`` holds the first number in use and the next one. So an event writes
    its own rows of state and no others, however long the queue is.
    """

    def __init__(self, ttl_ms: int):
        self.ttl = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at BIGINT", "events STRING")
        self.open = handle.getMapState("open", "number BIGINT", "seq BIGINT, at BIGINT")
        self.ends = handle.getValueState("ends", "first BIGINT, next BIGINT")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        fresh: dict[int, list] = {}
        ahead = timerValues.getCurrentWatermarkInMs() + 1  # where the timer of an event of the watermark's own millisecond is set
        for row in rows:
            fresh.setdefault(max(row.micros // 1000, ahead), []).append([row.micros, row.seq, row.done, row.kind, row.code])
            if not row.done:
                self.handle.registerTimer(max(row.micros // 1000 + self.ttl, ahead))
        for at, events in fresh.items():
            if self.waiting.containsKey((at,)):
                events += json.loads(self.waiting.getValue((at,))[0])
            else:
                self.handle.registerTimer(at)
            self.waiting.updateValue((at,), (json.dumps(events),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at, out = expiredTimerInfo.getExpiryTimeInMs(), []
        first, upto = self.ends.get() if self.ends.exists() else (0, 0)
        first = self._expire(first, upto, at, out)
        if self.waiting.containsKey((at,)):
            events = sorted(json.loads(self.waiting.getValue((at,))[0]), key=lambda e: e[:2])
            self.waiting.removeKey((at,))
            for micros, seq, done, kind, code in events:
                first = self._expire(first, upto, micros // 1000, out)
                if not done:
                    self.open.updateValue((upto,), (seq, micros // 1000))
                    upto += 1
                elif first < upto:
                    out.append((self._pop(first), seq, "failed" if kind == "failed" else "completed", code))
                    first += 1
        if first < upto:
            self.ends.update((first, upto))
        elif self.ends.exists():
            self.ends.clear()
        for seq, completion, status, code in out:
            yield Row(url=key[0], seq=seq, completion_seq=completion, status=status, response_status=code)

    def _pop(self, number: int) -> int:
        seq, _ = self.open.getValue((number,))
        self.open.removeKey((number,))
        return seq

    def _expire(self, first: int, upto: int, now: int, out: list) -> int:
        while first < upto and self.open.getValue((first,))[1] + self.ttl <= now:
            out.append((self._pop(first), None, "pending", None))
            first += 1
        return first

    def close(self) -> None:
        pass


def stream_match_requests(requests: DataFrame, completions: DataFrame, ttl_seconds: int = 3600,
                          delay: str = "10 minutes", key: str | None = None) -> DataFrame:
    """Matched requests as they close, in time order even if they arrive out of it;
    requests open longer than the ttl come out as ``pending`` and match nothing later.

    ``key`` is what a completion shares with its request: ``request_id`` where both inputs have it, else the
    URL, whose completions close its oldest open request. A request id spreads a busy URL over all tasks. State is a row per
    open request and per event younger than the watermark, in a RocksDB store, which the session must name.
    The key is the column ``url`` of the result. Rows later than the watermark are dropped; events without a time too.
    """
    if key is None:
        key = "request_id" if "request_id" in requests.columns and "request_id" in completions.columns else "url"
    if requests.sparkSession.conf.get(STORE, "") != ROCKS:
        raise ValueError(f"set {STORE} to {ROCKS}")
    events = request_events(requests, completions, key).filter("ts IS NOT NULL").withWatermark("ts", delay).withColumn("micros", F.unix_micros("ts"))
    matched = events.groupBy("url").transformWithState(Matcher(ttl_seconds * 1000), f"url STRING, {OUTPUT}", "append", "eventTime")
    return matched.select("seq", "url", "completion_seq", "status", "response_status")
