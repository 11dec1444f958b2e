"""Keyed state that sees its events in time order.

A micro-batch is ordered only in itself. Here events wait in the state until the
watermark has passed them and are then handled in the order of (time, number), so
the result is that of the whole stream in order, whatever came in which batch.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = "memory STRING, held STRING"


def in_order(events: DataFrame, key: str, order: str, output: str, handle: Callable[[dict, dict, list], None],
             expire: Callable[[dict, int, list], int | None] | None = None) -> DataFrame:
    """Run ``handle(memory, event, out)`` over the events of each key in order of (ts, ``order``).

    ``events`` has a watermark on ``ts``. ``memory`` is a dict of JSON values. ``out`` takes
    dicts of ``output`` columns (without the key, which comes first). ``expire(memory, now, out)``
    drops what is too old at a time in milliseconds and returns the next time that something
    gets too old; it runs before every event and whenever the watermark has moved. The
    waiting events of a key are those younger than the watermark.
    """
    names = [c.split()[0] for c in output.split(", ")]
    expire = expire or (lambda memory, now, out: None)

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        memory, held = map(json.loads, state.get) if state.exists else ({}, [])
        if not state.hasTimedOut:
            for batch in batches:
                times = batch["ts"].astype("int64") // (10 ** 6 if "ns" in str(batch["ts"].dtype) else 10 ** 3)
                rest = batch.drop(columns=["ts", key]).astype(object)
                rest = rest.where(rest.notna(), None)
                held += [[int(t), {c: v.item() if hasattr(v, "item") else v for c, v in row.items()}] for t, row in zip(times, rest.to_dict("records"))]
        watermark, out = state.getCurrentWatermarkMs(), []
        held.sort(key=lambda e: (e[0], e[1][order]))
        ready = 0
        while ready < len(held) and held[ready][0] <= watermark:
            at, event = held[ready]
            expire(memory, at, out)
            handle(memory, event | {"ts": at}, out)
            ready += 1
        held = held[ready:]
        due = [t for t in (expire(memory, watermark, out), held[0][0] if held else None) if t is not None]
        if held or memory:
            state.update((json.dumps(memory), json.dumps(held)))
            if due:
                state.setTimeoutTimestamp(max(min(due), watermark + 1))
        elif state.exists:
            state.remove()
        rows = pd.DataFrame([{key: group[0]} | row for row in out], columns=[key, *names])
        yield rows.convert_dtypes() if len(rows) else rows

    kind = dict(events.dtypes)[key]
    return events.groupBy(key).applyInPandasWithState(step, f"{key} {kind}, {output}", STATE, "append", GroupStateTimeout.EventTimeTimeout)
