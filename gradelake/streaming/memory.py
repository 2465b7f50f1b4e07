"""Short-term memory of runs as stream state: what a run has noted under a key, forgotten a time after it was noted.

Events are (run_id, key, value, ts): a value is noted or, where it is null, forgotten. State is a map a run with a time to
live on each key, in the engine's state store, so it is checkpointed and taken up again with the stream; every event
gives the run's memory after it. Entries expire by event time: an entry noted at time t is gone for events from t + ttl on,
and timers drop it once the watermark has passed that, so an idle run holds no state.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "run_id string, key string, value string, noted_at timestamp, kind string, remembered array<string>"


class RunMemory(StatefulProcessor):
    """The memory of one run; ``ttl`` is how long an entry lasts after it was noted."""

    def __init__(self, ttl: timedelta) -> None:
        self.ttl_ms = int(ttl.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        """Open the run's map: key to value and the time it was noted, in milliseconds."""
        self.handle = handle
        self.held = handle.getMapState("held", "key string", "value string, noted long")

    def _alive(self, held: dict[str, tuple[str, int]], now: int) -> dict[str, tuple[str, int]]:
        return {k: v for k, v in held.items() if v[1] + self.ttl_ms > now}

    def _entries(self) -> dict[str, tuple[str, int]]:
        return {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}

    def _keep(self, before: dict[str, tuple[str, int]], after: dict[str, tuple[str, int]]) -> None:
        for name in before.keys() - after.keys():
            self.held.removeKey((name,))
        for name, entry in after.items():
            if before.get(name) != entry:
                self.held.updateValue((name,), entry)
                self.handle.registerTimer(entry[1] + self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        """Take a run's events in the order of their time; ties by key. State is read and written once a batch."""
        events, out = pd.concat(list(rows)).sort_values(["ts", "key"], kind="stable"), []
        before = held = self._entries()
        for event in events.itertuples():
            now = int(event.ts.value // 1_000_000)
            held = self._alive(held, now)
            forgets = event.value is None or pd.isna(event.value)
            held = {k: v for k, v in held.items() if k != event.key} | ({} if forgets else {event.key: (event.value, now)})
            out.append((key[0], event.key, event.value, event.ts, "forgotten" if forgets else "noted", sorted(f"{k}={v}" for k, (v, _) in held.items())))
        self._keep(before, held)
        yield pd.DataFrame(out, columns=["run_id", "key", "value", "noted_at", "kind", "remembered"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Drop what has expired once the watermark has passed; a row for each entry that goes."""
        held = self._entries()
        left = self._alive(held, expiredTimerInfo.getExpiryTimeInMs())
        self._keep(held, left)
        gone = sorted((k, v) for k, v in held.items() if k not in left)
        rows = [(key[0], k, v, pd.Timestamp(noted, unit="ms"), "expired", sorted(f"{x}={y}" for x, (y, _) in left.items())) for k, (v, noted) in gone]
        if rows:
            yield pd.DataFrame(rows, columns=["run_id", "key", "value", "noted_at", "kind", "remembered"])

    def close(self) -> None:
        """The state store closes itself."""


def remembered(events: DataFrame, ttl: timedelta, late: str = "1 minute") -> DataFrame:
    """A stream of events (run_id, key, value, ts) as what each run remembers after each, and what it forgets with time."""
    rows = events.withWatermark("ts", late).select("run_id", "key", "value", "ts")
    return rows.groupBy("run_id").transformWithStateInPandas(RunMemory(ttl), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")


#: State variables of this kind need this state store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
