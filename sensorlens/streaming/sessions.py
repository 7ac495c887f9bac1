"""Gap sessions with their delays from a stream of events, in the state of each key; nothing is read again.

State of a key: the events that the watermark has not passed, and of the open session its bounds, running moments of the delays
and whether the last delay may begin a burst. Events are taken in the order of their times once the watermark has passed them,
so that events that come in another order give what a batch gives. A timer at the watermark that rules out another event within
the gap closes the session and emits it. Events behind the watermark are left out by Spark and counted in its progress.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..operators.sessions import GAP_SECONDS, KEYS

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: The state store that list state and timers need.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: ``last`` is null where no session is open; ``number`` goes on.
OPEN = "number long, start long, last long, events long, delays long, mean double, squares double, least double, most double, short boolean, bursts long, reordered long"
FEATURES = (
    "session string, start_time long, end_time long, event_count long, duration_sec double, avg_inter_cmd_delay double, std_inter_cmd_delay double, "
    "min_inter_cmd_delay double, max_inter_cmd_delay double, burst_count long, reordered long"
)
SHORT, LONG = 0.5, 5.0


class SessionState:
    """The open session of a key. Times are microseconds."""

    def __init__(self, key: tuple, gap: int, held: tuple | None):
        self.key, self.gap = key, gap
        (self.number, self.start, self.last, self.events, self.delays, self.mean, self.squares, self.least, self.most, self.short, self.bursts, self.reordered) = held or (0, None, None, *[0] * 8, 0)

    def held(self) -> tuple:
        whole = (self.number, self.start, self.last, self.events, self.delays)
        return (*whole, float(self.mean), float(self.squares), float(self.least), float(self.most), bool(self.short), self.bursts, self.reordered)

    def take(self, at: int) -> Iterator[tuple]:
        """An event not earlier than those before; gives the session that it shows to be over."""
        if self.last is not None and at - self.last > self.gap:
            yield self.close()
        if self.last is None:
            self.number, self.start, self.last, self.events, self.delays, self.mean, self.squares, self.short, self.bursts = self.number + 1, at, at, 1, 0, 0.0, 0.0, False, 0
            return
        delay = (at - self.last) // 1000 / 1000.0
        self.bursts += self.short and delay > LONG
        self.short = delay < SHORT
        self.least, self.most = (min(self.least, delay), max(self.most, delay)) if self.delays else (delay, delay)
        self.delays += 1
        off = delay - self.mean
        self.mean += off / self.delays
        self.squares += off * (delay - self.mean)
        self.events, self.last = self.events + 1, at

    def close(self) -> tuple:
        name = "::".join([*(str(k) for k in self.key if k is not None), f"s{self.number}"])
        n = self.delays
        spread = math.sqrt(max(0.0, self.squares) / n) if n else 0.0
        out = (name, self.start, self.last, self.events, (self.last - self.start) / 1e6, self.mean if n else 0.0, spread, self.least if n else 0.0, self.most if n else 0.0, self.bursts, self.reordered)
        self.last, self.reordered = None, 0
        return out


class SessionFeatures(StatefulProcessor):
    def __init__(self, gap_seconds: float, columns: list[str]):
        self.gap, self.columns = int(gap_seconds * 1_000_000), columns
        self.schemas = StructType.fromDDL(OPEN), StructType.fromDDL("at long")  # workers have no session to parse them

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", self.schemas[0])
        self.waiting = handle.getListState("waiting", self.schemas[1])

    def _state(self, key: tuple) -> SessionState:
        return SessionState(key, self.gap, tuple(self.open.get()) if self.open.exists() else None)

    def _settle(self, key: tuple, state: SessionState, waiting: list[int], watermark: int) -> Iterator[Row]:
        """Takes what the watermark (milliseconds) has passed, and waits for the next that it must pass."""
        waiting.sort()
        now = watermark * 1000
        done = 0
        while done < len(waiting) and waiting[done] <= now:
            yield from (self._row(key, x) for x in state.take(waiting[done]))
            done += 1
        if state.last is not None and now > state.last + self.gap:
            yield self._row(key, state.close())
        rest = waiting[done:]
        if rest:
            self.waiting.put([(at,) for at in rest])
        elif done:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        next_ones = [rest[0]] if rest else []
        if state.last is not None:
            next_ones.append(state.last + self.gap + 1)
        if next_ones:
            self.handle.registerTimer(-(-min(next_ones) // 1000))
        self.open.update(state.held())

    def _row(self, key: tuple, made: tuple) -> Row:
        return Row(*self.columns)(*key, *made)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._state(tuple(key))
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        latest = max(waiting, default=state.last)
        for row in rows:
            if latest is not None and row["_at"] < latest:
                state.reordered += 1
            else:
                latest = row["_at"]
            waiting.append(row["_at"])
        yield from self._settle(tuple(key), state, waiting, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        waiting = [r[0] for r in self.waiting.get()] if self.waiting.exists() else []
        yield from self._settle(tuple(key), self._state(tuple(key)), waiting, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def session_features(events: DataFrame, keys=KEYS, ts: str = "timestamp", gap_seconds: float = GAP_SECONDS, delay: str = "10 minutes") -> DataFrame:
    """A stream of closed sessions: name, bounds, delays and bursts as ``operators.sessions`` gives them, and ``reordered``, how
    many of the events that came while it was open came after a later one.

    Rows without a time are left out. A key holds the events of one ``delay`` and one session's numbers, whatever its length.
    The session needs the state store of ``STORE``.
    """
    columns = [*keys, *StructType.fromDDL(FEATURES).names]
    schema = StructType([events.schema[k] for k in keys] + StructType.fromDDL(FEATURES).fields)
    timed = events.where(F.col(ts).isNotNull()).select(*keys, F.col(ts).cast("timestamp").alias(ts)).withWatermark(ts, delay).withColumn("_at", F.unix_micros(ts))
    closed = timed.groupBy(*keys).transformWithState(SessionFeatures(gap_seconds, columns), schema, "Append", "EventTime")
    return closed.withColumns({c: F.timestamp_micros(c) for c in ("start_time", "end_time")})


def late_events(query: StreamingQuery) -> int:
    """How many rows of a query's batches came behind the watermark and were left out."""
    return sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"])
