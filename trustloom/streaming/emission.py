"""Emission modes of a sample stream in event time: ON_CHANGE, SAMPLE and POLL.

Samples wait as keyed state until the watermark has passed them, so they are taken in order of time even where they arrive out of
order; a timer of the key wakes it then. ON_CHANGE emits the samples that differ from the one before. SAMPLE emits the newest value at
every tick of an interval. POLL is a run over what is available.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

ROCKSDB = ("spark.sql.streaming.stateStore.providerClass",
           "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
# Seconds between ticks of the agent, the collector and the display.
AGENT_SECONDS, COLLECTOR_SECONDS, DISPLAY_SECONDS = 3, 5, 3
WAITING = StructType([StructField("us", LongType()), StructField("seq", LongType()), StructField("v_num", DoubleType())])


def tick_trigger(interval_ns: int | None = None, seconds: float = AGENT_SECONDS) -> dict[str, str]:
    """Trigger of a subscription interval in ns, or of the default tick."""
    length = interval_ns / 1e9 if interval_ns else seconds
    return {"processingTime": f"{length:g} seconds"}


class InEventTime(StatefulProcessor):
    """Takes the samples of a key in order of time once the watermark has passed them."""

    def __init__(self, keys: Sequence[str]) -> None:
        self.keys = list(keys)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", WAITING)
        self.last = handle.getValueState("last", WAITING)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            fresh = batch[["us", "seq", "v_num"]]
            if len(fresh):
                self.waiting.appendList(list(fresh.itertuples(index=False, name=None)))
        self.wake(timerValues.getCurrentWatermarkInMs(), min((r[0] for r in self.waiting.get()), default=None))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(tuple(r) for r in self.waiting.get())
        ready = [r for r in waiting if r[0] <= watermark * 1000]
        rest = waiting[len(ready):]
        if ready:
            if rest:
                self.waiting.put(rest)
            else:
                self.waiting.clear()
        last = tuple(self.last.get()) if self.last.exists() else None
        out, last = self.emitted(ready, last, watermark)
        if last is not None:
            self.last.update(last)
        self.wake(watermark, self.next_moment(rest, last, watermark))
        frame = pd.DataFrame(out, columns=["us", "seq", "v_num"])
        for position, name in enumerate(self.keys):
            frame.insert(position, name, key[position])
        yield frame

    def wake(self, watermark: int, us: int | None) -> None:
        """A timer at a moment, or right after the watermark if that has passed it."""
        if us is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(max(-(-us // 1000), watermark + 1))

    def emitted(self, ready: list[tuple], last: tuple | None, watermark: int) -> tuple[list[tuple], tuple | None]:
        raise NotImplementedError

    def next_moment(self, rest: list[tuple], last: tuple | None, watermark: int) -> int | None:
        return rest[0][0] if rest else None

    def close(self) -> None:
        pass


class OnChange(InEventTime):
    """The samples whose value is not that of the sample before; the first counts as a change."""

    def emitted(self, ready, last, watermark):
        out = []
        for row in ready:
            if last is None or row[2] != last[2]:
                out.append(row)
            last = row
        return out, last


class Sampled(InEventTime):
    """The newest value at every tick from a key's first sample on; a tick's ``us`` is its own time."""

    def __init__(self, keys: Sequence[str], interval_us: int) -> None:
        super().__init__(keys)
        self.interval = interval_us

    def emitted(self, ready, last, watermark):
        out, at, upto = [], 0, watermark * 1000
        # ``last`` is the newest sample, with the last tick emitted for it in place of its time.
        tick = -(-ready[0][0] // self.interval) * self.interval if last is None and ready else None
        if last is not None:
            tick = last[0] + self.interval
        while tick is not None and tick <= upto:
            while at < len(ready) and ready[at][0] <= tick:
                last, at = (tick - self.interval, *ready[at][1:]), at + 1
            out.append((tick, *last[1:]))
            last = (tick, *last[1:])
            tick += self.interval
        for row in ready[at:]:
            last = (tick - self.interval, *row[1:])
        return out, last

    def next_moment(self, rest, last, watermark):
        return last[0] + self.interval if last is not None else super().next_moment(rest, last, watermark)


def _moments(samples: DataFrame, time: str, delay: str) -> DataFrame:
    return samples.withWatermark(time, delay).withColumn("us", F.unix_micros(F.col(time).cast("timestamp")))


def _with_state(samples: DataFrame, keys: Sequence[str], processor: InEventTime) -> DataFrame:
    kinds = ", ".join(f"{k} {samples.schema[k].dataType.simpleString()}" for k in keys)
    return samples.groupBy(*keys).transformWithStateInPandas(
        processor, outputStructType=f"{kinds}, us BIGINT, seq BIGINT, v_num DOUBLE", outputMode="Append", timeMode="EventTime")


def on_change_stream(samples: DataFrame, keys: Sequence[str], time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """Changes of every series (keys, ``us, seq, v_num``) up to the watermark. ``samples`` has the keys, ``seq, v_num`` and a timestamp."""
    return _with_state(_moments(samples, time, delay), keys, OnChange(keys))


def sample_stream(samples: DataFrame, keys: Sequence[str], interval_ns: int, time: str = "ts", delay: str = "1 minute") -> DataFrame:
    """The newest value of every series at each tick of a subscription's interval, up to the watermark."""
    return _with_state(_moments(samples, time, delay), keys, Sampled(keys, interval_ns // 1000))


def poll() -> dict[str, bool]:
    """Trigger of a single answer: all that is available now."""
    return {"availableNow": True}


def tick_of(us: Column, interval_ns: int) -> Column:
    """The last tick at or before a moment."""
    return us - F.pmod(us, F.lit(interval_ns // 1000))
