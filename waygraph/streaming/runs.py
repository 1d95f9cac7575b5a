"""Runs of frames over streams: follows, queues and crossings as they last, with state for each pair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from waygraph.config import T, Thresholds

KEY = ("scenario_token", "predicate", "s_track", "o_track")
OUT = "scenario_token string, predicate string, s_track string, o_track string, frame_index int, timestamp_us bigint, start_us bigint, duration_s double"


class RunProcessor(StatefulProcessor):
    """Frames of one pair wait until the watermark has passed them, so that late and repeated ones find their place; then they go on with the run, or begin one."""

    def __init__(self, most_gap_us: int) -> None:
        self.most_gap_us = most_gap_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "timestamp_us bigint", "frame_index int")
        self.run = handle.getValueState("run", "start_us bigint, frame_index int, timestamp_us bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        last = self.run.get()
        for part in rows:
            for frame, us in zip(part["frame_index"].tolist(), part["timestamp_us"].tolist(), strict=True):
                # what comes behind the run's last frame can't be put in its place any more
                if (last is None or us > last[2]) and not self.waiting.containsKey((us,)):
                    self.waiting.updateValue((us,), (frame,))
                    self.handle.registerTimer(us // 1000)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted((us, frame) for (us,), (frame,) in self.waiting.iterator() if us // 1000 <= passed)
        out = []
        for us, frame in due:
            self.waiting.removeKey((us,))
            last = self.run.get()
            goes_on = last is not None and frame == last[1] + 1 and us - last[2] <= self.most_gap_us
            start = last[0] if goes_on else us
            self.run.update((start, frame, us))
            out.append((*key, frame, us, start, (us - start) / 1e6))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


def stream_runs(facts: DataFrame, event_time: str, late: str = "5 seconds", t: Thresholds = T) -> DataFrame:
    """facts (KEY, frame_index, timestamp_us, event_time) with the start and duration of their run, once no earlier frame can come."""
    rows = facts.select(*KEY, "frame_index", "timestamp_us", event_time).withWatermark(event_time, late)
    gap = int(t.sample_interval_s * t.maximum_gap_factor * 1e6)
    return rows.groupBy(*KEY).transformWithStateInPandas(RunProcessor(gap), OUT, "Append", "EventTime")
