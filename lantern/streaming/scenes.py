"""Scenes of cues that arrive as a stream, some late, with the last cue's end as state."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lantern.operators.chunking import SCENE_GAP

#: The state store that keeps lists and timers; a session that streams scenes must name it.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Scenes(StatefulProcessor):
    """Cues wait until the watermark has passed them; then they go out in order, each compared with the end of the one before."""

    def __init__(self, gap: float, name: str):
        self.gap, self.name = gap, name

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.before = handle.getValueState("before", "end double, scene int")
        self.waiting = handle.getListState("waiting", "cue long, at long, start_s double, end_s double")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for frame in rows:
            if frame.empty:
                continue
            self.waiting.appendList([(int(c), int(a), float(s), float(e)) for c, a, s, e in zip(frame["cue"], frame["at_ms"], frame["start_s"], frame["end_s"], strict=True)])
            for at in sorted(set(frame["at_ms"])):
                self.handle.registerTimer(int(at))
        return iter(())

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted(self.waiting.get(), key=lambda r: (r[1], r[0]))
        due = [r for r in held if r[1] <= passed]
        if due:
            end, scene = self.before.get() if self.before.exists() else (None, 0)
            cues, scenes = [], []
            for cue, _, start_s, end_s in due:
                scene += end is not None and start_s - end >= self.gap
                end = end_s
                cues.append(cue)
                scenes.append(scene)
            self.before.update((end, scene))
            rest = held[len(due) :]
            self.waiting.clear()
            if rest:
                self.waiting.appendList([tuple(r) for r in rest])
            yield pd.DataFrame({self.name: [key[0]] * len(cues), "cue": cues, "scene": scenes})

    def close(self) -> None:
        pass


def scenes(cues: DataFrame, doc: str, ts: str, delay: str, gap: float = SCENE_GAP) -> DataFrame:
    """(doc, cue, scene) of a stream of cues (doc, cue, ts, start_s, end_s), as operators.chunking.scenes gives them in the order of ts and cue.

    A cue goes out when the watermark, `delay` behind the latest ts, has passed it; cues that come later than that are dropped. The
    state of a document is the last cue's end and scene, and the cues that wait.
    """
    held = cues.withWatermark(ts, delay).select(F.col(doc), F.col("cue").cast("long").alias("cue"), F.col(ts), F.unix_millis(ts).alias("at_ms"), F.col("start_s").cast("double").alias("start_s"), F.col("end_s").cast("double").alias("end_s"))
    kind = held.schema[doc].dataType.simpleString()
    return held.groupBy(doc).transformWithStateInPandas(statefulProcessor=_Scenes(gap, doc), outputStructType=f"{doc} {kind}, cue long, scene int", outputMode="Append", timeMode="EventTime")
