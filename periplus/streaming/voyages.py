"""Voyage segmentation over a stream: one state per vessel, the same machine as the batch form."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from periplus.operators.materialize import importable
from periplus.operators.voyages import GAP_SECONDS, MIN_POSITIONS

OUTPUT = "mmsi long, voyage_id string, itinerary string, row_id long, seconds long, lon double, lat double, cog double, speed double"
_OPEN = "row_id long, seconds long, lon double, lat double, cog double, speed double"


def advance(state: tuple[int, int, int | None], row: tuple[int, int | None], gap: int = GAP_SECONDS) -> tuple[tuple[int, int, int | None], bool, tuple[int, int] | None, bool]:
    """One step: (last port, voyage number, last time) and (seconds, port).

    Returns the new state, whether the open voyage ends before the row, the (from, to) that end with it, and
    whether the row belongs to the voyage that ends.
    """
    last, seq, before = state
    seconds, port = row
    if port is not None and port != last:
        return (port, seq + 1, seconds), True, (last, port), True
    if before is not None and seconds - before >= gap:
        return (-1, seq + 1, seconds), True, None, False
    return (last, seq, seconds), False, None, False


class Voyages(StatefulProcessor):
    """Emits the positions at sea of each voyage when it is closed by an arrival from a known port."""

    def __init__(self, gap: int = GAP_SECONDS, min_positions: int = MIN_POSITIONS, idle: int | None = None):
        self.gap, self.min_positions, self.idle = gap, min_positions, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "last int, seq int, seconds long")
        self.open = handle.getListState("open", _OPEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        data = pd.concat(list(rows)).sort_values(["seconds", "row_id"])
        last, seq, before = self.at.get() if self.at.exists() else (-1, 0, None)
        held = [tuple(x) for x in self.open.get()]
        out = []
        for r in data.itertuples(index=False):
            port = None if pd.isna(r.port) else int(r.port)
            number = seq
            (last, seq, before), ends, pair, _ = advance((last, seq, before), (int(r.seconds), port), self.gap)
            if ends:
                if pair and pair[0] >= 0 and len(held) >= self.min_positions:
                    name = f"{pair[0]}_to_{pair[1]}"
                    out += [(key[0], f"{key[0]}-{number}", name, *h) for h in held]
                held = []
            if port is None:
                held.append((int(r.row_id), int(r.seconds), r.lon, r.lat, r.cog, r.speed))
        self.at.update((last, seq, before))
        self.open.put(held) if held else self.open.clear()
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            if held:
                self.handle.registerTimer((before + self.idle) * 1000)
        if out:
            yield pd.DataFrame(out, columns=["mmsi", "voyage_id", "itinerary", "row_id", "seconds", "lon", "lat", "cog", "speed"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Flush: the open voyage of a vessel that has been silent for ``idle`` has no itinerary and goes."""
        self.open.clear()
        return iter([])

    def close(self) -> None:
        pass


def segment(stream: DataFrame, gap: int = GAP_SECONDS, min_positions: int = MIN_POSITIONS, late: str = "1 hour", idle: int | None = None) -> DataFrame:
    """Closed voyages of a stream of reports (``mmsi, row_id, seconds, lon, lat, cog, speed, port``).

    Rows later than ``late`` behind the newest are dropped; inside a batch rows are put in order. State per
    vessel is its last port and the positions of the open voyage. With ``idle``, the open positions of a vessel
    silent for so many seconds of event time (behind the watermark) are flushed, so that vessels that never
    arrive hold no growing state; should it arrive after all, only later positions are its voyage.
    """
    importable(stream.sparkSession)
    timed = stream.withColumn("event_time", F.timestamp_seconds("seconds")).withWatermark("event_time", late)
    mode = "none" if idle is None else "eventTime"
    return timed.groupBy("mmsi").transformWithStateInPandas(Voyages(gap, min_positions, idle), outputStructType=OUTPUT, outputMode="append", timeMode=mode)
