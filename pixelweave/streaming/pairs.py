"""Pairing of tiles whose two dates arrive apart."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PAIRED = "scene string, tile string, before binary, after binary, state string"


class Pairing(StatefulProcessor):
    """Holds a tile until its other date comes, or until `wait_ms` after its time has passed by the watermark."""

    def __init__(self, wait_ms: int):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", "side string, content binary, at long")
        self.done = handle.getValueState("done", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        taken = [x for frame in rows for x in frame[["side", "content", "at"]].itertuples(index=False)]
        for side, content, at in sorted(taken, key=lambda x: (x[2], x[0], bytes(x[1]))):
            if self.done.exists():
                continue  # the tile has been given out: this is a date that comes twice
            if not self.held.exists():
                self.held.update((side, bytes(content), int(at)))
                self.handle.registerTimer(int(at) + self.wait_ms)
                continue
            other, before, first = self.held.get()
            if other == side:
                continue  # the first of a date counts
            both = {other: before, side: content}
            self.held.clear()
            self.done.update((int(at),))
            # the timer stays, and ends the memory of the tile
            yield pd.DataFrame([{"scene": key[0], "tile": key[1], "before": bytes(both["before"]), "after": bytes(both["after"]), "state": "paired"}])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.held.exists():
            side, content, _ = self.held.get()
            self.held.clear()
            yield pd.DataFrame([{"scene": key[0], "tile": key[1], "before": bytes(content) if side == "before" else None, "after": bytes(content) if side == "after" else None, "state": f"no {'after' if side == 'before' else 'before'}"}])
        self.done.clear()

    def close(self) -> None:
        pass


def pair_dates(arriving: DataFrame, wait_seconds: int, late: str = "10 minutes", time: str = "arrived") -> DataFrame:
    """(scene, tile, before, after, state) from a stream of (scene, tile, side, content, arrived).

    side is before or after; rows of another side are left out. A tile is given out as
    "paired" once both dates are there, or as "no after" or "no before" when the
    watermark is wait_seconds over its own time. The first row of a date counts, by its
    time; a date that comes again while the tile is remembered changes nothing. Rows that
    are later than the watermark allows are dropped. State is one row a tile that waits,
    in the state store, so a query that is started again goes on.
    """
    timed = arriving.filter(F.col("side").isin("before", "after")).withWatermark(time, late)
    rows = timed.select(F.col("scene").cast("string").alias("scene"), F.col("tile").cast("string").alias("tile"), "side", F.coalesce("content", F.lit(b"")).alias("content"), F.unix_millis(time).alias("at"), time)
    return rows.groupBy("scene", "tile").transformWithStateInPandas(Pairing(wait_seconds * 1000), PAIRED, "Append", "EventTime")
