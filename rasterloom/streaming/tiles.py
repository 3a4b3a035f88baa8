"""Tiles on streams: tile functions are stateless and work there as they are; this adds windowed statistics and running tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rasterloom.celltype import parse
from rasterloom.functions import local_aggregate
from rasterloom.functions.aggregate import agg_stats
from rasterloom.functions.local_aggregate import Running


def windowed_stats(stream: DataFrame, time: str, tile: str, keys: list[str], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Statistics of the tiles of each key and time window, with a watermark; state is five numbers a group, never a tile."""
    grouped = stream.withWatermark(time, late).groupBy(F.window(time, window), *keys)
    return grouped.agg(agg_stats(tile).alias("stats"))


_SUMS = T.StructType([T.StructField("cols", T.IntegerType()), T.StructField("rows", T.IntegerType()), T.StructField("type", T.StringType()), T.StructField("version", T.LongType()), T.StructField("values", T.BinaryType())])


class RunningSums(StatefulProcessor):
    """State of one block of cells of one key: the sums of all tiles so far; gone after ``idle`` milliseconds without a tile."""

    def __init__(self, keys: list[str], idle: int | None) -> None:
        self.keys, self.idle = keys, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.sums = handle, handle.getValueState("sums", _SUMS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = self.sums.get()
        whole = None if known is None else _running(*known[:3], known[4])
        for part in rows:
            # by position, as names that start with an underscore do not come through
            cols_, rows_, kinds, values_ = (part.iloc[:, len(self.keys) + k] for k in (0, 1, 2, 5))
            for cols, height, kind, values in zip(cols_, rows_, kinds, values_):
                if values is None:  # a key without a tile
                    continue
                one = _running(int(cols), int(height), kind, values)
                if whole is None:
                    whole = one
                else:
                    whole.merge(one)
        if whole is None:
            return
        version, values = (0 if known is None else known[3]) + 1, whole.values.tobytes()
        self.sums.update((whole.cols, whole.rows, whole.cell_type.name, version, values))
        if self.idle is not None:
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "_block": [key[-1]], "_cols": [whole.cols], "_rows": [whole.rows], "_type": [whole.cell_type.name], "_part": [0], "_values": [values], "version": [version]})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.sums.clear()
        yield from ()

    def close(self) -> None:
        pass


def _running(cols: int, rows: int, kind: str, values: bytes) -> Running:
    return Running(cols, rows, parse(kind), np.frombuffer(values, np.float64).reshape(6, -1).copy())


def running_states(stream: DataFrame, keys: list[str], tile: str, idle: int | None = None) -> DataFrame:
    """Cell-wise sums of all tiles of each key so far, in blocks of cells: a row for each block that a batch changes, with its ``version``.

    The tiles of a batch are folded in each task first, so state gets one row for each task, key and block, and the state of a key is
    spread over as many entries as its tiles have blocks. With ``idle``, a key that gets no tile for so many milliseconds starts
    anew (and Spark keeps running batches, so such a stream is stopped, not ended by a trigger of what is available). For update mode and the RocksDB state store; :func:`running_tiles` makes tiles of what has been written.
    """
    states = local_aggregate.partial_states(stream, keys, tile)
    out = T.StructType([*(stream.schema[k] for k in keys), *(T.StructField(n, k) for n, k in (("_block", T.IntegerType()), ("_cols", T.ShortType()), ("_rows", T.ShortType()), ("_type", T.StringType()), ("_part", T.IntegerType()), ("_values", T.BinaryType()), ("version", T.LongType())))])
    return states.groupBy(*keys, "_block").transformWithStateInPandas(RunningSums(keys, idle), out, "Update", "None" if idle is None else "ProcessingTime")


def running_tiles(written: DataFrame, keys: list[str], results: dict[str, str]) -> DataFrame:
    """``keys`` and the tiles of ``results`` (see ``local_agg_by``) from the rows that :func:`running_states` wrote: the latest version of each block."""
    rest = [c for c in written.columns if c not in (*keys, "_block", "version")]
    latest = written.groupBy(*keys, "_block").agg(F.max_by(F.struct(*rest), "version").alias("_latest"))
    return local_aggregate.tiles_of_states(latest.select(*keys, "_block", "_latest.*"), keys, results)
