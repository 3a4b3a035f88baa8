"""Mosaics: parts that cover the same window become one, the same whatever order they come in.

Each cell of each band keeps the value of the latest part that has data there; of parts of one time the greatest value. That is a
maximum over a total order, so parts may be combined in any grouping and a part that comes twice changes nothing. Parts of a window
meet in ``FAN`` salted groups first, each of which is combined as it streams in, and then at most ``FAN`` states of a window
meet, so a window that very many parts cover is not one task's work.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Groups in which the parts of a window meet first.
FAN = 32

#: What stands for no time, in parts of layers without one.
NO_TIME = -(1 << 63)

#: Columns of a part besides its keys: place and size within its window, cells (doubles of each band, null: none), and times: one
#: of all cells, or those of each cell.
PART = "_x int, _y int, _w int, _h int, _time bigint, _cells array<binary>, _times array<binary>"
ARROW_PART = pa.schema([*((n, pa.int32()) for n in ("_x", "_y", "_w", "_h")), ("_time", pa.int64()), ("_cells", pa.list_(pa.binary())), ("_times", pa.list_(pa.binary()))])


class Mosaic:
    """One window: values and times of each band's cells."""

    def __init__(self, bands: int, cols: int, rows: int) -> None:
        self.values = np.full((bands, rows, cols), np.nan)
        self.times = np.full((bands, rows, cols), NO_TIME)

    def add(self, band: int, x: int, y: int, cells: np.ndarray, times: np.ndarray | int) -> None:
        """A part from (x, y) on; NaN is NoData."""
        h, w = cells.shape
        v, t = self.values[band, y : y + h, x : x + w], self.times[band, y : y + h, x : x + w]
        wins = ~np.isnan(cells) & (np.isnan(v) | (times > t) | ((times == t) & (cells > v)))
        v[wins] = cells[wins]
        t[wins] = times[wins] if isinstance(times, np.ndarray) else times


def merged(parts: DataFrame, keys: list[str], bands: int, cols: int, rows: int) -> DataFrame:
    """``keys`` and ``cells`` (whole windows of doubles, one binary for each band) of parts with columns ``keys`` and ``PART``."""
    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    nk = len(keys)

    def combined(batches: Iterator[pa.RecordBatch]) -> tuple[list[pa.Array], Mosaic]:
        m, key = Mosaic(bands, cols, rows), []
        for b in batches:
            if b.num_rows and not key:
                key = [b.column(k).slice(0, 1) for k in range(nk)]
            x, y, w, h, time, cells, times = (b.column(b.schema.get_field_index(n)) for n in ARROW_PART.names)
            for i in range(b.num_rows):
                at = x[i].as_py(), y[i].as_py()
                shape = h[i].as_py(), w[i].as_py()
                own = times[i].values if times[i].is_valid else None
                for band, raw in enumerate(cells[i].values):
                    if raw.is_valid:
                        when = np.frombuffer(own[band].as_buffer(), np.int64).reshape(shape) if own is not None else time[i].as_py()
                        m.add(band, *at, np.frombuffer(raw.as_buffer(), np.float64).reshape(shape), when)
        return key, m

    def state(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = combined(batches)
        if key:
            columns = [pa.array([v], f.type) for v, f in zip((0, 0, cols, rows, NO_TIME, [v.tobytes() for v in m.values], [t.tobytes() for t in m.times]), ARROW_PART)]
            yield pa.RecordBatch.from_arrays([*key, *columns], [*keys, *ARROW_PART.names])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, m = combined(batches)
        if key:
            yield pa.RecordBatch.from_arrays([*key, pa.array([[v.tobytes() for v in m.values]], pa.list_(pa.binary()))], [*keys, "cells"])

    for f in (state, whole):
        f.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    salted = parts.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    some = salted.groupBy(*keys, "_salt").applyInArrow(state, f"{kinds}, {PART}")
    return some.groupBy(*keys).applyInArrow(whole, f"{kinds}, cells array<binary>")


def part_batch(keys: dict[str, pa.Array], places: list[tuple[int, int, int, int]], times: list[int], cells: list[list[bytes | None]]) -> pa.RecordBatch:
    """Parts as rows."""
    columns = [pa.array([p[k] for p in places], pa.int32()) for k in range(4)]
    columns += [pa.array(times, pa.int64()), pa.array(cells, pa.list_(pa.binary())), pa.nulls(len(places), pa.list_(pa.binary()))]
    return pa.RecordBatch.from_arrays([*keys.values(), *columns], [*keys, *ARROW_PART.names])
