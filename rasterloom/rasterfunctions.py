"""All column functions under their camel-case names, for code that is used to those."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rasterloom.functions import aggregate as _a
from rasterloom.functions import local_aggregate as _l
from rasterloom.functions import scalar as _s
from rasterloom.functions.explode import _zipped
from rasterloom.functions.scalar import ColumnOrName
from rasterloom.geometry import box2d as box2D  # noqa: F401

tileDimensions, cellType, cellTypes = _s.tile_dimensions, _s.cell_type, _s.cell_types
tileMean, tileSum, tileMin, tileMax, tileStats, tileHistogram = _s.tile_mean, _s.tile_sum, _s.tile_min, _s.tile_max, _s.tile_stats, _s.tile_histogram
dataCells, noDataCells = _s.data_cells, _s.no_data_cells
localAdd, localSubtract, localMultiply, localDivide, localAlgebra = _s.local_add, _s.local_subtract, _s.local_multiply, _s.local_divide, _s.local_algebra
normalizedDifference, convertCellType, withNoData = _s.normalized_difference, _s.convert_cell_type, _s.with_no_data
tileToArray, tileToIntArray, tileToDoubleArray, arrayToTile = _s.tile_to_array, _s.tile_to_int_array, _s.tile_to_double_array, _s.array_to_tile
makeConstantTile, renderAscii = _s.make_constant_tile, _s.render_ascii
aggStats, aggMean, aggDataCells, aggNoDataCells, aggHistogram, assembleTile = _a.agg_stats, _a.agg_mean, _a.agg_data_cells, _a.agg_no_data_cells, _a.agg_histogram, _a.assemble_tile
localAggStats, localAggMax, localAggMin, localAggMean = _l.local_agg_stats, _l.local_agg_max, _l.local_agg_min, _l.local_agg_mean
localAggDataCells, localAggNoDataCells, localAggCount = _l.local_agg_data_cells, _l.local_agg_no_data_cells, _l.local_agg_count


def _name(c: ColumnOrName) -> str:
    return c if isinstance(c, str) else repr(c).removeprefix("Column<'").removesuffix("'>")


def _cells(tiles: tuple[ColumnOrName, ...]) -> Column:
    names = [_name(t) for t in tiles]
    cells, width = _zipped([F.col(t) if isinstance(t, str) else t for t in tiles], names)
    return F.transform(cells, lambda x, i: F.struct((i % width).alias("column_index"), (i / width).cast("int").alias("row_index"), *[x[n].alias(n) for n in names]))


def explodeTiles(*tiles: ColumnOrName) -> Column:
    """A generator for ``select``: a row for each cell, with column_index, row_index and one double named after each tile."""
    return F.inline(_cells(tiles))


def explodeTileSample(fraction: float, *tiles: ColumnOrName, seed: int | None = None) -> Column:
    """As :func:`explodeTiles`, for a share of each row's cells, rounded up and drawn jointly."""
    cells = _cells(tiles)
    mixed = F.shuffle(cells) if seed is None else F.shuffle(cells, seed)
    return F.inline(F.slice(mixed, 1, F.ceil(F.size(cells) * F.lit(fraction)).cast("int")))
