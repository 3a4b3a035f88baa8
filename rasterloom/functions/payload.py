"""Tiles with a payload column: merge, prototype, crop and masks, and how payloads of each type are merged."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.celltype import CellType, parse, union
from rasterloom.functions.scan import covered
from rasterloom.functions.scalar import ColumnOrName, _alias, _col, _paired
from rasterloom.geometry import Geometry
from rasterloom.operators.metadata import Extent
from rasterloom.operators.resampling import sample
from rasterloom.tile import TILE_TYPE, Group, build, groups, map_tiles


def merge_data(a: Column, b: Column, kind: T.DataType) -> Column:
    """Payloads of two rows as one: texts joined by a comma (empty ones left out), arrays concatenated, maps united with values merged.

    A null payload leaves the other.
    """
    if isinstance(kind, T.StringType):
        both = F.concat_ws(", ", F.when(a != "", a), F.when(b != "", b))
    elif isinstance(kind, T.ArrayType):
        both = F.concat(a, b)
    elif isinstance(kind, T.MapType):
        both = F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge_data(x, y, kind.valueType)))
    elif isinstance(kind, T.StructType):
        both = F.struct(*[merge_data(a[f.name], b[f.name], f.dataType).alias(f.name) for f in kind])
    elif isinstance(kind, T.NumericType):
        both = a + b
    else:
        both = a
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def merge_sets(a: Column, b: Column) -> Column:
    """Arrays as sets: each element once."""
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(F.array_union(a, b))


def prototype_data(kind: T.DataType) -> Column:
    """The identity of a merge: an empty payload."""
    if isinstance(kind, T.StringType):
        return F.lit("")
    if isinstance(kind, T.ArrayType):
        return F.array().cast(kind)
    if isinstance(kind, T.MapType):
        return F.create_map().cast(kind)
    return F.lit(None).cast(kind)


@F.arrow_udf(TILE_TYPE)
def UDF_MERGE(l: pa.Array, r: pa.Array) -> pa.Array:
    def kernel(a: Group, b: Group) -> tuple[CellType, np.ndarray]:
        ct = union(a.cell_type, b.cell_type)
        x, y = a.doubles(), b.doubles()
        if a.cell_type.nodata is None and a.cell_type.family != "bool" and not a.cell_type.floating:
            x = np.where(x == 0, np.nan, x)  # without a NoData value zero is what a merge fills
            return ct, ct.from_doubles(np.where(np.isnan(x), np.where(np.isnan(y), 0, y), x))
        return ct, ct.from_doubles(np.where(np.isnan(x), y, x))

    return _paired(l, r, kernel)


def merge_tiles(left: ColumnOrName, right: ColumnOrName) -> Column:
    """The left cells, and the right ones where the left have no data."""
    return UDF_MERGE(_col(left), _col(right)).alias(_alias("merge", left, right))


def prototype_tile(cell_type: str, cols: int, rows: int) -> Column:
    """An empty tile: NoData, or zero in types without it."""
    from rasterloom.functions.scalar import make_constant_tile

    ct = parse(cell_type)
    return make_constant_tile(ct.from_doubles(np.array([np.nan]))[0].item() if ct.nodata is not None else 0, cols, rows, cell_type)


def crop_tile(tile: ColumnOrName, col_min: int, row_min: int, col_max: int, row_max: int) -> Column:
    """Cells of a window, both ends included, as far as the tile has them."""

    @F.arrow_udf(TILE_TYPE)
    def run(tiles: pa.Array) -> pa.Array:
        def kernel(g: Group) -> tuple[CellType, int, int, np.ndarray]:
            part = g.cells.reshape(-1, g.rows, g.cols)[:, max(0, row_min) : row_max + 1, max(0, col_min) : col_max + 1]
            return g.cell_type, part.shape[2], part.shape[1], part.reshape(len(part), -1)

        return map_tiles(tiles, kernel)

    return run(_col(tile)).alias(_alias("crop", tile))


def _mask(inverse: bool):
    def mask(tile: ColumnOrName, by: ColumnOrName, read_mask: float, write_mask: float) -> Column:
        @F.arrow_udf(TILE_TYPE)
        def run(l: pa.Array, r: pa.Array) -> pa.Array:
            def kernel(a: Group, b: Group) -> tuple[CellType, np.ndarray]:
                hit = b.doubles() == read_mask
                if inverse:
                    hit = ~hit
                return a.cell_type, a.cell_type.from_doubles(np.where(hit, write_mask, a.doubles()))

            return _paired(l, r, kernel)

        return run(_col(tile), _col(by)).alias(_alias("localInverseMask" if inverse else "localMask", tile, by))

    return mask


#: Where the second tile has the value ``read_mask`` (or has not), the first gets ``write_mask``; NaN writes NoData.
local_mask, local_inverse_mask = _mask(False), _mask(True)


def mask_by_geometry(tile: ColumnOrName, extent: Column, g: Geometry) -> Column:
    """Cells outside of a geometry become NoData; ``extent`` is a struct of xmin, ymin, xmax, ymax of each tile."""

    @F.arrow_udf(TILE_TYPE)
    def run(tiles: pa.Array, boxes: pa.Array) -> pa.Array:
        rows = boxes.to_pylist()

        def kernel(x: Group) -> tuple[CellType, int, int, np.ndarray]:
            inside = np.stack([covered(g, Extent(*(rows[i][k] for k in ("xmin", "ymin", "xmax", "ymax"))), x.cols, x.rows).ravel() for i in x.at.tolist()])
            return x.cell_type, x.cols, x.rows, x.cell_type.from_doubles(np.where(inside, x.doubles(), np.nan))

        return map_tiles(tiles, kernel)

    return run(_col(tile), extent).alias(_alias("mask", tile))


def _extents(boxes: pa.Array) -> list[Extent | None]:
    return [None if b is None else Extent(*(b[k] for k in ("xmin", "ymin", "xmax", "ymax"))) for b in boxes.to_pylist()]


def crop_by_extent(tile: ColumnOrName, extent: Column, to: Extent) -> Column:
    """Cells of a tile that an extent covers, whole cells outwards; null where they do not meet. ``extent`` is a struct of each tile's."""

    @F.arrow_udf(TILE_TYPE)
    def run(tiles: pa.Array, boxes: pa.Array) -> pa.Array:
        own, parts = _extents(boxes), []
        for g in groups(tiles):
            for k, i in enumerate(g.at.tolist()):
                e = own[i]
                part = e and e.intersection(to)
                if not part or part.width <= 0 or part.height <= 0:
                    continue
                w, h = e.width / g.cols, e.height / g.rows
                c0, c1 = int((part.xmin - e.xmin) / w + 1e-9), int(np.ceil((part.xmax - e.xmin) / w - 1e-9))
                r0, r1 = int((e.ymax - part.ymax) / h + 1e-9), int(np.ceil((e.ymax - part.ymin) / h - 1e-9))
                cells = g.cells[k].reshape(g.rows, g.cols)[r0:r1, c0:c1]
                parts.append((g.at[k : k + 1], g.cell_type, cells.shape[1], cells.shape[0], cells.reshape(1, -1)))
        return build(len(tiles), parts)

    return run(_col(tile), extent).alias(_alias("crop", tile))


def merge_by_extent(tile: ColumnOrName, extent: Column, other: ColumnOrName, other_extent: Column, method: str = "nearest") -> Column:
    """The tile's cells, and where they have no data the other tile's, resampled to the places that both cover."""

    @F.arrow_udf(TILE_TYPE)
    def run(left: pa.Array, boxes: pa.Array, right: pa.Array, other_boxes: pa.Array) -> pa.Array:
        mine, theirs, parts = _extents(boxes), _extents(other_boxes), []
        cells = {i: (h, h.doubles()[k].reshape(h.rows, h.cols)) for h in groups(right) for k, i in enumerate(h.at.tolist())}
        for g in groups(left):
            x = g.doubles()
            for k, i in enumerate(g.at.tolist()):
                v, ct = x[k].reshape(g.rows, g.cols), g.cell_type
                if i in cells and mine[i] and theirs[i]:
                    h, y = cells[i]
                    ct, e, o = union(g.cell_type, h.cell_type), mine[i], theirs[i]
                    px = (e.xmin + (np.arange(g.cols) + 0.5) * e.width / g.cols - o.xmin) / o.width * h.cols
                    py = (o.ymax - (e.ymax - (np.arange(g.rows) + 0.5) * e.height / g.rows)) / o.height * h.rows
                    v = np.where(np.isnan(v), sample(y, *np.meshgrid(px, py), method), v)
                parts.append((g.at[k : k + 1], ct, g.cols, g.rows, ct.from_doubles(v).reshape(1, -1)))
        return build(len(left), parts)

    return run(_col(tile), extent, _col(other), other_extent).alias(_alias("merge", tile, other))
