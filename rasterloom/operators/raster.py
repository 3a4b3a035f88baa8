"""Rasters from layers: resampling, assembly on the driver, subdivision of tiles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.celltype import CellType, union
from rasterloom.celltype import parse as parse_cell_type
from rasterloom.functions import mosaic
from rasterloom.operators import layer
from rasterloom.operators.metadata import Extent, Layout
from rasterloom.operators.resampling import BILINEAR, NEAREST, resample, sample  # noqa: F401
from rasterloom.tile import TILE_TYPE, Group, Tile, build, groups

@dataclass(frozen=True)
class Raster:
    """Bands on the driver, with their extent and CRS."""

    tiles: list[Tile]
    extent: Extent
    crs: str


@dataclass(frozen=True)
class Window:
    """Where a tile lies in a raster: first column and row, columns, rows."""

    col: int
    row: int
    cols: int
    rows: int


def resampled(b: pa.RecordBatch, bands: int, layout: Layout, extent: Extent, cols: int, rows: int, method: str) -> Iterator[tuple[int, Window, list[tuple[CellType, np.ndarray] | None]]]:
    """Row number, window in a raster of ``cols`` by ``rows`` over ``extent``, and cells of each band (doubles, with their type) there.

    The batch has the spatial key and the tile columns; rows whose tiles cover no cell's middle are left out.
    """
    sx, sy = extent.width / cols, extent.height / rows
    found: dict[int, tuple[Window, Extent]] = {}
    for i, k in enumerate(b.column(0).to_pylist()):
        e = layout.key_extent(k["col"], k["row"])
        c0, c1 = max(0, int(np.ceil((e.xmin - extent.xmin) / sx - 0.5 - 1e-9))), min(cols, int(np.ceil((e.xmax - extent.xmin) / sx - 0.5 - 1e-9)))
        r0, r1 = max(0, int(np.ceil((extent.ymax - e.ymax) / sy - 0.5 - 1e-9))), min(rows, int(np.ceil((extent.ymax - e.ymin) / sy - 0.5 - 1e-9)))
        if c0 < c1 and r0 < r1:
            found[i] = Window(c0, r0, c1 - c0, r1 - r0), e
    values: dict[int, list] = {i: [None] * bands for i in found}
    for n in range(bands):
        for g in groups(b.column(n + 1)):
            for i, x in zip(g.at.tolist(), g.doubles()):
                if i in found:
                    at, e = found[i]
                    px = (extent.xmin + (at.col + np.arange(at.cols) + 0.5) * sx - e.xmin) / e.width * g.cols
                    py = (e.ymax - (extent.ymax - (at.row + np.arange(at.rows) + 0.5) * sy)) / e.height * g.rows
                    v = sample(x.reshape(g.rows, g.cols), *np.meshgrid(np.clip(px + 1e-9, 0, g.cols - 1e-9), np.clip(py + 1e-9, 0, g.rows - 1e-9)), method)
                    values[i][n] = g.cell_type, v
    for i, (at, _) in found.items():
        yield i, at, values[i]


def to_multiband_raster(df: DataFrame, tiles: list[str], cols: int, rows: int, method: str = NEAREST) -> Raster:
    """One raster of the layer's clipped extent.

    Each task resamples its tiles to the windows that they cover in the result, so only the result's cells reach the driver. Of
    tiles for the same place (temporal layers) each cell is the latest one's with data, of equal times the greatest value.
    """
    df = layer.clip_layer_extent(layer.as_rf(df))
    md, key, time = layer.tile_layer_metadata(df), layer.spatial_key_column(df), layer.temporal_key_column(df)
    extent, layout, n = md.extent, md.layout, len(tiles)
    names = ["_c", "_r", "_w", "_h", "_i", *(f"_t{k}" for k in range(n)), *(f"_v{k}" for k in range(n))]
    schema = T.StructType([T.StructField(x, T.LongType() if x == "_i" else T.StringType() if x[1] == "t" else T.BinaryType() if x[1] == "v" else T.IntegerType()) for x in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for i, at, own in resampled(b, n, layout, extent, cols, rows, method):
                packed = [(None, None) if v is None else (v[0].name, v[0].from_doubles(v[1]).astype(v[0].stored).tobytes()) for v in own]
                out.append((at.col, at.row, at.cols, at.rows, b.column(n + 1)[i].as_py(), *(p[0] for p in packed), *(p[1] for p in packed)))
            kinds = [pa.int64() if x == "_i" else pa.string() if x[1] == "t" else pa.binary() if x[1] == "v" else pa.int32() for x in names]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names)

    instant = F.col(time)["instant"] if time else F.lit(mosaic.NO_TIME)
    found = df.select(F.col(key).alias("_key"), *tiles, F.coalesce(instant, F.lit(mosaic.NO_TIME)).alias("_instant")).mapInArrow(run, schema).toLocalIterator(prefetchPartitions=True)
    out = mosaic.Mosaic(n, cols, rows)
    kinds: list[CellType | None] = [None] * n
    for row in found:
        for k in range(n):
            if row[f"_t{k}"] is not None:
                ct = parse_cell_type(row[f"_t{k}"])
                kinds[k] = ct if kinds[k] is None else union(kinds[k], ct)
                out.add(k, row["_c"], row["_r"], ct.doubles(np.frombuffer(row[f"_v{k}"], ct.stored).astype(ct.native).reshape(row["_h"], row["_w"])), row["_i"])
    own = parse_cell_type(md.cell_type)
    return Raster([Tile(k or own, (k or own).from_doubles(v)) for k, v in zip(kinds, out.values)], extent, md.crs)


def to_raster(df: DataFrame, tile: str, cols: int, rows: int, method: str = NEAREST) -> Raster:
    return to_multiband_raster(df, [tile], cols, rows, method)


def subdivide_cells(g: Group, n: int) -> np.ndarray:
    """(tiles, n * n, cells) of parts, row by row."""
    h, w = g.rows // n, g.cols // n
    x = g.cells.reshape(len(g.cells), n, h, n, w).transpose(0, 1, 3, 2, 4)
    return x.reshape(len(g.cells), n * n, h * w)


def subdivide_tile(t: Tile, n: int) -> list[Tile]:
    if t.cols % n or t.rows % n:
        raise ValueError(f"{n} does not divide a tile of {t.cols} x {t.rows}")
    parts = subdivide_cells(Group(np.array([0]), t.cell_type, t.cols, t.rows, t.cells.reshape(1, -1)), n)[0]
    return [Tile(t.cell_type, p.reshape(t.rows // n, t.cols // n)) for p in parts]


def with_tile_subdivisions(df: DataFrame, n: int) -> DataFrame:
    """n by n rows in place of each: tiles, keys and layout are cut; other columns repeat. No change for 0 and 1."""
    md, key = layer.tile_layer_metadata(df), layer.spatial_key_column(df)
    finer = md.subdivide(n)  # raises where n does not divide the tiles
    if n <= 1:
        return df

    @F.arrow_udf(T.ArrayType(TILE_TYPE))
    def cut(tiles: pa.Array) -> pa.Array:
        parts = []
        for g in groups(tiles):
            if g.cols % n or g.rows % n:
                raise ValueError(f"{n} does not divide tiles of {g.cols} x {g.rows}")
            x = subdivide_cells(g, n)
            at = (g.at[:, None] * n * n + np.arange(n * n)[None, :]).ravel()
            parts.append((at, g.cell_type, g.cols // n, g.rows // n, x.reshape(-1, x.shape[2])))
        flat = build(len(tiles) * n * n, parts)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(tiles) + 1, dtype=np.int32) * n * n), flat)

    names = layer.tile_columns(df)
    zipped = F.arrays_zip(*[cut(t).alias(t) for t in names])
    rest = [c for c in df.columns if c not in names and c not in (key, layer.BOUNDS, layer.SPATIAL_INDEX, "bbox")]
    rows = df.select(F.col(key).alias("_key"), *rest, F.posexplode(zipped).alias("_at", "_parts"))
    moved = F.struct((F.col("_key.col") * n + F.col("_at") % n).alias("col"), (F.col("_key.row") * n + F.expr(f"cast(_at div {n} as int)")).alias("row"))
    out = rows.select(moved.alias(key), *rest, *[F.col("_parts")[t].alias(t) for t in names])
    out = layer.set_spatial_role(out, key, finer)
    return layer.with_bounds(out) if layer.BOUNDS in df.columns else out


def regrid_metadata(md: layer.LayerMetadata, cell_type: str) -> layer.LayerMetadata:
    return replace(md, cell_type=cell_type)
