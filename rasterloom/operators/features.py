"""Features burned into the tiles of a layer: labels from a table of geometries and values.

A feature's box names the keys that it may cover; each task scans the feature into its part of such a tile, and the parts of a tile
become one by their burn order. Orders are a total order over parts, so a tile that very many features cover is combined in
groups first (see :mod:`rasterloom.functions.mosaic`), and the result is the same whatever order they come in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.celltype import parse
from rasterloom.functions import mosaic
from rasterloom.functions.scan import covered
from rasterloom.geometry import UDF_BOX, from_wkb
from rasterloom.operators import layer
from rasterloom.operators.metadata import Extent
from rasterloom.tile import TILE_TYPE, build


def _keys_of(low: Column, high: Column, first: int, last: int) -> Column:
    """Whole numbers from one to another, within limits; none where they cross."""
    a, b = F.greatest(F.floor(low), F.lit(first)), F.least(F.floor(high), F.lit(last))
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def burned(df: DataFrame, features: DataFrame, geometry: str, value: str, order: str | None = None, cell_type: str = "uint8ud255", name: str = "label") -> DataFrame:
    """A layer's rows with a tile ``name``: each cell has the value of the feature that covers it, NoData where none does.

    ``features`` has geometries (WKB, in the layer's CRS), values and, named by ``order``, whole numbers: of several features the one
    of the highest order stays, of equal orders the greatest value. A polygon covers the cells whose middles it holds,
    border included; lines and points cover the cells that they pass. Features without geometry, value or order are left out.
    Keys are those within the metadata's bounds; rows of one key (of a space-time layer) get the same tile.
    """
    md, key = layer.tile_layer_metadata(layer.as_rf(df)), layer.spatial_key_column(df)
    layout, ct = md.layout, parse(cell_type)
    cols, rows, (w, h) = layout.tiles.tile_cols, layout.tiles.tile_rows, (layout.tile_width, layout.tile_height)
    when = features[order].cast("long") if order else F.lit(0).cast("long")
    own = features.select(features[geometry].alias("g"), features[value].cast("double").alias("v"), when.alias("o"), UDF_BOX(features[geometry]).alias("b")).where("b is not null and v is not null and o is not null and not isnan(v)")
    at_cols = _keys_of((F.col("b.minX") - F.lit(layout.extent.xmin)) / F.lit(w), (F.col("b.maxX") - F.lit(layout.extent.xmin)) / F.lit(w), md.bounds.col_min, md.bounds.col_max)
    at_rows = _keys_of((F.lit(layout.extent.ymax) - F.col("b.maxY")) / F.lit(h), (F.lit(layout.extent.ymax) - F.col("b.minY")) / F.lit(h), md.bounds.row_min, md.bounds.row_max)
    placed = own.withColumn("col", F.explode(at_cols)).withColumn("row", F.explode(at_rows)).select("col", "row", "g", "v", "o", "b")

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, places, times, cells = [], [], [], []
            for i, (c, r, g, v, o, box) in enumerate(zip(*(x.to_pylist() for x in b.columns))):
                e = layout.key_extent(c, r)
                sx, sy = e.width / cols, e.height / rows
                c0, c1 = (int(np.clip(np.floor((x - e.xmin) / sx) + d, 0, cols)) for x, d in ((box["minX"], -1), (box["maxX"], 2)))
                r0, r1 = (int(np.clip(np.floor((e.ymax - y) / sy) + d, 0, rows)) for y, d in ((box["maxY"], -1), (box["minY"], 2)))
                if c0 >= c1 or r0 >= r1:
                    continue
                mask = covered(from_wkb(g), Extent(e.xmin + c0 * sx, e.ymax - r1 * sy, e.xmin + c1 * sx, e.ymax - r0 * sy), c1 - c0, r1 - r0)
                if mask.any():
                    found.append(i)
                    places.append((c0, r0, c1 - c0, r1 - r0))
                    times.append(o)
                    cells.append([np.where(mask, v, np.nan).tobytes()])
            some = pa.array(found, pa.int64())
            yield mosaic.part_batch({"col": b.column(0).take(some), "row": b.column(1).take(some)}, places, times, cells)

    parts = placed.mapInArrow(scanned, f"col long, row long, {mosaic.PART}")

    @F.arrow_udf(TILE_TYPE)
    def tiled(whole: pa.Array) -> pa.Array:
        x = np.stack([np.frombuffer(c.values[0].as_buffer(), np.float64) for c in whole]) if len(whole) else np.empty((0, cols * rows))
        return build(len(whole), [(np.arange(len(whole)), ct, cols, rows, ct.from_doubles(x))]) if len(whole) else pa.array([], whole.type)

    none = layer.Tile(ct, ct.from_doubles(np.full((rows, cols), np.nan))).row()
    empty = F.struct(*[F.lit(bytearray(x) if isinstance(x, bytes) else x).cast(f.dataType).alias(f.name) for x, f in zip(none, TILE_TYPE)])
    made = mosaic.merged(parts, ["col", "row"], 1, cols, rows).select(F.col("col").alias("_burned_col"), F.col("row").alias("_burned_row"), tiled("cells").alias("_burned"))
    joined = df.join(made, (F.col(f"{key}.col") == F.col("_burned_col")) & (F.col(f"{key}.row") == F.col("_burned_row")), "left")
    return joined.withColumn(name, F.coalesce(F.col("_burned"), empty)).drop("_burned", "_burned_col", "_burned_row")
