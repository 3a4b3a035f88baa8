"""Export of layers as web map tiles: PNG or GeoTIFF files in ``{z}/{x}/{y}`` folders, for all zooms.

Each tile of the layer is warped to its part of those web tiles of the finest zoom that it meets, parts are merged by key and by a total
order, and each coarser zoom halves and merges the one below. Files are written by the tasks, by path or URI; the target has
to be a folder that all of them reach.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import crs as projections
from rasterloom.functions import mosaic
from rasterloom.functions.aggregate import agg_stats
from rasterloom.operators import layer
from rasterloom.operators.metadata import Extent
from rasterloom.operators.raster import BILINEAR, sample
from rasterloom.render import png, ramp_png
from rasterloom.runtime import staged
from rasterloom.sources import storage
from rasterloom.sources.tiff import encode
from rasterloom.celltype import parse
from rasterloom.tile import groups

SIZE = 256


def web_extent(z: int, x: int, y: int) -> Extent:
    w = 2 * projections.WORLD / (1 << z)
    return Extent(-projections.WORLD + x * w, projections.WORLD - (y + 1) * w, -projections.WORLD + (x + 1) * w, projections.WORLD - y * w)


def _mercator_box(e: Extent, crs: str) -> Extent:
    """Box of an extent's outline in web Mercator."""
    t = np.linspace(0, 1, 17)
    xs = np.concatenate([e.xmin + t * e.width, e.xmin + t * e.width, np.full(17, e.xmin), np.full(17, e.xmax)])
    ys = np.concatenate([np.full(17, e.ymin), np.full(17, e.ymax), e.ymin + t * e.height, e.ymin + t * e.height])
    lon, lat = projections.unproject(crs, xs, ys)
    x, y = projections.project(projections.WEB_MERCATOR, lon, np.clip(lat, -85.06, 85.06))
    return Extent(float(x.min()), float(y.min()), float(x.max()), float(y.max()))


def finest_zoom(df: DataFrame) -> int:
    """The zoom whose cells are nearest to the layer's, at the middle of the layer."""
    md = layer.tile_layer_metadata(df)
    cx, cy = md.extent.center
    w, h = md.layout.tile_width / md.layout.tiles.tile_cols, md.layout.tile_height / md.layout.tiles.tile_rows
    e = _mercator_box(Extent(cx, cy, cx + w, cy + h), md.crs)
    cell = max(e.width, 1e-9)
    return int(np.clip(round(math.log2(2 * projections.WORLD / SIZE / cell)), 0, 22))


def web_tiles(df: DataFrame, zoom: int | None = None) -> DataFrame:
    """``z, x, y, bands`` (array of float64 cells, NaN: NoData) of the layer at one zoom.

    Where tiles overlap (on borders, or in time) each cell is the latest one's with data, of equal times the greatest value.
    """
    df = layer.as_rf(df)
    time = layer.temporal_key_column(df)
    md, key, names = layer.tile_layer_metadata(df), layer.spatial_key_column(df), layer.tile_columns(df)
    z = finest_zoom(df) if zoom is None else zoom
    n = 1 << z
    w = 2 * projections.WORLD / n

    def warp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, times = b.column(0).to_pylist(), b.column(len(names) + 1).to_pylist()
            cells: list[dict[int, np.ndarray]] = [{} for _ in names]
            for k in range(len(names)):
                for g in groups(b.column(k + 1)):
                    for i, v in zip(g.at.tolist(), g.doubles()):
                        cells[k][i] = v.reshape(g.rows, g.cols)
            for i, at in enumerate(keys):
                own = [c.get(i) for c in cells]
                if all(c is None for c in own):
                    continue
                e = md.layout.key_extent(at["col"], at["row"])
                m = _mercator_box(e, md.crs)
                xs, ys, places, out = [], [], [], []
                for x in range(max(0, int((m.xmin + projections.WORLD) // w)), min(n - 1, int((m.xmax + projections.WORLD) // w)) + 1):
                    for y in range(max(0, int((projections.WORLD - m.ymax) // w)), min(n - 1, int((projections.WORLD - m.ymin) // w)) + 1):
                        t = web_extent(z, x, y)
                        # only the part of the web tile that the layer's tile can reach
                        c0, c1 = (int(np.clip(np.floor((v - t.xmin) / t.width * SIZE) + d, 0, SIZE)) for v, d in ((m.xmin, -1), (m.xmax, 2)))
                        r0, r1 = (int(np.clip(np.floor((t.ymax - v) / t.height * SIZE) + d, 0, SIZE)) for v, d in ((m.ymax, -1), (m.ymin, 2)))
                        if c0 >= c1 or r0 >= r1:
                            continue
                        gx, gy = np.meshgrid(t.xmin + (np.arange(c0, c1) + 0.5) * t.width / SIZE, t.ymax - (np.arange(r0, r1) + 0.5) * t.height / SIZE)
                        px, py = projections.transform(projections.WEB_MERCATOR, md.crs, gx, gy)
                        bands = []
                        for c in own:
                            bands.append(None if c is None else sample(c, (px - e.xmin) / e.width * c.shape[1], (e.ymax - py) / e.height * c.shape[0], BILINEAR))
                        if any(v is not None and not np.isnan(v).all() for v in bands):
                            xs.append(x)
                            ys.append(y)
                            places.append((c0, r0, c1 - c0, r1 - r0))
                            out.append([None if v is None else v.tobytes() for v in bands])
                if xs:
                    zxy = {"z": pa.array([z] * len(xs), pa.int32()), "x": pa.array(xs, pa.int32()), "y": pa.array(ys, pa.int32())}
                    yield mosaic.part_batch(zxy, places, [times[i]] * len(xs), out)

    instant = F.coalesce(F.col(time)["instant"], F.lit(mosaic.NO_TIME)) if time else F.lit(mosaic.NO_TIME)
    parts = df.select(key, *names, instant.alias("_instant")).mapInArrow(warp, f"z int, x int, y int, {mosaic.PART}")
    return _bands(parts, len(names))


def _bands(parts: DataFrame, bands: int) -> DataFrame:
    return mosaic.merged(parts, ["z", "x", "y"], bands, SIZE, SIZE).withColumnRenamed("cells", "bands")


def coarser(tiles: DataFrame, bands: int) -> DataFrame:
    """Web tiles of the next zoom: each quarter is the mean of two by two cells, NoData left out."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            xs, ys = b.column(1).to_pylist(), b.column(2).to_pylist()
            out, places = [], []
            for x, y, row in zip(xs, ys, b.column(3).to_pylist()):
                made = []
                for raw in row:
                    v = np.frombuffer(raw, np.float64).reshape(SIZE // 2, 2, SIZE // 2, 2)
                    n = (~np.isnan(v)).sum(axis=(1, 3))
                    with np.errstate(all="ignore"):
                        half = np.where(n > 0, np.nansum(v, axis=(1, 3)) / n, np.nan)
                    made.append(half.tobytes())
                out.append(made)
                places.append((x % 2 * SIZE // 2, y % 2 * SIZE // 2, SIZE // 2, SIZE // 2))
            zxy = {"z": pa.array([v - 1 for v in b.column(0).to_pylist()], pa.int32()), "x": pa.array([x // 2 for x in xs], pa.int32()), "y": pa.array([y // 2 for y in ys], pa.int32())}
            yield mosaic.part_batch(zxy, places, [mosaic.NO_TIME] * len(xs), out)

    return _bands(tiles.mapInArrow(shrink, f"z int, x int, y int, {mosaic.PART}"), bands)


def pyramid(df: DataFrame, zoom: int | None = None) -> DataFrame:
    """Web tiles of all zooms from the finest to 0."""
    bands = len(layer.tile_columns(df))
    level = staged(web_tiles(df, zoom))
    z = finest_zoom(df) if zoom is None else zoom
    out = level
    for _ in range(z):
        level = staged(coarser(level, bands))
        out = out.union(level)
    return out


PAGE = """<!DOCTYPE html>
<html><head><meta charset="utf-8"><title>Layer</title>
<style>body {{ margin: 0; font-family: sans-serif }} #map {{ position: relative; width: 768px; height: 768px; overflow: hidden; background: #ddd }} #map img {{ position: absolute; width: 256px; height: 256px }}</style></head>
<body><p>Zoom <input id="z" type="number" min="0" max="{zoom}" value="{zoom}"> centre {lat:.5f}, {lon:.5f}</p><div id="map"></div>
<script>
const lat = {lat}, lon = {lon};
function draw() {{
  const z = +document.getElementById("z").value, n = 2 ** z, map = document.getElementById("map");
  const cx = Math.floor((lon + 180) / 360 * n), s = Math.sin(lat * Math.PI / 180);
  const cy = Math.floor((0.5 - Math.log((1 + s) / (1 - s)) / (4 * Math.PI)) * n);
  map.innerHTML = "";
  for (let i = -1; i < 2; i++) for (let j = -1; j < 2; j++) {{
    const img = new Image();
    img.src = `${{z}}/${{cx + i}}/${{cy + j}}.png`;
    img.style.left = (i + 1) * 256 + "px"; img.style.top = (j + 1) * 256 + "px";
    img.onerror = () => img.remove();
    map.appendChild(img);
  }}
}}
document.getElementById("z").onchange = draw; draw();
</script></body></html>
"""


def _write(tiles: DataFrame, to: str, suffix: str, render) -> None:
    def run(rows: Iterator) -> None:
        for r in rows:
            bands = [np.frombuffer(b, np.float64).reshape(SIZE, SIZE) for b in r["bands"]]
            storage.write(f"{to.rstrip('/')}/{r['z']}/{r['x']}/{r['y']}.{suffix}", render(bands, r["z"], r["x"], r["y"]))

    tiles.foreachPartition(run)


def export_png(df: DataFrame, to: str, zoom: int | None = None) -> int:
    """Write PNG files and a page that shows them; three or more bands as colours, else the first on a ramp. The finest zoom is returned."""
    names = layer.tile_columns(layer.as_rf(df))
    z = finest_zoom(df) if zoom is None else zoom
    stats = df.agg(*[agg_stats(n).alias(n) for n in names[:3]]).first()
    ranges = [(stats[n]["min"] or 0.0, stats[n]["max"] or 1.0) for n in names[:3]]

    def render(bands: list[np.ndarray], *_) -> bytes:
        if len(bands) < 3:
            return ramp_png(bands[0], *ranges[0])
        scaled = [np.clip((b - low) / (high - low or 1) * 255, 0, 255) for b, (low, high) in zip(bands, ranges)]
        missing = np.any([np.isnan(b) for b in scaled], axis=0)
        return png(np.dstack([*[np.nan_to_num(b) for b in scaled], np.where(missing, 0, 255)]))

    _write(pyramid(df, z), to, "png", render)
    md = layer.tile_layer_metadata(df)
    lon, lat = projections.unproject(md.crs, *[np.array([v]) for v in md.extent.center])
    storage.write(f"{to.rstrip('/')}/index.html", PAGE.format(zoom=z, lat=float(lat[0]), lon=float(lon[0])).encode())
    return z


def export_geotiff(df: DataFrame, to: str, zoom: int | None = None) -> int:
    """Write the finest web tiles as GeoTIFF files, the first three bands if there are as many, else the first."""
    z = finest_zoom(df) if zoom is None else zoom

    def render(bands: list[np.ndarray], z: int, x: int, y: int) -> bytes:
        return encode(np.stack(bands[:3] if len(bands) >= 3 else bands[:1]), parse("float64"), web_extent(z, x, y), projections.WEB_MERCATOR)

    _write(web_tiles(df, z), to, "tiff", render)
    return z
