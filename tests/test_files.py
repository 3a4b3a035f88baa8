"""Image files written and read by tasks, mosaics of overlapping tiles, tiles as rows in SQL."""

from __future__ import annotations

import io
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_layers import image

from rasterloom import crs, geometry as G, session, slippy
from rasterloom.celltype import parse
from rasterloom.functions import mosaic
from rasterloom.operators import layer as Y
from rasterloom.operators.metadata import Extent, KeyBounds, LayerMetadata, Layout, TileLayout
from rasterloom.operators.raster import to_raster
from rasterloom.sources import geotiff, storage, tiff
from rasterloom.tile import TILE_TYPE, Tile

# -- writing -------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("strips", [False, True])
@pytest.mark.parametrize("kind", ["int16ud-1", "float64", "uint8"])
def test_written_files_hold_the_layer(spark, tmp_path, strips, kind):
    cells = np.abs(image(300, 530)).astype(parse(kind).native)
    df = Y.from_raster(spark, [cells, cells // 2], Extent(0, 0, 5.3, 3), tile_cols=97, tile_rows=60, cell_type=kind)
    out = str(tmp_path / "deep" / "a.tif")
    geotiff.write_geotiff(df.repartition(7), out, strips=strips)
    t = tiff.Tiff.open(out)
    assert t.tiled is not strips and (t.width, t.height, t.bands, t.cell_type.native, t.cell_type.nodata) == (530, 300, 2, parse(kind).native, parse(kind).nodata)
    assert np.array_equal(t.window(0, 0, 530, 300), np.stack([cells, cells // 2]))
    assert t.extent == Extent(0, 0, 5.3, 3) and not [p for p in (tmp_path / "deep").iterdir() if p.name != "a.tif"]


def test_blocks_without_tiles_are_nodata(spark, tmp_path):
    layout = Layout(Extent(0, 0, 40, 40), TileLayout(40, 40, 32, 32))
    md = LayerMetadata("int32ud-7", layout, layout.extent, crs.LATLNG, KeyBounds(0, 0, 39, 39))
    df = Y.from_tiles(spark, [(c, r, Tile.of(np.full((32, 32), c * 100 + r), "int32ud-7")) for c, r in ((0, 0), (39, 39), (20, 0))], md)
    for strips in (False, True):
        out = f"file://{tmp_path}/sparse{strips}.tif"
        geotiff.write_geotiff(df, out, strips=strips)
        x = tiff.Tiff.open(out).window(0, 0, 1280, 1280)[0]
        want = np.full((1280, 1280), -7)
        want[:32, :32], want[-32:, -32:], want[:32, 640:672] = 0, 3939, 2000
        assert np.array_equal(x, want)
        assert len((tmp_path / f"sparse{strips}.tif").read_bytes()) < 40_000
    back = geotiff.read_geotiff(spark, out, where=G.box(20.2, 39.2, 20.8, 39.8))
    assert back.count() == 1 and back.agg(F.max("spatial_key.col")).first()[0] == 2


def test_big_files_have_wide_offsets():
    form = tiff.Form(512, 256, 1, parse("uint8"), Extent(0, 0, 2, 1), tile=256, compress=False)
    blocks = [np.full((1, 256, 256), k, np.uint8) for k in (3, 9)]
    head = form.directory([65536, 65536], [0, 65536], 1 << 33)
    assert struct.unpack("<2sH", head[:4]) == (b"II", 43)
    t = tiff.Tiff.open(io.BytesIO(head + b"".join(map(form.pack, blocks))))
    assert t.window(0, 0, 512, 256)[0, 0, ::256].tolist() == [3, 9] and t.extent == Extent(0, 0, 2, 1)
    far = form.directory([65536, 65536], [5 << 32, 6 << 32], 1 << 34)
    assert tiff.Tiff.open(io.BytesIO(far)).tags[tiff.TILE_OFFSETS] == ((5 << 32) + len(far), (6 << 32) + len(far))


def test_of_overlapping_tiles_the_latest_stays(spark, tmp_path):
    layout = Layout(Extent(0, 0, 2, 1), TileLayout(2, 1, 4, 4))
    md = LayerMetadata("float64", layout, layout.extent, crs.LATLNG, KeyBounds(0, 0, 1, 0, 1, 3))
    hole = np.where(np.arange(16).reshape(4, 4) < 5, np.nan, 7.0)
    rows = [(0, 0, 1, Tile.of(np.full((4, 4), 5.0))), (0, 0, 3, Tile.of(hole)), (0, 0, 2, Tile.of(np.full((4, 4), 6.0))), (1, 0, 1, Tile.of(np.full((4, 4), 1.0))), (1, 0, 1, Tile.of(np.full((4, 4), 2.0)))]
    want = np.hstack([np.where(np.isnan(hole), 6.0, 7.0), np.full((4, 4), 2.0)])
    for k in range(3):
        df = Y.from_tiles(spark, rows[k:] + rows[:k], md).repartition(5)
        geotiff.write_geotiff(df, str(tmp_path / "t.tif"))
        assert np.array_equal(tiff.Tiff.open(str(tmp_path / "t.tif")).window(0, 0, 8, 4)[0], want)
        assert np.array_equal(to_raster(df, "tile", 8, 4).tiles[0].cells, want)


def test_files_are_streamed_where_tasks_cannot_write_in_place(spark, tmp_path, monkeypatch):
    cells = image(300, 300)
    df = Y.from_raster(spark, cells, Extent(0, 0, 3, 3), tile_cols=100, tile_rows=100)
    monkeypatch.setattr(storage, "local", lambda uri: None)
    geotiff.write_geotiff(df, str(tmp_path / "s.tif"))
    assert np.array_equal(tiff.Tiff.open(str(tmp_path / "s.tif")).window(0, 0, 300, 300)[0], cells)


# -- reading -------------------------------------------------------------------------------------------------------------------


def test_files_that_only_spark_reaches(spark, tmp_path):
    spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.far.link./in", f"file://{tmp_path}")
    cells = image(300, 530)
    for strips in (False, True):
        geotiff.write_geotiff(Y.from_raster(spark, [cells, cells + 1], Extent(0, 0, 5.3, 3), tile_cols=100, tile_rows=100), str(tmp_path / "far.tif"), strips=strips)
        path = "viewfs://far/in/far.tif"
        assert not storage.reaches(path) and storage.reaches(str(tmp_path)) and storage.reaches(f"file://{tmp_path}")
        df, near = geotiff.read_geotiff(spark, path), geotiff.read_geotiff(spark, f"file:{tmp_path}/far.tif")
        assert df.columns == near.columns and Y.tile_layer_metadata(df) == Y.tile_layer_metadata(near)
        assert sorted(map(str, df.collect())) == sorted(map(str, near.collect())) and df.count() == 6
        area = G.box(0.1, 2.5, 0.2, 2.9)
        assert geotiff.read_geotiff(spark, path, where=area).count() == geotiff.read_geotiff(spark, f"file:{tmp_path}/far.tif", where=area).count() == 1


def test_a_window_reads_only_its_blocks(spark, tmp_path):
    cells = image(600, 600)
    geotiff.write_geotiff(Y.from_raster(spark, cells, Extent(0, 0, 6, 6), tile_cols=200, tile_rows=200), str(tmp_path / "w.tif"))
    t = tiff.Tiff.open(str(tmp_path / "w.tif"))
    reader = geotiff.GeoTiffReader("", geotiff.layout_of(t), (1, 1), (0, 5))
    assert [k for p in reader.partitions() for k in p.keys] == [(1, 0), (1, 1), (1, 2)]
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "false"
    geotiff.read_geotiff(spark, str(tmp_path / "w.tif")).count()
    assert spark.conf.get("spark.sql.python.filterPushdown.enabled", "false") == "false"


# -- mosaics -------------------------------------------------------------------------------------------------------------------


def test_mosaics_do_not_depend_on_order():
    r = np.random.default_rng(9)
    parts = []
    for _ in range(12):
        w, h = r.integers(1, 6, 2)
        x, y = r.integers(0, 7 - w), r.integers(0, 7 - h)
        parts.append((int(x), int(y), np.where(r.random((h, w)) < 0.3, np.nan, r.integers(0, 3, (h, w)).astype(float)), int(r.integers(0, 3))))
    seen = []
    for _ in range(20):
        m, halves = mosaic.Mosaic(1, 6, 6), [mosaic.Mosaic(1, 6, 6), mosaic.Mosaic(1, 6, 6)]
        for k in r.permutation(len(parts)):
            x, y, cells, t = parts[k]
            m.add(0, x, y, cells, t)
            halves[k % 2].add(0, x, y, cells, t)
        halves[0].add(0, 0, 0, halves[1].values[0], halves[1].times[0])
        seen += [m.values.tobytes(), halves[0].values.tobytes()]
    assert len(set(seen)) == 1


def test_web_tiles_of_a_space_time_layer(spark):
    layout = Layout(Extent(0, 0, 10, 10), TileLayout(1, 1, 8, 8))
    md = LayerMetadata("float64", layout, layout.extent, crs.LATLNG, KeyBounds(0, 0, 0, 0, 1, 40))
    rows = [(0, 0, k, Tile.of(np.full((8, 8), float(k)))) for k in range(1, 41)]
    alone = Y.from_tiles(spark, rows[-1:], md)
    want = {(r.x, r.y): bytes(r.bands[0]) for r in slippy.web_tiles(alone, 5).collect()}
    assert want
    for seed in (1, 2):
        df = Y.from_tiles(spark, rows, md).orderBy(F.rand(seed)).repartition(20)
        assert {(r.x, r.y): bytes(r.bands[0]) for r in slippy.web_tiles(df, 5).collect()} == want


# -- tiles as rows in SQL --------------------------------------------------------------------------------------------------------


def test_explode_any_number_of_tiles_in_sql(spark):
    session.init(spark)
    t = lambda v: Tile.of(np.full((2, 3), v) + np.arange(6).reshape(2, 3), "float64").row()
    schema = spark.createDataFrame([], "k int").schema
    for n in "abcd":
        schema = schema.add(n, TILE_TYPE)
    spark.createDataFrame([(1, t(0.0), t(10.0), t(20.0), None), (2, None, None, None, None), (3, t(100.0), None, t(0.5), t(1.0))], schema).createOrReplaceTempView("_many")
    got = [tuple(r) for r in spark.sql("select k, e.* from _many, lateral rf_explodeTiles(a, b, c, d) e order by 1, 3, 2").collect()]
    assert len(got) == 12 and got[1][:5] == (1, 1, 0, 1.0, 11.0) and np.isnan(got[0][6]) and got[-1][3] == 105.0 and np.isnan(got[-1][4])
    one = spark.sql("select k, e.* from _many, lateral rf_explodeTiles(a) e")
    assert one.columns == ["k", "column_index", "row_index", "cell"] and one.count() == 12
    fast = [tuple(r) for r in spark.sql("select k, c.column_index, c.row_index, c.cells[0], c.cells[1], c.cells[2], c.cells[3] from (select k, explode(rf_tileCells(a, b, c, d)) as c from _many) order by 1, 3, 2").collect()]
    assert str(fast) == str(got)
    spark.createDataFrame([(1, t(0.0), Tile.of(np.ones((3, 3))).row(), None, None)], schema).createOrReplaceTempView("_odd")
    for text in ("select e.* from _odd, lateral rf_explodeTiles(a, b) e", "select rf_tileCells(a, b) from _odd"):
        with pytest.raises(Exception, match="different sizes"):
            spark.sql(text).collect()
