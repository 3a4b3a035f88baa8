import datetime as dt
import json
import re
import warnings

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import crs, geometry as G, render, session, slippy
from rasterloom.functions import scalar as S
from rasterloom.functions.aggregate import agg_data_cells, agg_mean, agg_stats, assemble_tile
from rasterloom.functions.explode import explode_tiles
from rasterloom.ml import NoDataFilter, TileExploder
from rasterloom.operators import layer as Y
from rasterloom.operators.metadata import Extent, KeyBounds, LayerMetadata, Layout, TileLayout, subdivide_key
from rasterloom.operators.raster import resample, subdivide_tile, to_multiband_raster, to_raster, with_tile_subdivisions
from rasterloom.plans.pruning import join_points, where_contains, where_intersects
from rasterloom.sources import geotiff, layers, tiff
from rasterloom.streaming.tiles import windowed_stats
from rasterloom.tile import TILE_TYPE, Tile

WORLD = Extent(-180, -90, 180, 90)


def image(rows=500, cols=774, seed=1):
    y, x = np.mgrid[0:rows, 0:cols]
    return ((np.sin(x / 40) + np.cos(y / 30)) * 100 + 300).astype(np.int16)


def keyed(spark, temporal=False):
    """16 tiles with keys 2 to 5 on a 16 x 16 grid of 12 x 12 cells."""
    layout = Layout(WORLD, TileLayout(16, 16, 12, 12))
    instant = (1_700_000_000_000, 1_700_000_000_000) if temporal else (None, None)
    md = LayerMetadata("int32raw", layout, WORLD, crs.LATLNG, KeyBounds(2, 2, 5, 5, *instant))
    rows = [(c, r, *([instant[0]] if temporal else []), Tile.of(np.full((12, 12), 10 * c + r), "int32raw")) for c in range(2, 6) for r in range(2, 6)]
    return Y.from_tiles(spark, rows, md)


# -- metadata --------------------------------------------------------------------------------------------------------------


def test_subdivision_facts():
    t = TileLayout(2, 3, 10, 10)
    assert t.subdivide(2) == TileLayout(4, 6, 5, 5) and t.subdivide(0) == t.subdivide(1) == t
    for n in (-1, 3):
        with pytest.raises(ValueError):
            t.subdivide(n)
    assert KeyBounds(2, 2, 9, 9).subdivide(2) == KeyBounds(4, 4, 19, 19)
    assert subdivide_key(2, 3, 3) == [(c, r) for r in (9, 10, 11) for c in (6, 7, 8)]
    parts = subdivide_tile(Tile.of(np.arange(16).reshape(4, 4)), 2)
    assert [p.cells.tolist() for p in parts] == [[[0, 1], [4, 5]], [[2, 3], [6, 7]], [[8, 9], [12, 13]], [[10, 11], [14, 15]]]


def test_metadata_json_round_trip(spark):
    for temporal in (False, True):
        md = Y.tile_layer_metadata(keyed(spark, temporal))
        assert LayerMetadata.from_json(json.loads(json.dumps(md.json()))) == md and md.temporal == temporal


def test_certification(spark):
    df = keyed(spark)
    assert Y.is_rf(df) and Y.tile_columns(df) == ["tile"] and Y.spatial_key_column(df) == "spatial_key" and Y.temporal_key_column(df) is None
    bare = df.select(F.col("tile"), F.struct("spatial_key.col", "spatial_key.row").alias("k"))
    assert not Y.is_rf(bare) and Y.as_rf_safely(bare) is None
    with pytest.raises(ValueError):
        Y.as_rf(bare)
    again = Y.as_rf(bare, "k", Y.tile_layer_metadata(df).json())
    assert Y.layer_crs(again) == crs.LATLNG
    for kept in (df.where("spatial_key.col = 2"), df.withColumnRenamed("spatial_key", "q"), df.union(df), df.alias("x")):
        assert Y.tile_layer_metadata(kept) == Y.tile_layer_metadata(df)
    assert "_context" in Y.describe_full_schema(df)


def test_rasters_are_cut_as_expected(spark):
    for size, n, m in ((256, 4, 2), (128, 7, 4)):
        df = Y.from_raster(spark, image(), WORLD, tile_cols=size, tile_rows=size)
        assert df.count() == n * m
        b = Y.tile_layer_metadata(df).bounds
        assert (b.col_min, b.row_min, b.col_max, b.row_max) == (0, 0, n - 1, m - 1)


@pytest.mark.parametrize("scale", [1, 0.5, 2])
def test_raster_round_trip(spark, scale):
    cells = image(60, 90).astype(np.float64)
    df = Y.from_raster(spark, cells, Extent(0, 0, 9, 6), tile_cols=32, tile_rows=32)
    r = to_raster(df, "tile", int(90 * scale), int(60 * scale))
    whole = np.full((64, 96), np.nan)
    whole[:60, :90] = cells
    assert r.extent == Extent(0, 0, 9, 6)
    if scale == 1:
        assert np.array_equal(r.tiles[0].cells, cells)
    else:
        assert np.array_equal(r.tiles[0].cells, resample(cells, int(90 * scale), int(60 * scale)))


def test_explode_assemble_raster(spark):
    cells = image(40, 50).astype(np.float64)
    df = Y.from_raster(spark, cells, Extent(0, 0, 5, 4), tile_cols=10, tile_rows=10)
    back = explode_tiles(df, "tile").groupBy("spatial_key").agg(assemble_tile("column_index", "row_index", "tile", 10, 10, "float64").alias("tile"))
    out = Y.as_rf(back, "spatial_key", Y.tile_layer_metadata(df))
    assert np.array_equal(to_raster(out, "tile", 50, 40).tiles[0].cells, cells)


def test_keys_to_map_space(spark):
    df = Y.with_center(Y.with_bounds(keyed(spark)))
    r = df.where("spatial_key.col = 2 and spatial_key.row = 3").first()
    w, h = 360 / 16, 180 / 16
    assert G.from_wkb(bytes(r.bounds)).box() == pytest.approx((-180 + 2 * w, -180 + 3 * w, 90 - 4 * h, 90 - 3 * h))
    assert (r.center.x, r.center.y) == pytest.approx((-180 + 2.5 * w, 90 - 3.5 * h))
    lat = Y.with_center_lat_lng(keyed(spark)).where("spatial_key.col = 2 and spatial_key.row = 3").first().center
    assert (lat.longitude, lat.latitude) == pytest.approx((r.center.x, r.center.y))


def z_order(lon, lat):
    x, y = (min(int((v - lo) / (hi - lo) * 2**31), 2**31 - 1) for v, lo, hi in ((lon, -180, 180), (lat, -90, 90)))
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(31))


def test_spatial_index(spark):
    got = Y.with_spatial_index(Y.with_center(keyed(spark))).collect()
    assert [r.spatial_index for r in got] == sorted(z_order(r.center.x, r.center.y) for r in got)
    assert all(r.spatial_index == z_order(r.center.x, r.center.y) for r in got)


def test_time(spark):
    df = keyed(spark)
    when = dt.datetime(2020, 5, 17, 12, 30, tzinfo=dt.timezone.utc)
    timed = Y.with_timestamp(Y.add_temporal_component(df, when))
    assert Y.temporal_key_column(timed) == "temporal_key" and Y.tile_layer_metadata(timed).temporal
    naive = when.replace(tzinfo=None)
    assert timed.where(Y.at_time("timestamp", naive)).count() == 16
    assert timed.where(Y.between_times("timestamp", naive, naive)).count() == 16
    assert timed.where(Y.between_times("timestamp", dt.datetime(2021, 1, 1), dt.datetime(2022, 1, 1))).count() == 0
    with pytest.raises(ValueError):
        Y.add_temporal_component(timed, when)


def test_clip_layer_extent(spark):
    part = keyed(spark).where("spatial_key.col in (3, 4) and spatial_key.row = 5")
    md = Y.tile_layer_metadata(Y.clip_layer_extent(part))
    w, h = 360 / 16, 180 / 16
    assert md.bounds == KeyBounds(3, 5, 4, 5)
    assert (md.extent.xmin, md.extent.xmax, md.extent.ymin, md.extent.ymax) == pytest.approx((-180 + 3 * w, -180 + 5 * w, 90 - 6 * h, 90 - 5 * h))


@pytest.mark.parametrize("how,rows", [("inner", 12), ("left_outer", 16), ("right_outer", 12), ("outer", 16), ("fullouter", 16), ("leftsemi", 12), ("left_anti", 4)])
def test_joins(spark, how, rows):
    left = keyed(spark)
    right = Y.with_column_renamed(keyed(spark).where("spatial_key.col > 2"), "tile", "other")
    out = Y.spatial_join(left, right, how)
    assert out.count() == rows
    assert Y.tile_layer_metadata(left) == LayerMetadata.from_json(json.loads(out.schema[next(c for c in out.columns if c in ("spatial_key", "left_spatial_key"))].metadata[Y.CONTEXT]))
    if how == "inner":
        assert out.columns == ["spatial_key", "tile", "other"]
    elif how in ("leftsemi", "left_anti"):
        assert out.columns == left.columns
    else:
        assert {"left_spatial_key", "right_spatial_key"} <= set(out.columns)


def test_join_with_time_on_either_side(spark):
    a, b = keyed(spark, True), Y.with_column_renamed(keyed(spark), "tile", "other")
    assert Y.spatial_join(a, b).count() == 16
    later = Y.with_column_renamed(Y.add_temporal_component(keyed(spark), 5), "tile", "other")
    assert Y.spatial_join(a, later).count() == 0
    assert Y.temporal_key_column(Y.spatial_join(a, b)) == "temporal_key"


def test_join_of_different_layouts_warns(spark):
    with warnings.catch_warnings(record=True) as w:
        warnings.simplefilter("always")
        Y.spatial_join(keyed(spark), Y.with_column_renamed(with_tile_subdivisions(keyed(spark), 2), "tile", "o"))
    assert any("layouts" in str(x.message) for x in w)


# -- geometries --------------------------------------------------------------------------------------------------------------


SQUARE = G.box(0, 0, 4, 4)
CASES = [
    ("contains", SQUARE, G.point(2, 2), True),
    ("contains", SQUARE, G.point(0, 2), False),
    ("covers", SQUARE, G.point(0, 2), True),
    ("intersects", SQUARE, G.point(4, 4), True),
    ("touches", SQUARE, G.point(0, 2), True),
    ("touches", SQUARE, G.box(4, 0, 6, 4), True),
    ("touches", SQUARE, G.box(4, 4, 6, 6), True),
    ("touches", SQUARE, G.box(3, 3, 6, 6), False),
    ("overlaps", SQUARE, G.box(3, 3, 6, 6), True),
    ("overlaps", SQUARE, G.box(1, 1, 2, 2), False),
    ("overlaps", SQUARE, SQUARE, False),
    ("contains", SQUARE, SQUARE, True),
    ("contains", SQUARE, G.box(1, 1, 2, 2), True),
    ("within", G.box(1, 1, 2, 2), SQUARE, True),
    ("disjoint", SQUARE, G.box(5, 5, 6, 6), True),
    ("crosses", G.line((-1, 2), (5, 2)), SQUARE, True),
    ("crosses", G.line((1, 1), (2, 2)), SQUARE, False),
    ("within", G.line((1, 1), (2, 2)), SQUARE, True),
    ("touches", G.line((0, 0), (0, 4)), SQUARE, True),
    ("covers", SQUARE, G.line((0, 0), (0, 4)), True),
    ("contains", SQUARE, G.line((0, 0), (0, 4)), False),
    ("crosses", G.line((0, 0), (2, 2)), G.line((0, 2), (2, 0)), True),
    ("overlaps", G.line((0, 0), (2, 0)), G.line((1, 0), (3, 0)), True),
    ("touches", G.line((0, 0), (1, 1)), G.line((1, 1), (2, 0)), True),
    ("contains", G.line((0, 0), (2, 2)), G.point(1, 1), True),
    ("touches", G.line((0, 0), (2, 2)), G.point(2, 2), True),
    ("contains", G.polygon([(0, 0), (0, 9), (9, 9), (9, 0)], [(3, 3), (3, 6), (6, 6), (6, 3)]), G.box(4, 4, 5, 5), False),
    ("disjoint", G.polygon([(0, 0), (0, 9), (9, 9), (9, 0)], [(3, 3), (3, 6), (6, 6), (6, 3)]), G.box(4, 4, 5, 5), True),
    ("overlaps", G.collection(G.point(0, 0), G.point(1, 1), kind="MultiPoint"), G.collection(G.point(1, 1), G.point(2, 2), kind="MultiPoint"), True),
    ("intersects", G.collection(G.box(0, 0, 1, 1), G.box(3, 3, 4, 4), kind="MultiPolygon"), G.point(3.5, 3.5), True),
    ("within", G.point(1, 1), G.point(1, 1), True),
]


@pytest.mark.parametrize("name,a,b,want", CASES)
def test_predicates(name, a, b, want):
    assert G.PREDICATES[name](a, b) is want


def test_codecs():
    for text in ("POINT (1 2)", "LINESTRING (1 2, 3 4.5)", "POLYGON ((0 0, 0 4, 4 4, 4 0, 0 0), (1 1, 1 2, 2 2, 2 1, 1 1))", "MULTIPOINT ((1 2), (3 4))", "MULTILINESTRING ((0 0, 1 1), (2 2, 3 3))", "MULTIPOLYGON (((0 0, 0 1, 1 1, 1 0, 0 0)), ((5 5, 5 6, 6 6, 6 5, 5 5)))", "GEOMETRYCOLLECTION (POINT (1 2), LINESTRING (0 0, 1 1))"):
        g = G.from_wkt(text)
        assert G.to_wkt(g) == text and G.to_wkt(G.from_wkb(g.wkb())) == text


def test_measures():
    p = G.polygon([(0, 0), (0, 4), (4, 4), (4, 0)], [(1, 1), (1, 2), (2, 2), (2, 1)])
    assert G.area(p) == 15 and G.length(G.line((0, 0), (3, 4))) == 5
    assert G.distance(G.point(0, 0), G.box(3, 4, 5, 6)) == 5
    assert G.centroid(SQUARE).points[0] == (2, 2)


def test_geometry_columns(spark):
    df = Y.with_bounds(keyed(spark))
    p = G.point(-180 + 2.5 * 22.5, 90 - 3.5 * 11.25)
    counts = {n: df.where(G.UDF_PREDICATES[n](F.col("bounds"), G.geom_lit(p))).count() for n in G.PREDICATES}
    assert counts == {"intersects": 1, "contains": 1, "covers": 1, "crosses": 0, "disjoint": 15, "overlaps": 0, "touches": 0, "within": 0}
    r = df.select(G.box2d("bounds").alias("b"), G.st_measure("st_area", "bounds").alias("a"), G.st_measure("st_asText", "bounds").alias("t")).first()
    assert r.b.maxX - r.b.minX == pytest.approx(22.5) and r.a == pytest.approx(22.5 * 11.25) and r.t.startswith("POLYGON")
    assert df.select(G.box2d("bounds")).columns == ["box2d(bounds)"]


def test_pruned_filters_and_point_join(spark):
    df = keyed(spark)
    p = G.point(-180 + 3 * 22.5, 90 - 4 * 11.25)  # a corner of four keys
    assert where_intersects(df, p).count() == 4 and where_contains(df, p).count() == 0
    points = spark.createDataFrame([(1, *p.points[0]), (2, -180 + 2.5 * 22.5, 90 - 2.5 * 11.25), (3, 170.0, -80.0), (4, None, 1.0)], "id int, x double, y double")
    got = join_points(df, points, "x", "y").groupBy("id").count().collect()
    assert {r.id: r["count"] for r in got} == {1: 4, 2: 1}


# -- projections ---------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("target", [crs.WEB_MERCATOR, "EPSG:32617", "EPSG:32733", "+proj=aea +lat_1=29.5 +lat_2=45.5 +lat_0=23 +lon_0=-96 +x_0=0 +y_0=0 +datum=NAD83", "+proj=sinu +lon_0=0 +x_0=0 +y_0=0 +a=6371007.181 +b=6371007.181", "+proj=sinu +lon_0=0 +datum=WGS84"])
def test_projections_invert(target):
    lon0 = {"EPSG:32617": -81, "EPSG:32733": 15}.get(target, -90 if "aea" in target else 10)
    lon, lat = lon0 + np.linspace(-2, 2, 9), (-1 if "733" in target else 1) * np.linspace(20, 50, 9)
    back = crs.unproject(target, *crs.project(target, lon, lat))
    assert np.allclose(back, (lon, lat), atol=1e-7)


def test_known_coordinates():
    assert np.allclose(crs.project(crs.WEB_MERCATOR, np.array([180.0]), np.array([0.0])), [[20037508.342789244], [0]])
    x, y = crs.project("EPSG:32631", np.array([3.0]), np.array([0.0]))
    assert np.allclose((x[0], y[0]), (500000, 0), atol=1e-6)
    x, y = crs.project("EPSG:32618", np.array([-75.0]), np.array([40.0]))
    assert np.allclose((x[0], y[0]), (500000, 4427757.22), atol=0.5)


# -- sources --------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("tile", [None, 64])
@pytest.mark.parametrize("name", ["uint8raw", "int16", "uint16ud255", "int32raw", "float32", "float64ud-1.0"])
def test_tiff_round_trip(name, tile):
    from rasterloom import celltype

    ct = celltype.parse(name)
    cells = np.stack([image(70, 100) % 200, image(70, 100) % 50]).astype(ct.native)
    t = tiff.Tiff.open(tiff.encode(cells, ct, Extent(1, 2, 11, 9), "EPSG:32617", tile=tile))
    assert (t.window(0, 0, 100, 70) == cells).all() and t.extent == Extent(1, 2, 11, 9) and "zone=17" in t.crs
    assert t.cell_type.nodata is None or t.cell_type.nodata == ct.nodata or np.isnan(ct.nodata)
    part = t.window(90, 60, 20, 20)
    assert (part[:, :10, :10] == cells[:, 60:, 90:]).all()


def test_tiff_codecs():
    assert tiff._packbits(bytes([2, 65, 66, 67, 254, 68])) == b"ABCDDD"
    # "AAAB" as 9-bit codes: clear, A, 258 (AA), B, end
    bits = "".join(f"{c:09b}" for c in (256, 65, 258, 66, 257))
    raw = bytes(int(bits.ljust(48, "0")[i : i + 8], 2) for i in range(0, 48, 8))
    assert tiff._lzw(raw) == b"AAAB"


def test_geotiff_source(spark, tmp_path):
    session.init(spark)
    cells, path = image(), str(tmp_path / "a.tif")
    with open(path, "wb") as f:
        f.write(tiff.encode(cells, Tile.of(cells, "int16raw").cell_type, Extent(0, 0, 7.74, 5), crs.LATLNG))
    df = geotiff.read_geotiff(spark, path)
    assert df.columns == ["spatial_key", "bounds", "metadata", "tile"] and df.count() == 8 and Y.is_rf(df)
    assert np.array_equal(to_raster(df, "tile", 774, 500).tiles[0].cells, cells)
    assert df.where("spatial_key.col = 1 and spatial_key.row = 0").count() == 1
    assert df.agg(agg_stats("tile").alias("s")).first().s.max == cells.max()
    tiled = str(tmp_path / "b.tif")
    rgb = np.stack([cells, cells + 1, cells + 2])
    with open(tiled, "wb") as f:
        f.write(tiff.encode(rgb, Tile.of(cells, "int16raw").cell_type, Extent(0, 0, 7.74, 5), crs.LATLNG, tile=128))
    three = spark.read.geotiff(tiled)
    assert Y.tile_columns(three) == ["tile_1", "tile_2", "tile_3"] and three.count() == 28
    out = str(tmp_path / "c.tif")
    geotiff.write_geotiff(three, out)
    assert (tiff.Tiff.open(out).window(0, 0, 774, 500) == rgb).all()
    geotiff.write_geotiff(three, out, image_width=100, image_height=80)
    assert (tiff.Tiff.open(out).width, tiff.Tiff.open(out).height) == (100, 80)
    many = geotiff.read_files(spark, f"file://{tmp_path}/a.tif")
    assert many.count() == 8 and many.agg(agg_data_cells("tile")).first()[0] == 8 * 256 * 256


def test_layer_files_and_catalog(spark, tmp_path):
    base = f"file://{tmp_path}/layers"
    df, timed = keyed(spark), keyed(spark, True)
    layers.write_layer(df.withColumn("tile_data", F.to_json("spatial_key")), layers.Layer(base, "one", 4))
    layers.write_layer(timed, layers.Layer(base, "two", 4), partitions=3)
    back = layers.read_layer(spark, layers.Layer(base, "one", 4))
    assert {"spatial_key", "tile", "tile_data", "bounds"} == set(back.columns) and back.count() == 16
    assert Y.tile_layer_metadata(back) == Y.tile_layer_metadata(df)
    b2 = layers.read_layer(spark, layers.Layer(base, "two", 4), num_partitions=5)
    assert "timestamp" in b2.columns and b2.rdd.getNumPartitions() == 5 and Y.temporal_key_column(b2) == "temporal_key"
    for n in (0, 1, 2, 3, 4):
        assert layers.read_layer(spark, layers.Layer(base, "one", 4), tile_subdivisions=n).count() == 16 * max(1, n) ** 2
    for n in (5, 13, -3):
        with pytest.raises(ValueError):
            layers.read_layer(spark, layers.Layer(base, "one", 4), tile_subdivisions=n)
    fine = layers.read_layer(spark, layers.Layer(base, "one", 4), tile_subdivisions=2)
    assert fine.agg(agg_mean("tile")).first()[0] == pytest.approx(back.agg(agg_mean("tile")).first()[0])
    p = G.point(-180 + 2.5 * 22.5, 90 - 3.5 * 11.25)
    near = layers.read_layer(spark, layers.Layer(base, "one", 4), where=p, bounds=False)
    plan = near._jdf.queryExecution().toString()
    assert near.count() == 1 and "PushedFilters: [" in plan and "spatial_key.col" in plan.split("PushedFilters")[1]
    catalog = layers.read_catalog(spark, base).collect()
    assert {(r.layer.id.name, r.layer.id.zoom) for r in catalog} == {("one", 4), ("two", 4)}
    assert LayerMetadata.from_json(json.loads(catalog[0].metadata)).crs == crs.LATLNG


# -- rendering -------------------------------------------------------------------------------------------------------------------


def test_profiles():
    x = np.array([[0.0, 4000, 9588, 15176, 20000, np.nan]])
    got = render.LANDSAT8_NATURAL_COLOR.apply(Tile.of(x, "float64"))
    assert got[0, 0] == got[0, 1] == 0 and got[0, 3] == got[0, 4] == 255 and np.isnan(got[0, 5])
    assert got[0, 2] == int(255 * ((127 + 15) / 255) ** (1 / 0.8))
    picture = render.rgb_composite([Tile.of(x, "float64")] * 3, render.NAIP_NATURAL_COLOR)
    assert picture[:8] == b"\x89PNG\r\n\x1a\n"


def test_slippy_export(spark, tmp_path):
    cells = image(64, 64).astype(np.float64)
    df = Y.from_raster(spark, cells, Extent(10, 40, 20, 50), tile_cols=32, tile_rows=32)
    z = slippy.export_png(df, str(tmp_path / "png"), zoom=5)
    files = sorted(str(p.relative_to(tmp_path / "png")) for p in (tmp_path / "png").rglob("*.png"))
    assert z == 5 and "0/0/0.png" in files and any(f.startswith("5/") for f in files) and (tmp_path / "png/index.html").exists()
    slippy.export_geotiff(df, str(tmp_path / "tif"), zoom=4)
    t = tiff.Tiff.open(str(next((tmp_path / "tif").rglob("*.tiff"))))
    assert t.width == 256 and np.isfinite(t.window(0, 0, 256, 256)).any()
    assert 0 <= slippy.finest_zoom(df) <= 22


# -- machine learning, SQL, streams ------------------------------------------------------------------------------------------------


def test_ml_stages(spark, tmp_path):
    df = Y.from_raster(spark, [image(20, 20).astype(float), np.where(image(20, 20) > 300, np.nan, 1.0)], Extent(0, 0, 2, 2), tile_cols=10, tile_rows=10)
    e = TileExploder()
    cells = e.transform(df)
    assert cells.columns == ["spatial_key", "column_index", "row_index", "tile_1", "tile_2"] and cells.count() == 400
    f = NoDataFilter(inputCols=["tile_2", "absent"])
    assert f.transform(cells).count() == int((image(20, 20) <= 300).sum())
    for stage, cls in ((e, TileExploder), (f, NoDataFilter)):
        stage.write().overwrite().save(str(tmp_path / cls.__name__))
        assert cls.load(str(tmp_path / cls.__name__)).uid == stage.uid
    assert NoDataFilter.load(str(tmp_path / "NoDataFilter")).getInputCols() == ["tile_2", "absent"]


def test_clustering_pipeline(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    left = np.zeros((10, 10))
    left[:, 5:] = 100
    df = Y.from_raster(spark, [left, left + 1], Extent(0, 0, 1, 1))
    stages = [TileExploder(), NoDataFilter(inputCols=["tile_1", "tile_2"]), VectorAssembler(inputCols=["tile_1", "tile_2"], outputCol="features"), KMeans(k=2, seed=1)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    tiles = out.groupBy("spatial_key").agg(assemble_tile("column_index", "row_index", "prediction", 10, 10, "uint8raw").alias("t")).first()
    got = Tile.from_row(tiles.t).cells
    assert (got[:, :5] == got[0, 0]).all() and (got[:, 5:] == 1 - got[0, 0]).all()


def test_sql_names(spark):
    session.init(spark)
    a = np.array([[1, 2], [0, 4]])
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", TILE_TYPE), T.StructField("b", TILE_TYPE)])
    spark.createDataFrame([(1, Tile.of(a, "uint8").row(), Tile.of(a + 1, "uint8").row()), (1, None, None)], schema).createOrReplaceTempView("tiles")
    one = spark.sql("""
      select rf_tileMean(a) m, rf_tileSum(a) s, rf_tileMin(a) lo, rf_tileMax(a) hi, rf_dataCells(a) n, rf_nodataCells(a) x, rf_tileStats(a) st, rf_cellType(a) t,
        rf_tileDimensions(a) d, rf_tileSum(rf_localAdd(a, b)) ad, rf_tileSum(rf_localSubtract(b, a)) su, rf_tileSum(rf_localMultiply(a, b)) mu, rf_tileSum(rf_localDivide(b, a)) di,
        rf_tileToArrayInt(a) ia, rf_tileToArrayDouble(a) da, rf_renderAscii(a) art, rf_cellTypes() ct, rf_tileSum(rf_makeConstantTile(3, 2, 2, 'int8')) c, rf_tileHistogram(a) h,
        rf_cellType(rf_convertCellType(a, 'float32')) cv, rf_cellType(rf_withNoData(a, 4)) wn, rf_tileSum(rf_arrayToTile(array(1.0D, 2.0D), 2, 1)) at
      from tiles where a is not null""").first()
    assert (one.m, one.s, one.lo, one.hi, one.n, one.x, one.t) == (7 / 3, 7, 1, 4, 3, 1, "uint8") and tuple(one.d) == (2, 2)
    assert (one.ad, one.su, one.mu, one.di) == (17, 3, 28, 4)
    assert one.ia == [1, 2, -2147483648, 4] and len(one.ct) == 15 and one.c == 12 and (one.cv, one.wn, one.at) == ("float32", "uint8ud4", 3.0)
    agg = spark.sql("select rf_aggStats(a) s, rf_aggMean(a) m, rf_aggDataCells(a) n, rf_aggNoDataCells(a) x, rf_aggHistogram(a) h, rf_localAggStats(a) l, rf_localAggMax(a) mx, rf_localAggMin(a) mn, rf_localAggMean(a) me, rf_localAggCount(a) c from tiles group by k").first()
    assert (agg.s.dataCells, agg.m, agg.n, agg.x) == (3, 7 / 3, 3, 1) and sum(b["count"] for b in agg.h.bins) == 3
    assert Tile.from_row(agg.c).cells.sum() == 3 and Tile.from_row(agg.l.max).cells[1, 1] == 4
    spark.sql("select k, e.* from tiles, lateral rf_explodeTiles(a) e").createOrReplaceTempView("cells")
    again = spark.sql("select rf_assembleTile(column_index, row_index, cell, 2, 2, 'uint8') t from cells group by k").first()
    assert Tile.from_row(again.t).cells.tolist() == a.tolist()
    cells = spark.sql("select k, e.* from tiles, lateral rf_explodeTiles(a) e").collect()
    assert len(cells) == 4 and sum(r.cell for r in cells if r.cell == r.cell) == 7
    assert spark.sql("select st_intersects(st_geomFromWKT('POINT (1 1)'), st_geomFromWKT('POLYGON ((0 0, 0 2, 2 2, 2 0, 0 0))'))").first()[0]


def test_composed_sql(spark):
    c = session.composed
    for text in ("select 'rf_aggMean(tile)', \"rf_aggMean(a)\", `rf_aggMean(b)` -- rf_aggMean(c)\n/* rf_aggMean(d) */ from t", "select rf_aggMean(a) filter (where b) from t", "select rf_aggMean(a) over (partition by k) from t", "select rf_aggMean(distinct a) from t", "select rf_aggMean from t", "select rf_aggMean(a", "it's"):
        assert c(text) == text
    assert c("select RF_AGGMEAN ( f(a, ')') ) m") == "select (try_divide(sum(rf_tilePartial(f(a, ')')).sum), sum(rf_tilePartial(f(a, ')')).n))) m"
    assert c("rf_aggDataCells(rf_merge(a, b)) + rf_aggNoDataCells(a)").count("rf_tilePartial") == 3
    session.init(spark)
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("a", TILE_TYPE)])
    rows = [(1, Tile.of(np.array([[1, 2], [0, 4]]), "uint8").row()), (1, None), (2, None), (3, Tile.of(np.zeros((2, 2)), "uint8").row())]
    spark.createDataFrame(rows, schema).createOrReplaceTempView("few")
    text = "select k, rf_aggStats(a) s, rf_aggMean(a) m, rf_aggDataCells(a) n, rf_aggNoDataCells(a) x, rf_aggHistogram(a) h from few group by k order by k"
    one, two = session.sql(spark, text), spark.sql(text)
    assert str(one.collect()) == str(two.collect())
    exchanged = re.findall(r"Exchange hashpartitioning.*", one._jdf.queryExecution().toString())
    assert "partial_sum" in one._jdf.queryExecution().toString() and exchanged


def test_vegetation_index(spark):
    red, near = np.array([[1.0, 2.0], [np.nan, 4.0]]), np.array([[3.0, 2.0], [5.0, 12.0]])
    df = Y.from_raster(spark, [red, near], Extent(0, 0, 1, 1))
    got = Tile.from_row(df.select(S.normalized_difference("tile_2", "tile_1").alias("t")).first().t).doubles()
    assert np.array_equal(got, [[0.5, 0.0], [np.nan, 0.5]], equal_nan=True)


def test_decision_tree_on_cells(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    y, x = np.mgrid[0:12, 0:12]
    label = ((x > 5) ^ (y > 7)).astype(float)
    df = Y.from_raster(spark, [x.astype(float), y.astype(float), label], Extent(0, 0, 1, 1), tile_cols=6, tile_rows=6)
    stages = [TileExploder(), NoDataFilter(inputCols=["tile_1", "tile_2"]), VectorAssembler(inputCols=["tile_1", "tile_2"], outputCol="features"), DecisionTreeClassifier(labelCol="tile_3", maxDepth=4)]
    out = Pipeline(stages=stages).fit(df).transform(df)
    assert out.count() == 144 and out.where("prediction <> tile_3").count() == 0


def test_pictures_read_back():
    r = np.random.default_rng(1)
    for channels in (3, 4):
        x = r.integers(0, 256, (5, 7, channels)).astype(np.uint8)
        assert np.array_equal(render.pixels(render.png(x)), x)


def test_streams(spark, tmp_path):
    schema = T.StructType([T.StructField("ts", T.TimestampType()), T.StructField("k", T.LongType()), T.StructField("tile", TILE_TYPE)])
    rows = [(dt.datetime(2024, 1, 1, 0, m), m % 2, Tile.of(np.full((2, 2), m + 1), "int32").row()) for m in range(10)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = windowed_stats(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "ts", "tile", ["k"]).writeStream.outputMode("complete").format("memory").queryName("tile_windows").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window.start.minute, r.k): r.stats.mean for r in spark.table("tile_windows").collect()}
    assert got == {(0, 0): 3.0, (0, 1): 3.0, (5, 0): 8.0, (5, 1): 8.0}
