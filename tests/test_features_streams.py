"""Features burned into tiles, scan conversion, running tiles of streams."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom import crs, geometry as G
from rasterloom.functions import local_aggregate
from rasterloom.functions.scan import covered
from rasterloom.operators import layer as Y
from rasterloom.operators.features import burned
from rasterloom.operators.metadata import Extent, KeyBounds, LayerMetadata, Layout, TileLayout
from rasterloom.streaming.tiles import running_states, running_tiles
from rasterloom.tile import TILE_TYPE, Tile


def plain_cover(g, e, cols, rows):
    """Middles located one by one."""
    out = np.zeros((rows, cols), bool)
    for r in range(rows):
        for c in range(cols):
            p = e.xmin + (c + 0.5) * e.width / cols, e.ymax - (r + 0.5) * e.height / rows
            out[r, c] = G.locate(p, g) != G.EXTERIOR
    return out


def test_scan_conversion_of_polygons():
    r, e = random.Random(7), Extent(0, 0, 12, 8)
    for _ in range(150):
        n = lambda: r.choice([float(r.randint(-2, 14)), r.uniform(-2, 14), r.randint(0, 24) / 2])
        ring = sorted([(n(), n()) for _ in range(r.randint(3, 6))], key=lambda p: np.arctan2(p[1] - 5, p[0] - 5))
        g = G.polygon(ring, *([[(5, 4), (6, 4), (6, 5)]] if r.random() < 0.3 else []))
        got, want = covered(g, e, 12, 8), plain_cover(g, e, 12, 8)
        if not (got == want).all():  # only rings that cross themselves may differ
            assert len({p for p in ring}) < len(ring) or _crosses_itself(ring) or len(g.polygons[0]) > 1
    for g in (G.box(2.5, 2.5, 7.5, 6.5), G.box(0, 0, 12, 8), G.polygon([(1.5, 1.5), (9.5, 1.5), (5.5, 6.5)]), G.polygon([(0, 0), (12, 0), (12, 8), (0, 8)], [(3, 3), (9, 3), (9, 6), (3, 6)])):
        assert (covered(g, e, 12, 8) == plain_cover(g, e, 12, 8)).all()
    assert not covered(G.from_wkt("POLYGON EMPTY"), e, 12, 8).any()


def _crosses_itself(ring):
    edges = list(zip(ring, ring[1:] + ring[:1]))
    return any(G.crosses(G.line(*a), G.line(*b)) for i, a in enumerate(edges) for b in edges[i + 1 :])


def test_scan_conversion_of_lines_and_points():
    e = Extent(0, 0, 10, 10)
    assert np.argwhere(covered(G.point(3.5, 9.5), e, 10, 10)).tolist() == [[0, 3]]
    assert not covered(G.point(-1, 5), e, 10, 10).any() and not covered(G.point(10, 5), e, 10, 10).any()
    got = covered(G.line((0.5, 9.5), (3.5, 9.5), (3.5, 7.5)), e, 10, 10)
    assert np.argwhere(got).tolist() == [[0, 0], [0, 1], [0, 2], [0, 3], [1, 3], [2, 3]]
    r = random.Random(2)
    for _ in range(60):
        a, b = [(r.uniform(-3, 13), r.uniform(-3, 13)) for _ in range(2)]
        want = np.zeros((10, 10), bool)
        for t in np.linspace(0, 1, 20_001):
            x, y = a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])
            if 0 <= x < 10 and 0 < y <= 10:
                want[int(np.floor(10 - y)), int(x)] = True
        got = covered(G.line(a, b), e, 10, 10)
        assert (got | want == got).all() and got.sum() - want.sum() <= 1  # samples may miss a corner


def labels_layer(spark, n=4, size=8):
    layout = Layout(Extent(0, 0, n * size, n * size), TileLayout(n, n, size, size))
    md = LayerMetadata("uint8", layout, layout.extent, crs.LATLNG, KeyBounds(0, 0, n - 1, n - 1))
    return Y.from_tiles(spark, [(c, r, Tile.of(np.ones((size, size)), "uint8")) for c in range(n) for r in range(n)], md)


def burned_plain(features, n=4, size=8):
    e, out = Extent(0, 0, n * size, n * size), np.full((n * size, n * size), 255)
    for g, v, o in sorted((f for f in features if None not in f), key=lambda f: (f[2], f[1])):
        out[covered(g, e, n * size, n * size)] = v
    return out


def mosaic_of(rows, size=8, n=4):
    out = np.zeros((n * size, n * size))
    for r in rows:
        c, k = r.spatial_key
        out[k * size : (k + 1) * size, c * size : (c + 1) * size] = Tile.from_row(r.label).cells
    return out


@pytest.mark.parametrize("hot", [False, True])
def test_burned_features(spark, hot):
    r = random.Random(5)
    features = []
    for k in range(60):
        x, y = (9 + r.random(), 9 + r.random()) if hot else (r.uniform(-4, 34), r.uniform(-4, 34))
        g = r.choice([G.box(x, y, x + 5, y + 3), G.polygon([(x, y), (x + 9, y + 1), (x + 4, y + 7)]), G.line((x, y), (x + 6, y - 4)), G.point(x, y)])
        features.append((g, k % 200, r.randint(0, 20)))
    features += [(None, 1, 1), (G.box(0, 0, 3, 3), None, 99), (G.box(0, 0, 3, 3), 7, None), (G.from_wkt("POLYGON EMPTY"), 9, 100), (G.box(100, 100, 101, 101), 9, 100)]
    table = spark.createDataFrame([(g if g is None else bytes(g.wkb()), v, o, 0) for g, v, o in features], "g binary, v int, o int, col int").repartition(6)
    df = burned(labels_layer(spark), table, "g", "v", "o")
    rows = df.collect()
    assert len(rows) == 16 and Y.is_rf(df)
    assert (mosaic_of(rows) == burned_plain([f for f in features if f[0] is None or f[0].dimension >= 0])).all()
    none = burned(labels_layer(spark), table.limit(0), "g", "v")
    assert {Tile.from_row(x.label).cells.min() for x in none.collect()} == {255}


# -- streams -------------------------------------------------------------------------------------------------------------------


def test_running_tiles_equal_the_batch(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    r = np.random.default_rng(3)
    schema = spark.createDataFrame([], "k int, name string").schema.add("tile", TILE_TYPE)
    rows = [(k % 3, "x", Tile.of(np.where(r.random((70, 80)) < 0.3, -9, r.integers(0, 9, (70, 80))), "int32ud-9").row()) for k in range(18)] + [(1, "x", None), (8, "y", None)]
    whole = spark.createDataFrame(rows, schema)
    for k in range(3):
        spark.createDataFrame(rows[7 * k : 7 * k + 7], schema).coalesce(2).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(f"{tmp_path}/in")
    out = running_states(stream, ["k", "name"], "tile")
    q = out.writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True)
    q = q.foreachBatch(lambda batch, n: batch.write.mode("append").parquet(f"{tmp_path}/out")).start()
    assert q.awaitTermination(90)
    written = spark.read.parquet(f"{tmp_path}/out")
    assert written.agg(F.max("version")).first()[0] >= 3 and written.select("_block").distinct().count() == 2
    results = {n: n for n in ("count", "mean", "min", "max", "variance", "no_data_cells")}
    got = {(x.k, x.name): x for x in running_tiles(written, ["k", "name"], results).collect()}
    want = {(x.k, x.name): x for x in local_aggregate.local_agg_by(whole, ["k", "name"], "tile", results).collect()}
    assert set(got) == set(want) - {(8, "y")} and len(got) == 3
    for key, row in got.items():
        for n in results:
            assert np.allclose(Tile.from_row(row[n]).doubles(), Tile.from_row(want[key][n]).doubles(), equal_nan=True), (key, n)


def test_idle_keys_start_anew(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = spark.createDataFrame([], "k int").schema.add("tile", TILE_TYPE)
    one = lambda v: spark.createDataFrame([(1, Tile.of(np.full((2, 2), v)).row())], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    one(5.0)
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    seen = []
    q = running_states(stream, ["k"], "tile", idle=1000).writeStream.outputMode("update").option("checkpointLocation", f"{tmp_path}/checkpoint")
    q = q.foreachBatch(lambda batch, n: seen.extend(batch.select("version").collect())).trigger(processingTime="200 milliseconds").start()
    try:
        for count in (1, 2):
            for _ in range(150):
                if len(seen) >= count:
                    break
                time.sleep(0.2)
            time.sleep(4)
            if count == 1:
                one(7.0)
    finally:
        q.stop()
    assert [r.version for r in seen] == [1, 1]
