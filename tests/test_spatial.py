"""Joins of geometries, Z curves and layer files read by intervals of them, cell-wise aggregates in blocks."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_layers import WORLD, keyed

from rasterloom import crs, geometry as G
from rasterloom.functions import aggregate, local_aggregate
from rasterloom.operators import layer as Y
from rasterloom.operators import spatial
from rasterloom.operators.metadata import KeyBounds, LayerMetadata, Layout, TileLayout
from rasterloom.plans import zcurve
from rasterloom.sources import layers
from rasterloom.tile import TILE_TYPE, Tile

# -- predicates without parsing ------------------------------------------------------------------------------------------------


def some_geometries():
    r = random.Random(4)
    n = lambda: float(r.randint(0, 6))
    out = [G.point(n(), n()) for _ in range(12)]
    for _ in range(14):
        x, y = n(), n()
        out.append(G.box(x, y, x + r.randint(1, 4), y + r.randint(1, 4)))
    out += [G.line((0, 0), (3, 3)), G.line((1, 5), (6, 5), (6, 1)), G.polygon([(0, 0), (6, 0), (3, 5)]), G.polygon([(0, 0), (6, 0), (6, 6), (0, 6)], [(2, 2), (4, 2), (4, 4), (2, 4)])]
    out += [G.collection(G.point(1, 1), G.point(2, 5), kind="MultiPoint"), G.from_wkt("POLYGON EMPTY"), G.from_wkt("POINT EMPTY"), G.from_wkt("POLYGON ((1 1, 3 1, 3 4, 1 4, 1 1))")]
    return out


@pytest.mark.parametrize("name", sorted(G.PREDICATES))
def test_predicates_of_columns_equal_those_of_geometries(spark, name):
    shapes = some_geometries()
    pairs = [(i, j, bytes(a.wkb()), bytes(b.wkb())) for i, a in enumerate(shapes) for j, b in enumerate(shapes)]
    df = spark.createDataFrame([*pairs, (-1, -1, None, pairs[0][2])], "i int, j int, a binary, b binary")
    got = {(r.i, r.j): r.v for r in df.select("i", "j", G.UDF_PREDICATES[name]("a", "b").alias("v")).collect()}
    assert got.pop((-1, -1)) is None
    for (i, j), v in got.items():
        assert v == G.PREDICATES[name](shapes[i], shapes[j]), (name, G.to_wkt(shapes[i]), G.to_wkt(shapes[j]))


def test_boxes(spark):
    shapes = some_geometries()
    df = spark.createDataFrame([(i, bytes(g.wkb())) for i, g in enumerate(shapes)] + [(99, None)], "i int, g binary")
    for r in df.select("i", G.box2d("g").alias("b")).collect():
        if r.i == 99 or shapes[r.i].dimension < 0:
            assert r.b is None
        else:
            assert tuple(r.b) == shapes[r.i].box()


# -- joins ---------------------------------------------------------------------------------------------------------------------


def random_shapes(r, n, span):
    out = []
    for _ in range(n):
        x, y, s = r.uniform(-span, span), r.uniform(-span, span), r.choice([0.1, 1, 1, 3, span])
        out.append(r.choice([lambda: G.point(x, y), lambda: G.box(x, y, x + s, y + s / 2), lambda: G.line((x, y), (x + s, y + s)), lambda: G.polygon([(x, y), (x + s, y), (x + s / 2, y + s)])])())
    return out


def joined(spark, left, right, predicate):
    frame = lambda gs, n: spark.createDataFrame([(i, g if g is None else bytes(g.wkb()), 0) for i, g in enumerate(gs)], f"{n} int, {n}_g binary, _left_box int")
    out = spatial.geometry_join(frame(left, "l"), frame(right, "r"), "l_g", "r_g", predicate)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    return sorted((r.l, r.r) for r in out.select("l", "r").collect())


@pytest.mark.parametrize("predicate", ["intersects", "contains", "within", "touches"])
def test_geometry_join_equals_all_pairs(spark, predicate, monkeypatch):
    monkeypatch.setattr(spatial, "LEAF", 4)
    r = random.Random(8)
    left, right = random_shapes(r, 90, 20), random_shapes(r, 70, 20)
    left += [G.box(-1, -1, 1, 1), G.box(1, 1, 2, 2), G.box(0, 0, 3, 3), None, G.from_wkt("POLYGON EMPTY")]
    right += [G.box(0, 0, 3, 3), G.box(1, 1, 2, 2), G.point(1, 1), None, G.from_wkt("LINESTRING EMPTY")]
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and G.PREDICATES[predicate](a, b))
    assert want and joined(spark, left, right, predicate) == want


def test_geometry_join_of_hot_places(spark, monkeypatch):
    """A third of both sides at one place: the leaf is cut by salt."""
    monkeypatch.setattr(spatial, "LEAF", 4)
    monkeypatch.setattr(spatial, "HOT", 10)
    r = random.Random(3)
    left, right = random_shapes(r, 60, 10) + [G.box(2, 2, 3, 3)] * 40, random_shapes(r, 40, 10) + [G.point(2.5, 2.5)] * 25
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if G.intersects(a, b))
    assert joined(spark, left, right, "intersects") == want
    boxes = lambda gs: np.array([g.box() for g in gs])
    tree = spatial.grow(boxes(left), boxes(right), len(left), len(right))
    assert tree.left_parts.max() > 1 and ((tree.left_parts == 1) | (tree.right_parts == 1)).all()


def test_geometry_join_edges(spark):
    assert joined(spark, [None], [None], "intersects") == []
    assert joined(spark, [G.point(1, 1)], [G.from_wkt("POINT EMPTY")], "intersects") == []
    assert joined(spark, [G.point(1, 1)] * 3, [G.point(1, 1)] * 2, "intersects") == [(i, j) for i in range(3) for j in range(2)]
    with pytest.raises(ValueError):
        spatial.geometry_join(spark.range(1), spark.range(1), "id", "id", "disjoint")


def test_tree_covers_the_plane():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, 2))
    boxes = np.column_stack([x[:, 0], x[:, 0], x[:, 1], x[:, 1]])
    tree = spatial.grow(boxes, boxes[:9], 500, 9)
    far = np.vstack([boxes, [[1e9, 1e9, -1e9, -1e9]], [[-np.inf, -np.inf, 0, 0]]])
    row, node = tree.touched(far)
    assert row.tolist() == list(range(len(far)))  # a point is in one leaf
    assert (tree.child[node] < 0).all() and len(np.unique(node)) > 5
    row, node = tree.touched(np.array([[-1e9, 1e9, -1e9, 1e9]]))
    assert sorted(tree.leaf[node]) == list(range(tree.leaf.max() + 1))


# -- Z curves ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("dims", [2, 3])
def test_interleave(spark, dims):
    r, top = random.Random(dims), (1 << zcurve.BITS[dims]) - 1
    rows = [tuple(r.choice([0, 1, top, r.randint(0, top)]) for _ in range(dims)) for _ in range(60)] + [(-5,) * dims, (top + 7,) * dims]
    got = spark.createDataFrame(rows, ", ".join(f"c{k} long" for k in range(dims))).select(zcurve.interleave(*[F.col(f"c{k}") for k in range(dims)]).alias("z")).collect()
    for row, z in zip(rows, got):
        own = [max(0, min(top, v)) for v in row]
        assert z.z == zcurve.interleaved(*row) == int("".join(str(own[k] >> i & 1) for i in reversed(range(zcurve.BITS[dims])) for k in reversed(range(dims))), 2)


@pytest.mark.parametrize("dims", [2, 3])
@pytest.mark.parametrize("most", [1, 6, 64, 10_000])
def test_ranges_hold_the_box(dims, most):
    r = random.Random(most)
    for _ in range(12):
        low = tuple(r.randint(0, 11) for _ in range(dims))
        high = tuple(v + r.randint(0, 4) for v in low)
        found = zcurve.ranges(low, high, most)
        assert len(found) <= most and all(a <= b for a, b in found) and all(p[1] + 1 < q[0] for p, q in zip(found, found[1:]))
        box = {zcurve.interleaved(*c) for c in np.ndindex(*[16] * dims) if all(a <= v <= b for a, v, b in zip(low, c, high))}
        assert all(any(a <= z <= b for a, b in found) for z in box)
        if most == 10_000:
            assert sum(b - a + 1 for a, b in found) == len(box)
    assert zcurve.ranges((3,) * dims, (2,) * dims) == []


def scanned(df):
    """Rows that a plan's only scan gave, after what Parquet could skip."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    assert leaves.size() == 1
    return leaves.head().metrics().get("numOutputRows").get().value()


def big_layer(spark, side, days):
    layout = Layout(WORLD, TileLayout(side, side, 2, 2))
    start = 1_704_067_200_000
    md = LayerMetadata("int32raw", layout, WORLD, crs.LATLNG, KeyBounds(0, 0, side - 1, side - 1, *((start, start + (days - 1) * 86_400_000) if days else ())))
    n = F.col("id")
    df = spark.range(side * side * max(days, 1)).select(
        F.struct((n % side).cast("int").alias("col"), (F.floor(n / side) % side).cast("int").alias("row")).alias("spatial_key"),
        *([F.struct((F.floor(n / (side * side)) * 86_400_000 + start).alias("instant")).alias("temporal_key")] if days else []),
        F.lit(Tile.of(np.ones((2, 2)), "int32raw").row()[0]).alias("kind"), F.expr("named_struct('cellType', 'int32raw', 'cols', 2s, 'rows', 2s, 'data', X'00000001')").cast(TILE_TYPE).alias("tile"),
    )
    return Y.as_rf(df, "spatial_key", md, "temporal_key" if days else None)


def test_layer_files_skip_row_groups(spark, tmp_path):
    at = layers.Layer(str(tmp_path), "plain", 1)
    layers.write_layer(big_layer(spark, 64, 0), at, partitions=16)
    area = G.box(-170, 60, -150, 80)
    near = layers.read_layer(spark, at, where=area, bounds=False)
    inside = [(c, r) for c in range(64) for r in range(64) if -180 + c * 5.625 <= -150 and -180 + (c + 1) * 5.625 >= -170 and 90 - (r + 1) * 2.8125 <= 80 and 90 - r * 2.8125 >= 60]
    assert sorted((r.spatial_key.col, r.spatial_key.row) for r in near.collect()) == sorted(inside)
    assert scanned(near.select("spatial_key")) <= 64 * 64 // 8  # two of sixteen row groups at most
    assert scanned(layers.read_layer(spark, at, bounds=False).select("spatial_key")) == 64 * 64
    assert layers.read_layer(spark, at, where=G.point(500, 500), bounds=False).count() == 0


def test_space_time_files_skip_row_groups(spark, tmp_path):
    at = layers.Layer(str(tmp_path), "timed", 1)
    layers.write_layer(big_layer(spark, 16, 64), at, partitions=32)
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    some = layers.read_layer(spark, at, where=G.box(-179, 50, -100, 89), between=(day(3), day(6)), bounds=False)
    cells = [(c, r) for c in range(16) for r in range(16) if -180 + c * 22.5 <= -100 and 90 - (r + 1) * 11.25 <= 89 and 90 - r * 11.25 >= 50]
    assert some.count() == 4 * len(cells)
    assert scanned(some.select("spatial_key")) <= 16 * 16 * 64 // 4
    only_time = layers.read_layer(spark, at, between=(day(3), day(3)), bounds=False)
    assert only_time.count() == 256 and scanned(only_time.select("spatial_key")) < 16 * 16 * 64
    assert layers.read_layer(spark, at, between=(day(-9), day(-8)), bounds=False).count() == 0


def test_attributes_without_an_index_are_read(spark, tmp_path):
    at = layers.Layer(str(tmp_path), "old", 1)
    layers.write_layer(keyed(spark), at)
    said = spark.read.text(f"{at.path}/attributes").first()["value"].replace('"index"', '"other"')
    spark.createDataFrame([(said,)], "value string").coalesce(1).write.mode("append").text(f"{tmp_path}/again/old/1/attributes")
    layers.write_layer(keyed(spark), layers.Layer(f"{tmp_path}/again", "tiles", 1))
    moved = layers.Layer(f"{tmp_path}/again", "old", 1)
    spark.read.parquet(f"{at.path}/tiles").write.parquet(f"{moved.path}/tiles")
    assert layers.read_layer(spark, moved, where=G.box(-170, -80, 170, 80), bounds=False).count() == 16


# -- cell-wise aggregates in blocks ----------------------------------------------------------------------------------------------


def plain_aggregates(tiles):
    x = np.stack([np.where(t == -1, np.nan, t) for t in tiles])
    n = (~np.isnan(x)).sum(axis=0)
    with np.errstate(all="ignore"):
        mean = np.nansum(x, axis=0) / n
        return {"count": n, "mean": mean, "min": np.fmin.reduce(x), "max": np.fmax.reduce(x), "variance": np.maximum(np.nansum(x * x, axis=0) / n - mean**2, 0), "no_data_cells": len(x) - n}


def test_local_aggregates_of_one_group_in_many_tasks(spark):
    """70 x 130 cells are three blocks; 40 tasks are more than parts."""
    r = np.random.default_rng(6)
    tiles = [np.where(r.random((130, 70)) < 0.2, -1.0, r.integers(0, 50, (130, 70))).astype("int32") for _ in range(50)]
    df = spark.createDataFrame([(k % 2, Tile.of(t, "int32ud-1").row()) for k, t in enumerate(tiles)] + [(0, None), (7, None)], spark.createDataFrame([], "k int").schema.add("tile", TILE_TYPE)).repartition(40)
    names = ["count", "mean", "min", "max", "variance", "no_data_cells"]
    for keys in ([], ["k"]):
        rows = local_aggregate.local_agg_by(df, keys, "tile", {n: n for n in names}).collect()
        assert len(rows) == (3 if keys else 1)
        for row in rows:
            if keys and row.k == 7:
                assert all(row[n] is None for n in names)
                continue
            want = plain_aggregates(tiles[row.k :: 2] if keys else tiles)
            for n in names:
                got = Tile.from_row(row[n]).doubles()
                assert got.shape == (130, 70) and np.allclose(got, want[n], equal_nan=True), n


def test_local_aggregates_read_bounded_parts(spark):
    """In no exchange does one task get the states of all tasks of a group."""
    tile = Tile.of(np.ones((64, 64)), "float64").row()
    df = spark.createDataFrame([(tile,)] * 64, spark.createDataFrame([], "k int").select().schema.add("tile", TILE_TYPE)).repartition(64)
    folded = local_aggregate.local_agg_by(df, [], "tile", {"n": "count"})
    plan = folded._jdf.queryExecution().executedPlan().toString()
    assert "_block" in plan and "_part" in plan and Tile.from_row(folded.first().n).cells.min() == 64


def test_local_aggregates_refuse_other_sizes(spark):
    schema = spark.createDataFrame([], "k int").schema.add("tile", TILE_TYPE)
    df = spark.createDataFrame([(1, Tile.of(np.ones((2, 2))).row()), (1, Tile.of(np.ones((2, 3))).row())], schema).repartition(2)
    with pytest.raises(Exception, match="different sizes"):
        local_aggregate.local_agg_by(df, ["k"], "tile", {"n": "count"}).collect()
    assert local_aggregate.local_agg_by(df.limit(0), ["k"], "tile", {"n": "count"}).count() == 0


def test_histograms_merge_in_parts(spark):
    schema = spark.createDataFrame([], "k int").schema.add("tile", TILE_TYPE)
    rows = [(k % 3, Tile.of(np.full((2, 2), k % 7), "int32").row()) for k in range(200)] + [(5, None)]
    df = spark.createDataFrame(rows, schema).repartition(90)
    for r in aggregate.histogram_by(df, ["k"], "tile").collect():
        own = [k % 7 for k in range(200) if k % 3 == r.k]
        want = {float(v): 4 * own.count(v) for v in set(own)}
        assert {b["value"]: b["count"] for b in r.histogram["bins"]} == want
        assert (r.histogram["stats"] is None) == (r.k == 5)


@pytest.mark.parametrize("hot", [50_000, 10])
def test_geometry_join_asks_once_for_equal_geometries(spark, monkeypatch, hot):
    """200 x 90 rows of 4 x 3 geometries: the predicate sees pairs of geometries that differ, the result has all pairs of rows."""
    monkeypatch.setattr(spatial, "HOT", hot)
    asked = spark.sparkContext.accumulator(0)

    @F.arrow_udf("boolean")
    def counted(a, b):
        asked.add(len(a))
        return G.UDF_PREDICATES["intersects"].func(a, b)

    monkeypatch.setattr(spatial, "UDF_PREDICATES", {"intersects": counted})
    left = [G.box(i % 4, 0, i % 4 + 1.5, 1) for i in range(200)]
    right = [G.point(i % 3 + 0.75, 0.5) for i in range(90)]
    want = sorted((i, j) for i, a in enumerate(left) for j, b in enumerate(right) if G.intersects(a, b))
    assert joined(spark, left, right, "intersects") == want
    assert joined(spark, right, left, "intersects") == sorted((j, i) for i, j in want)
    assert 0 < asked.value <= 2 * 4 * 3


def test_aggregates_as_columns_gather_no_tiles(spark, tmp_path, monkeypatch):
    """The query folds tiles in each task; the column form, which gathers a group, holds few of them as doubles."""
    from rasterloom import queries

    rows = [(i, i % 2, [float((i * 7 + k) % 5) for k in range(64)]) for i in range(50)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    df = queries.local_agg_columns(spark, str(tmp_path))
    assert "collect_list" not in df._jdf.queryExecution().executedPlan().toString()
    got = {(r.label, r.row_index * 8 + r.column_index): r for r in df.collect()}
    for label in range(2):
        x = np.array([v for _, k, v in rows if k == label])
        for cell in range(64):
            own, data = got[label, cell], x[:, cell][x[:, cell] != 0]
            assert (own.n, own.missing) == (len(data), 25 - len(data))
            assert np.allclose((own.mean, own.variance), (data.mean(), data.var()), atol=1e-6)
            assert (own.lo, own.hi) == ((data.min(), data.max()) if len(data) == 25 else (None, None))
    sizes, fold = [], local_aggregate._fold
    monkeypatch.setattr(local_aggregate, "TILES", 10)
    monkeypatch.setattr(local_aggregate, "_fold", lambda tiles, *rest: (sizes.append(len(tiles)), fold(tiles, *rest)))
    import pyarrow as pa

    from rasterloom.tile import ARROW_TILE

    one = [dict(zip(("cellType", "cols", "rows", "data"), Tile.of(np.full((2, 2), float(i))).row())) for i in range(35)]
    lists = pa.array([one[:3], None, one[3:]], pa.list_(ARROW_TILE))
    means = [Tile.from_row(t) for t in local_aggregate.UDF_MERGED["mean"].func(lists).to_pylist()]
    assert max(sizes) == 10 and means[1] is None and [means[k].cells[0, 0] for k in (0, 2)] == [1.0, 18.5]
