import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import celltype
from rasterloom.functions import aggregate as A
from rasterloom.functions import local_aggregate as L
from rasterloom.functions import payload as P
from rasterloom.functions import scalar as S
from rasterloom.functions.explode import explode_tile_sample, explode_tiles
from rasterloom.tile import TILE_TYPE, Tile, is_tile

NUMERIC = [n for n in celltype.names() if n != "bool"]


def tiles(spark, *columns, keys=None):
    names = "abcd"[: len(columns)]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("k", T.LongType()), *(T.StructField(n, TILE_TYPE) for n in names)])
    rows = [(i, keys[i] if keys else 0, *(None if t is None else t.row() for t in row)) for i, row in enumerate(zip(*columns))]
    return spark.createDataFrame(rows, schema)


def read(row):
    return Tile.from_row(row)


# -- cell types ------------------------------------------------------------------------------------------------------------


def test_names_round_trip():
    assert len(celltype.names()) == 15
    for n in [*celltype.names(), "uint16ud255", "float32ud-9999.0", "int8ud3"]:
        assert celltype.parse(n).name == n
    for n in ("int64", "boolraw", "uint9", ""):
        with pytest.raises(ValueError):
            celltype.parse(n)


def test_unions():
    u = lambda a, b: celltype.union(celltype.parse(a), celltype.parse(b)).name
    assert u("int8", "int16") == "int16"
    assert u("float32", "int32") == u("int32", "float32") == "float32"
    assert u("uint8", "int8") == "uint8"


@pytest.mark.parametrize("name", celltype.names())
def test_codec_round_trip(name):
    ct, r = celltype.parse(name), np.random.default_rng(3)
    for rows, cols in ((2, 2), (2, 64), (128, 3), (7, 5)):
        cells = r.integers(0, 2 if name == "bool" else 100, (rows, cols)).astype(ct.native)
        t = Tile(ct, cells)
        back = Tile.from_row(dict(zip(("cellType", "cols", "rows", "data"), t.row())))
        assert back.cell_type == ct and (back.cells == cells).all()


def test_int_payload_is_big_endian_and_bool_is_lowest_bit_first():
    assert Tile.of([[1, 258]], "int16raw").row()[3] == b"\x00\x01\x01\x02"
    assert Tile.of([[1, 0, 0, 0, 0, 0, 0, 0, 1]], "bool").row()[3] == b"\x01\x01"


def test_tile_columns_are_recognised():
    assert is_tile(TILE_TYPE)
    assert not is_tile(T.StructType(TILE_TYPE.fields[:3]))


# -- scalar functions ------------------------------------------------------------------------------------------------------


def test_null_contract(spark):
    df = tiles(spark, [None, Tile.of(np.zeros((2, 2)), "uint8")])
    r = df.select(
        S.tile_mean("a").alias("mean"), S.tile_sum("a").alias("sum"), S.tile_min("a").alias("min"), S.tile_max("a").alias("max"), S.data_cells("a").alias("data"),
        S.no_data_cells("a").alias("none"), S.tile_stats("a").alias("stats"), S.tile_dimensions("a").alias("dim"), S.tile_to_double_array("a").alias("arr"), S.render_ascii("a").alias("art"),
    ).orderBy(F.col("dim").isNull().desc()).collect()
    null, empty = r
    assert all(math.isnan(null[k]) for k in ("mean", "sum", "min", "max"))
    assert (null.data, null.none) == (0, 0)
    assert all(null[k] is None for k in ("stats", "dim", "arr", "art"))
    assert math.isnan(empty.mean) and empty["sum"] == 0 and math.isnan(empty["min"]) and (empty.data, empty.none) == (0, 4)
    assert empty.stats is None and tuple(empty.dim) == (2, 2) and all(map(math.isnan, empty.arr))


@pytest.mark.parametrize("name", ["int8", "uint8", "int16", "uint16ud255", "int32", "float32", "float64ud-1.0", "uint8raw", "float64raw"])
def test_statistics_equal_numpy(spark, name):
    ct, r = celltype.parse(name), np.random.default_rng(5)
    values = [np.where(r.random((6, 4)) < 0.2, np.nan, r.integers(1, 90, (6, 4))) for _ in range(8)]
    ts = [Tile(ct, ct.from_doubles(v)) for v in values]
    got = tiles(spark, ts).select("id", S.tile_mean("a").alias("m"), S.tile_sum("a").alias("s"), S.tile_min("a").alias("lo"), S.tile_max("a").alias("hi"), S.data_cells("a").alias("n"), S.tile_stats("a").alias("st")).collect()
    for row in got:
        x = ts[row.id].doubles()
        d = x[~np.isnan(x)]
        assert (row.n, row.st.dataCells) == (len(d), len(d))
        assert np.allclose([row.m, row.s, row.lo, row.hi, row.st.variance], [d.mean(), d.sum(), d.min(), d.max(), d.var()])


def test_algebra(spark):
    a, b = np.array([[1, 0, 7], [9, 200, 4]]), np.array([[2, 5, 0], [3, 100, 8]])
    df = tiles(spark, [Tile.of(a, "uint8"), None, Tile.of(a, "uint8")], [Tile.of(b, "uint8"), Tile.of(b, "uint8"), Tile.of(b, "float32")])
    r = df.orderBy("id").select(S.local_add("a", "b").alias("add"), S.local_subtract("a", "b").alias("sub"), S.local_multiply("a", "b").alias("mul"), S.local_divide("a", "b").alias("div"), S.normalized_difference("a", "b").alias("nd"), S.local_algebra(np.hypot, "a", "b").alias("h")).collect()
    add = read(r[0].add)
    assert add.cell_type.name == "uint8"
    assert add.cells.tolist() == [[3, 0, 0], [12, 44, 12]]  # NoData poisons, sums wrap
    assert read(r[0]["div"]).cells.tolist() == [[0, 0, 0], [3, 2, 0]]
    assert all(c is None for c in r[1])
    mixed = read(r[2]["div"])
    assert mixed.cell_type.name == "float32" and np.allclose(mixed.doubles(), [[0.5, np.nan, np.inf], [3, 2, 0.5]], equal_nan=True)
    assert np.isclose(read(r[2].nd).cells[0, 0], (1 - 2) / 3)
    assert "add(a, b)" in df.select(S.local_add("a", "b")).columns


def test_sizes_have_to_agree(spark):
    df = tiles(spark, [Tile.of(np.ones((2, 2)))], [Tile.of(np.ones((2, 3)))])
    with pytest.raises(Exception, match="different sizes"):
        df.select(S.local_add("a", "b")).collect()
    with pytest.raises(Exception, match="different sizes"):
        explode_tiles(df, "a", "b").collect()


def test_conversions(spark):
    df = tiles(spark, [Tile.of([[0, 1], [254, 3]], "uint8")])
    r = df.select(S.convert_cell_type("a", "int16").alias("c"), S.with_no_data("a", 3).alias("n"), S.tile_to_int_array("a").alias("i"), S.tile_to_array("a", "byte").alias("b"), S.cell_type("a").alias("t"), S.cell_types().alias("all")).first()
    assert read(r.c).cells.tolist() == [[-32768, 1], [254, 3]]
    assert r.n.cellType == "uint8ud3" and np.isnan(read(r.n).doubles()).tolist() == [[False, False], [False, True]]
    assert r.i == [-2147483648, 1, 254, 3] and r.b == [-128, 1, -2, 3]
    assert r.t == "uint8" and r["all"] == celltype.names()


def test_arrays_to_tiles(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],), (None,)], "x array<double>")
    got = df.select(S.array_to_tile("x", 2, 2).alias("t")).collect()
    assert read(got[0].t).cell_type.name == "float64raw" and read(got[0].t).cells.tolist() == [[1, 2], [3, 4]]
    assert got[1].t is None and got[2].t is None
    with pytest.raises(Exception, match="elements"):
        df.select(S.array_to_tile("x", 3, 2)).collect()


def test_constant_tiles_expand(spark):
    r = spark.range(1).select(S.make_constant_tile(7, 3, 2, "int16").alias("t"), S.make_constant_tile(1, 3, 3, "bool").alias("b"))
    assert len(r.first().t.data) == 2 and read(r.first().t).cells.tolist() == [[7] * 3] * 2
    assert r.select(S.tile_sum("t"), S.tile_sum("b")).first()[:] == (42.0, 9.0)


def test_histograms(spark):
    r = np.random.default_rng(2)
    few, many = r.integers(1, 9, (20, 20)), r.normal(size=(40, 40))
    got = tiles(spark, [Tile.of(few, "int32"), Tile.of(many, "float64")]).orderBy("id").select(S.tile_histogram("a").alias("h")).collect()
    assert {b.value: b["count"] for b in got[0].h.bins} == dict(zip(*[x.tolist() for x in np.unique(few.astype(float), return_counts=True)]))
    assert len(got[1].h.bins) == 80 and sum(b["count"] for b in got[1].h.bins) == 1600
    assert np.isclose(got[1].h.stats.mean, many.mean())


# -- aggregates ------------------------------------------------------------------------------------------------------------


def sample(spark, n=30, missing=(0, 10, 28)):
    r = np.random.default_rng(9)
    ts = [None if i in missing else Tile.of(np.where(r.random((10, 10)) < 0.1, 0, r.integers(1, 200, (10, 10))), "uint8") for i in range(n)]
    return ts, tiles(spark, ts, keys=[i % 3 for i in range(n)])


def test_aggregates_equal_plain_ones_over_cells(spark):
    ts, df = sample(spark)
    cells = explode_tiles(df, "a").where(~F.isnan("a")).groupBy("k").agg(F.count("a").alias("n"), F.avg("a").alias("m"), F.var_pop("a").alias("v"), F.min("a").alias("lo"), F.max("a").alias("hi"))
    want = {r.k: r for r in cells.collect()}
    got = df.groupBy("k").agg(A.agg_stats("a").alias("s"), A.agg_mean("a").alias("m"), A.agg_data_cells("a").alias("d"), A.agg_no_data_cells("a").alias("x"), A.agg_histogram("a").alias("h")).collect()
    assert len(got) == 3
    for r in got:
        w = want[r.k]
        own = [t for i, t in enumerate(ts) if i % 3 == r.k and t is not None]
        assert (r.s.dataCells, r.d, r.x) == (w.n, w.n, 100 * len(own) - w.n)
        assert np.allclose([r.s.mean, r.m, r.s.variance, r.s.min, r.s.max], [w.m, w.m, w.v, w.lo, w.hi])
        assert sum(b["count"] for b in r.h.bins) == w.n
    partials = {r.k: r.histogram for r in A.histogram_by(df, ["k"], "a").collect()}
    assert all(partials[r.k].stats.dataCells == r.h.stats.dataCells for r in got)


def test_aggregates_without_data(spark):
    r = tiles(spark, [None, None]).agg(A.agg_stats("a").alias("s"), A.agg_mean("a").alias("m"), A.agg_data_cells("a").alias("d")).first()
    assert r.s.dataCells == 0 and r.s.min is None and math.isnan(r.s.mean) and r.m is None and r.d == 0


def test_aggregates_are_partial(spark):
    _, df = sample(spark)
    plan = df.groupBy("k").agg(A.agg_stats("a"))._jdf.queryExecution().toString()
    assert "partial_sum" in plan and "ArrowAggregate" not in plan


def test_local_aggregates(spark):
    full = np.arange(1, 17).reshape(4, 4)
    holes = full.copy()
    holes[0, 0] = holes[2, 3] = -2147483648
    df = tiles(spark, [*[Tile.of(full, "int32")] * 20, Tile.of(holes, "int32"), None])
    plain = df.agg(L.local_agg_stats("a").alias("s"), L.local_agg_max("a").alias("mx"), L.local_agg_min("a").alias("mn"), L.local_agg_mean("a").alias("me"), L.local_agg_data_cells("a").alias("n"), L.local_agg_no_data_cells("a").alias("x")).first()
    phased = L.local_agg_stats_by(df, [], "a", "s").first().s
    names = {"mx": "plain_max", "mn": "plain_min", "n": "data_cells", "x": "no_data_cells"}
    direct = L.local_agg_by(df, ["k"], "a", names).first()
    for s in (plain.s, phased):
        assert read(s["count"]).cells.sum() == 20 * 16 + 14
        assert np.allclose(read(s["mean"]).cells, full) and np.allclose(read(s.min).cells, full) and np.allclose(read(s.variance).cells, 0)
    assert np.isnan(read(plain.mx).doubles()).sum() == np.isnan(read(plain.mn).doubles()).sum() == 2
    assert read(plain.n).cells.tolist() == read(plain.s["count"]).cells.tolist() and read(plain.x).cells.sum() == 2
    for k in names:
        assert (read(direct[k]).cells == read(plain[k]).cells).all()


def test_local_aggregates_of_nothing(spark):
    df = tiles(spark, [None, None])
    assert L.local_agg_stats_by(df, ["k"], "a", "s").first().s is None
    assert df.agg(L.local_agg_stats("a").alias("s"), L.local_agg_mean("a").alias("m")).first()[:] == (None, None)


def test_local_aggregates_of_different_sizes_fail(spark):
    df = tiles(spark, [Tile.of(np.ones((2, 2))), Tile.of(np.ones((3, 3)))])
    with pytest.raises(Exception, match="different sizes"):
        L.local_agg_stats_by(df, ["k"], "a").collect()


def test_biased_operations():
    a, b = np.array([1, np.nan, 3]), np.array([np.nan, np.nan, 5])
    assert np.array_equal(L.biased_add(a, b), [1, np.nan, 8], equal_nan=True)
    assert np.array_equal(L.biased_min(a, b), [1, np.nan, 3], equal_nan=True)
    assert np.array_equal(L.biased_max(a, b), [1, np.nan, 5], equal_nan=True)


# -- explode and assemble --------------------------------------------------------------------------------------------------


def test_explode_two_tiles(spark):
    df = tiles(spark, [Tile.of(np.full((10, 10), 1), "int8raw")], [Tile.of(np.full((10, 10), 2), "int8raw")])
    rows = explode_tiles(df, "a", "b").collect()
    assert len(rows) == 100 and all((r.a, r.b) == (1.0, 2.0) for r in rows)
    assert {(r.column_index, r.row_index) for r in rows} == {(c, r) for c in range(10) for r in range(10)}


def test_explode_with_nulls(spark):
    five = Tile.of(np.full((3, 3), 5), "int8")
    df = tiles(spark, [five, None, five, None], [None, five, five, None])
    assert explode_tiles(df.drop("b"), "a").count() == 18
    both = explode_tiles(df, "a", "b").collect()
    assert len(both) == 27 and sum(math.isnan(r.a) for r in both) == 9


def test_user_nodata_explodes_as_nan(spark):
    df = tiles(spark, [Tile.of(np.arange(1, 10).reshape(3, 3), "uint16ud5")])
    assert sum(math.isnan(r.a) for r in explode_tiles(df, "a").collect()) == 1


def test_samples_are_joint(spark):
    a = np.arange(100).reshape(10, 10)
    df = tiles(spark, [Tile.of(a, "int16raw"), None], [Tile.of(a * 2, "int16raw"), None])
    rows = explode_tile_sample(df, 0.25, "a", "b", seed=1).collect()
    assert len(rows) == 25 and all(r.b == 2 * r.a and r.a == r.row_index * 10 + r.column_index for r in rows)


def test_assemble(spark):
    r = np.random.default_rng(4)
    a = np.where(r.random((6, 7)) < 0.2, np.nan, r.normal(size=(6, 7)))
    df = tiles(spark, [Tile.of(a, "float64")])
    back = explode_tiles(df, "a", keep=["id"]).groupBy("id").agg(A.assemble_tile("column_index", "row_index", "a", 7, 6, "float64").alias("t")).first()
    assert np.array_equal(read(back.t).cells, a, equal_nan=True)
    with pytest.raises(Exception, match="outside"):
        explode_tiles(df, "a", keep=["id"]).groupBy("id").agg(A.assemble_tile("column_index", "row_index", "a", 5, 6, "float64")).collect()
    part = spark.createDataFrame([(0, 0, 4.0), (1, 1, None)], "c int, r int, v double").agg(A.assemble_tile("c", "r", "v", 2, 2, "uint8").alias("t")).first()
    assert read(part.t).cells.tolist() == [[4, 0], [0, 0]]


# -- payloads ----------------------------------------------------------------------------------------------------------------


def test_merge_crop_and_masks(spark):
    a, b = np.array([[1, 0], [3, 0]]), np.array([[9, 8], [0, 7]])
    df = tiles(spark, [Tile.of(a, "uint8")], [Tile.of(b, "uint8")])
    r = df.select(P.merge_tiles("a", "b").alias("m"), P.crop_tile("b", 1, 0, 5, 0).alias("c"), P.local_mask("a", "b", 9, 5).alias("k"), P.local_inverse_mask("a", "b", 9, float("nan")).alias("i"), P.prototype_tile("int16", 2, 2).alias("p")).first()
    assert read(r.m).cells.tolist() == [[1, 8], [3, 7]]
    assert read(r.c).cells.tolist() == [[8]]
    assert read(r.k).cells.tolist() == [[5, 0], [3, 0]]
    assert read(r.i).cells.tolist() == [[1, 0], [0, 0]]
    assert np.isnan(read(r.p).doubles()).all()


def test_merge_and_crop_by_extent(spark):
    from rasterloom.operators.metadata import Extent

    box = lambda *v: F.struct(*[F.lit(float(x)).alias(n) for n, x in zip(("xmin", "ymin", "xmax", "ymax"), v)])
    left, right = np.array([[1.0, np.nan], [np.nan, 4]]), np.array([[10.0, 20], [30, 40]])
    df = tiles(spark, [Tile.of(left, "float64"), None], [Tile.of(right, "float64"), Tile.of(right, "float64")])
    r = df.orderBy("id").select(P.merge_by_extent("a", box(0, 0, 2, 2), "b", box(1, 0, 3, 2)).alias("m"), P.crop_by_extent("b", box(0, 0, 2, 2), Extent(0.5, 1.2, 1, 5)).alias("c"), P.crop_by_extent("b", box(0, 0, 2, 2), Extent(7, 7, 8, 8)).alias("n")).collect()
    assert np.array_equal(read(r[0].m).cells, [[1, 10], [np.nan, 4]], equal_nan=True)
    assert read(r[0].c).cells.tolist() == [[10]] and r[0].n is None and r[1].m is None


def test_payloads_merge_by_type(spark):
    df = spark.createDataFrame([("x", "y", [1], [1, 2], {"a": "p"}, {"a": "q", "b": "r"}), ("", "y", None, [2], {}, None)], "s string, t string, l array<int>, m array<int>, u map<string,string>, v map<string,string>")
    k = df.schema
    r = df.select(P.merge_data(df.s, df.t, k["s"].dataType).alias("s"), P.merge_data(df.l, df.m, k["l"].dataType).alias("l"), P.merge_data(df.u, df.v, k["u"].dataType).alias("u"), P.merge_sets(df.l, df.m).alias("e")).collect()
    assert (r[0].s, r[0].l, r[0].u, sorted(r[0].e)) == ("x, y", [1, 1, 2], {"a": "p, q", "b": "r"}, [1, 2])
    assert (r[1].s, r[1].l, r[1].u) == ("y", [2], {})


def test_camel_case_functions(spark):
    from rasterloom import rasterfunctions as R

    a = np.arange(12).reshape(3, 4)
    df = tiles(spark, [Tile.of(a, "int16raw"), None], [Tile.of(a + 1, "int16raw"), None])
    rows = df.select("id", R.explodeTiles("a", F.col("b"))).collect()
    assert len(rows) == 12 and all((r.b, r.a) == (r.a + 1, 4 * r.row_index + r.column_index) for r in rows)
    assert df.select(R.explodeTileSample(0.5, "a", seed=2)).count() == 6
    got = df.agg(R.aggMean("a").alias("m"), R.aggDataCells("a").alias("n")).first()
    assert (got.m, got.n) == (5.5, 12)
