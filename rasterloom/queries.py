"""Queries over the generated tables, one for each operator, with the same question in SQL where SQL can ask it.

``embeddings`` gives tiles of 8 x 8 cells (values within 0.01 of zero are taken as NoData), ``customer`` and ``supplier`` layers of
5 x 5 keys (the nation) with 4 x 4 cells, ``events`` space-time layers of one key for each hour and day.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom import crs, geometry, render, session, slippy
from rasterloom.celltype import names as cell_type_names
from rasterloom.functions import aggregate as A
from rasterloom.functions import local_aggregate as L
from rasterloom.functions import payload as P
from rasterloom.functions import scalar as S
from rasterloom.functions.explode import explode_tile_sample, explode_tiles
from rasterloom.ml import NoDataFilter, TileExploder
from rasterloom.operators import layer as Y
from rasterloom.operators.features import burned
from rasterloom.operators.metadata import Extent, KeyBounds, LayerMetadata, Layout, TileLayout
from rasterloom.operators.raster import to_raster, with_tile_subdivisions
from rasterloom.operators.spatial import geometry_join
from rasterloom.plans.pruning import join_points, where_contains, where_covers, where_intersects
from rasterloom.runtime import shared_folder
from rasterloom.sources import layers
from rasterloom.sources.geotiff import read_files, read_geotiff, write_geotiff

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

HOLE = 0.01
GRID = Layout(Extent(0, 0, 50, 50), TileLayout(5, 5, 4, 4))


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label and two bands: the vector with holes, and the vector without."""
    e = table(spark, sf_dir, "embeddings")
    holes = F.transform("embedding", lambda x: F.when(F.abs(x) < HOLE, F.lit(float("nan")).cast("float")).otherwise(x))
    return e.select("vec_id", "label", S.array_to_tile(holes, 8, 8).alias("tile"), S.array_to_tile("embedding", 8, 8).alias("whole"))


def grid(spark: SparkSession, sf_dir: str, name: str, prefix: str) -> DataFrame:
    """A layer of account balances: key from the nation, cell from the row's own key, NoData where nobody is."""
    t = table(spark, sf_dir, name)
    nation, own = F.col(f"{prefix}_nationkey"), F.col(f"{prefix}_{name[:4]}key")
    key = F.struct((nation % 5).cast("int").alias("col"), F.floor(nation / 5).cast("int").alias("row"))
    cells = t.groupBy(key.alias("spatial_key"), (own % 16).alias("at")).agg(F.sum(F.col(f"{prefix}_acctbal").cast("decimal(18,2)")).cast("double").alias("v"))
    made = cells.groupBy("spatial_key").agg(A.assemble_tile(F.col("at") % 4, F.floor(F.col("at") / 4), "v", 4, 4, "float64").alias("tile"))
    md = LayerMetadata("float64", GRID, GRID.extent, crs.LATLNG, KeyBounds(0, 0, 4, 4))
    return Y.as_rf(made, "spatial_key", md)


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid(spark, sf_dir, "customer", "c")


def suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Y.with_column_renamed(grid(spark, sf_dir, "supplier", "s"), "tile", "other")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A space-time layer: one 1 x 5 tile of summed values for each user group, hour and day."""
    e = table(spark, sf_dir, "events")
    key = F.struct((F.col("user_id") % 10).cast("int").alias("col"), F.hour("ts").alias("row"))
    day = F.struct((F.unix_date(F.to_date("ts")).cast("long") * 86_400_000).alias("instant"))
    cells = e.groupBy(key.alias("spatial_key"), day.alias("temporal_key"), (F.col("event_id") % 5).alias("at")).agg(F.sum("value").alias("v"))
    made = cells.groupBy("spatial_key", "temporal_key").agg(A.assemble_tile("at", F.lit(0), "v", 5, 1, "float64").alias("tile"))
    md = LayerMetadata("float64", Layout(Extent(0, 0, 10, 24), TileLayout(10, 24, 5, 1)), Extent(0, 0, 10, 24), crs.LATLNG, KeyBounds(0, 0, 9, 23, 0, 0))
    return Y.with_timestamp(Y.as_rf(made, "spatial_key", md, "temporal_key"))


def r6(c: Column) -> Column:
    return F.round(c, 6)


def cells_of(df: DataFrame, tile: str, *keep: str) -> DataFrame:
    """Cells of a tile column as rows, NoData as null, rounded."""
    return explode_tiles(df.select(*keep, F.col(tile).alias("v")), "v").withColumn("v", F.when(~F.isnan("v"), r6(F.col("v"))))


#: Cells of the embeddings: x with holes as null, w without.
CELLS = f"""cells as (
  select vec_id, label, i::int as i, case when abs(w) >= {HOLE}::float then w end as x, w
  from (select vec_id, label, unnest(embedding) as w, unnest(range(64)) as i from embeddings))"""
#: Cells of the customer and supplier layers.
GRIDS = """cust as (select (c_nationkey % 5)::int as col, (c_nationkey // 5)::int as "row", (c_custkey % 16)::int as pos, sum(c_acctbal::decimal(18,2))::double as v from customer group by all),
supp as (select (s_nationkey % 5)::int as col, (s_nationkey // 5)::int as "row", (s_suppkey % 16)::int as pos, sum(s_acctbal::decimal(18,2))::double as v from supplier group by all)"""
EVENTS = """ev as (select (user_id % 10)::int as col, hour(ts)::int as "row", epoch_ms(date_trunc('day', ts)::timestamp) as instant, (event_id % 5)::int as pos, sum(value) as v from events group by all)"""


# -- tile functions ------------------------------------------------------------------------------------------------------------


@query(f"with {CELLS} select vec_id, round(avg(x::double), 6) as v from cells group by vec_id")
def tile_mean(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", r6(S.tile_mean("tile")).alias("v"))


@query(f"with {CELLS} select vec_id, round(sum(x::double), 6) as v from cells group by vec_id")
def tile_sum(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", r6(S.tile_sum("tile")).alias("v"))


@query(f"with {CELLS} select vec_id, min(x::double) as v from cells group by vec_id")
def tile_min(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.tile_min("tile").alias("v"))


@query(f"with {CELLS} select vec_id, max(x::double) as v from cells group by vec_id")
def tile_max(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.tile_max("tile").alias("v"))


@query(f"with {CELLS} select vec_id, count(x) as n, min(x::double) as lo, max(x::double) as hi, round(avg(x::double), 6) as mean, round(var_pop(x::double), 6) as variance from cells group by vec_id")
def tile_stats(spark, sf_dir):
    s = tiles(spark, sf_dir).select("vec_id", S.tile_stats("tile").alias("s"))
    return s.select("vec_id", F.col("s.dataCells").alias("n"), F.col("s.min").alias("lo"), F.col("s.max").alias("hi"), r6(F.col("s.mean")).alias("mean"), r6(F.col("s.variance")).alias("variance"))


@query(f"with {CELLS} select vec_id, trunc(x * 10)::double as value, count(*) as n from cells where x is not null group by all")
def tile_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    tens = F.transform("embedding", lambda x: F.when(F.abs(x) >= F.lit(HOLE).cast("float"), (x * F.lit(10).cast("float")).cast("int")).otherwise(F.lit(-2147483648)))
    h = e.select("vec_id", S.tile_histogram(S.convert_cell_type(S.with_no_data(S.array_to_tile(tens, 8, 8), -2147483648), "int32")).alias("h"))
    return h.select("vec_id", F.explode("h.bins").alias("b")).select("vec_id", F.col("b.value").alias("value"), F.col("b.count").alias("n"))


@query(f"with {CELLS} select vec_id, count(x) as n from cells group by vec_id")
def data_cells(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.data_cells("tile").alias("n"))


@query(f"with {CELLS} select vec_id, count(*) - count(x) as n from cells group by vec_id")
def no_data_cells(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.no_data_cells("tile").alias("n"))


@query("select vec_id, 8::smallint as cols, 8::smallint as \"rows\", 'float32raw' as kind from embeddings")
def tile_dimensions_and_cell_type(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.tile_dimensions("tile").alias("d"), S.cell_type("tile").alias("kind")).select("vec_id", "d.cols", "d.rows", "kind")


def _algebra(op: str) -> str:
    return f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, round(({op})::float::double, 6) as v from cells"


def _local(name: str):
    def run(spark, sf_dir):
        return cells_of(tiles(spark, sf_dir).select("vec_id", S.local_algebra(name, "tile", "whole").alias("t")), "t", "vec_id")

    return run


for _name, _op in {"Add": "x + w", "Subtract": "x - w", "Multiply": "x * w", "Divide": "x / nullif(w, 0)"}.items():
    _f = _local(_name)
    _f.__name__ = f"local_{_name.lower()}"
    query(_algebra(_op))(_f)


@query(_algebra("greatest(x * x, w * w)").replace("as v from cells", "as v from cells").replace("greatest(x * x, w * w)", "case when x is not null then greatest(x::double * x, w::double * w) end"))
def local_algebra(spark, sf_dir):
    made = tiles(spark, sf_dir).select("vec_id", S.local_algebra(lambda a, b: np.where(np.isnan(a), np.nan, np.maximum(a * a, b * b)), "tile", "whole").alias("t"))
    return cells_of(made, "t", "vec_id")


@query(f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, round(case when x + 2 * w <> 0 then ((x - 2 * w)::float / (x + 2 * w)::float) end::double, 4) as v from cells")
def normalized_difference(spark, sf_dir):
    two = S.local_add("whole", "whole")
    made = tiles(spark, sf_dir).select("vec_id", S.normalized_difference("tile", two).alias("t"))
    return cells_of(made, "t", "vec_id").withColumn("v", F.round("v", 4))


@query(f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, case when trunc(x * 100) <> 0 or x is not null then trunc(x * 100::float)::double end as v from cells")
def convert_cell_type(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    holes = F.transform("embedding", lambda x: F.when(F.abs(x) < HOLE, F.lit(float("nan")).cast("float")).otherwise(x * F.lit(100).cast("float")))
    made = e.select("vec_id", S.convert_cell_type(S.array_to_tile(holes, 8, 8), "int16").alias("t"))
    return cells_of(made, "t", "vec_id")


@query(f"with {CELLS} select vec_id, count(*) - count(case when trunc(w * 10) <> 2 then 1 end) as n from cells group by vec_id")
def with_no_data(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    tens = F.transform("embedding", lambda x: (x * F.lit(10).cast("float")).cast("int"))
    return e.select("vec_id", S.no_data_cells(S.with_no_data(S.array_to_tile(tens, 8, 8), 2)).alias("n"))


@query(f"with {CELLS} select vec_id, i, round(w::double, 6) as v from cells")
def tile_to_array(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", F.posexplode(S.tile_to_double_array("whole")).alias("i", "v")).withColumn("v", r6(F.col("v")))


@query(f"with {CELLS} select vec_id, i, case when x is null then -2147483648 else trunc(x * 100::float)::int end as v from cells")
def tile_to_int_array(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    holes = F.transform("embedding", lambda x: F.when(F.abs(x) < HOLE, F.lit(float("nan")).cast("float")).otherwise(x * F.lit(100).cast("float")))
    return e.select("vec_id", F.posexplode(S.tile_to_int_array(S.array_to_tile(holes, 8, 8))).alias("i", "v"))


@query("select r_regionkey, 12.0::double * r_regionkey as v, 'int16' as kind from region")
def make_constant_tile(spark, sf_dir):
    kinds = F.array(*[S.make_constant_tile(k, 4, 3, "int16") for k in range(5)])
    return table(spark, sf_dir, "region").select("r_regionkey", kinds[F.col("r_regionkey")].alias("t")).select("r_regionkey", S.tile_sum("t").alias("v"), S.cell_type("t").alias("kind"))


@query("select kind, count(*) as n from (select ([" + ", ".join(f"'{n}'" for n in cell_type_names()) + f"])[c_custkey % {len(cell_type_names())} + 1] as kind from customer) group by kind")
def cell_types(spark, sf_dir):
    """Customers dealt over all cell types."""
    kinds = S.cell_types()
    return table(spark, sf_dir, "customer").groupBy(kinds[(F.col("c_custkey") % F.size(kinds)).cast("int")].alias("kind")).agg(F.count("*").alias("n"))


@query(f"""with {CELLS}, r as (select *, min(x::double) over w as lo, max(x::double) over w as hi from cells window w as (partition by vec_id)),
g as (select vec_id, i, case when x is null then '?' else substr('{S.ASCII_RAMP}', 1 + case when hi > lo then least({len(S.ASCII_RAMP) - 1}, floor((x::double - lo) / (hi - lo) * {len(S.ASCII_RAMP)})::int) else 0 end, 1) end as c from r)
select vec_id, string_agg(c || case when i % 8 = 7 then chr(10) else '' end, '' order by i) as art from g group by vec_id""")
def render_ascii(spark, sf_dir):
    return tiles(spark, sf_dir).select("vec_id", S.render_ascii("tile").alias("art"))


# -- aggregates ----------------------------------------------------------------------------------------------------------------


@query(f"with {CELLS} select label, count(x) as n, min(x::double) as lo, max(x::double) as hi, round(avg(x::double), 6) as mean, round(var_pop(x::double), 6) as variance from cells group by label")
def agg_stats(spark, sf_dir):
    s = tiles(spark, sf_dir).groupBy("label").agg(A.agg_stats("tile").alias("s"))
    return s.select("label", F.col("s.dataCells").alias("n"), F.col("s.min").alias("lo"), F.col("s.max").alias("hi"), r6(F.col("s.mean")).alias("mean"), r6(F.col("s.variance")).alias("variance"))


@query(f"with {CELLS} select label, round(avg(x::double), 6) as mean from cells group by label")
def agg_mean(spark, sf_dir):
    return tiles(spark, sf_dir).groupBy("label").agg(r6(A.agg_mean("tile")).alias("mean"))


@query(f"with {CELLS} select coalesce(label, -1)::int as label, count(x) as n from cells group by rollup (label)")
def agg_data_cells(spark, sf_dir):
    return tiles(spark, sf_dir).rollup("label").agg(A.agg_data_cells("tile").alias("n")).withColumn("label", F.coalesce("label", F.lit(-1)))


@query(f"with {CELLS} select label, count(*) - count(x) as n from cells group by label")
def agg_no_data_cells(spark, sf_dir):
    return tiles(spark, sf_dir).groupBy("label").agg(A.agg_no_data_cells("tile").alias("n"))


@query(f"with {CELLS} select label, trunc(w * 10)::double as value, count(*) as n from cells group by all")
def agg_histogram(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    tens = F.transform("embedding", lambda x: (x * F.lit(10).cast("float")).cast("int"))
    h = A.histogram_by(e.select("label", S.array_to_tile(tens, 8, 8).alias("t")), ["label"], "t")
    return h.select("label", F.explode("histogram.bins").alias("b")).select("label", F.col("b.value").alias("value"), F.col("b.count").alias("n"))


@query(f"with {GRIDS} select c.col, c.row, a.pos % 4 as column_index, a.pos // 4 as row_index, round(v.v, 6) as v from (select distinct col, row from cust) c cross join (select unnest(range(16))::int as pos) a left join cust v on v.col = c.col and v.row = c.row and v.pos = a.pos")
def assemble_tile(spark, sf_dir):
    c = cells_of(customers(spark, sf_dir), "tile", "spatial_key")
    return c.select("spatial_key.col", "spatial_key.row", "column_index", "row_index", "v")


def _local_sql(value: str) -> str:
    return f"with {CELLS} select label, (i % 8)::int as column_index, (i // 8)::int as row_index, {value} as v from cells group by label, i"


@query(f"with {CELLS} select label, (i % 8)::int as column_index, (i // 8)::int as row_index, count(x)::double as n, min(x::double) as lo, max(x::double) as hi, round(avg(x::double), 6) as mean, round(var_pop(x::double), 6) as variance from cells group by label, i")
def local_agg_stats(spark, sf_dir):
    s = L.local_agg_stats_by(tiles(spark, sf_dir), ["label"], "tile", "s")
    flat = s.select("label", *[F.col(f"s.{a}").alias(b) for a, b in (("count", "n"), ("min", "lo"), ("max", "hi"), ("mean", "mean"), ("variance", "variance"))])
    out = explode_tiles(flat, "n", "lo", "hi", "mean", "variance")
    tidy = lambda c: F.when(~F.isnan(c), r6(F.col(c)) if c in ("mean", "variance") else F.col(c)).alias(c)
    return out.select("label", "column_index", "row_index", "n", *[tidy(c) for c in ("lo", "hi", "mean", "variance")])


@query(f"with {CELLS} select (i % 8)::int as column_index, (i // 8)::int as row_index, count(x)::double as n, round(avg(x::double), 6) as mean from cells group by i")
def local_agg_of_all(spark, sf_dir):
    """One group of all tiles."""
    made = L.local_agg_by(tiles(spark, sf_dir), [], "tile", {"n": "count", "mean": "mean"})
    return explode_tiles(made, "n", "mean").withColumn("mean", F.when(~F.isnan("mean"), r6(F.col("mean"))))


def _local_agg(kind: str):
    def run(spark, sf_dir):
        return cells_of(L.local_agg_by(tiles(spark, sf_dir), ["label"], "tile", {"t": kind}), "t", "label")

    return run


for _name, _kind, _value in (
    ("local_agg_max", "plain_max", "case when count(x) = count(*) then round(max(x::double), 6) end"),
    ("local_agg_min", "plain_min", "case when count(x) = count(*) then round(min(x::double), 6) end"),
    ("local_agg_mean", "mean", "round(avg(x::double), 6)"),
    ("local_agg_data_cells", "data_cells", "count(x)::double"),
    ("local_agg_no_data_cells", "no_data_cells", "(count(*) - count(x))::double"),
):
    _f = _local_agg(_kind)
    _f.__name__ = _name
    query(_local_sql(_value))(_f)


# -- generators and pipeline stages ----------------------------------------------------------------------------------------------


@query(f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, round(x::double, 6) as tile, round(w::double, 6) as whole from cells")
def explode_two_tiles(spark, sf_dir):
    out = explode_tiles(tiles(spark, sf_dir), "tile", "whole", keep=["vec_id"])
    return out.withColumns({"tile": F.when(~F.isnan("tile"), r6(F.col("tile"))), "whole": r6(F.col("whole"))})


@query("select vec_id, 16::bigint as n from embeddings")
def explode_tile_sample_counts(spark, sf_dir):
    return explode_tile_sample(tiles(spark, sf_dir), 0.25, "tile", keep=["vec_id"], seed=3).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(f"with {CELLS} select label, count(x) as n, round(sum(x::double * w), 6) as s from cells where x is not null group by label")
def tile_exploder_and_no_data_filter(spark, sf_dir):
    cells = NoDataFilter(inputCols=["tile", "whole"]).transform(TileExploder().transform(tiles(spark, sf_dir)))
    return cells.groupBy("label").agg(F.count("tile").alias("n"), r6(F.sum(F.col("tile") * F.col("whole"))).alias("s"))


# -- keys, geometries, filters -----------------------------------------------------------------------------------------------------


@query(f"with {GRIDS} select distinct col, \"row\", col * 10.0::double as \"minX\", col * 10.0::double + 10 as \"maxX\", 40.0::double - \"row\" * 10 as \"minY\", 50.0::double - \"row\" * 10 as \"maxY\" from cust")
def bounds_and_box2d(spark, sf_dir):
    b = Y.with_bounds(customers(spark, sf_dir)).select("spatial_key.*", geometry.box2d("bounds").alias("b"))
    return b.select("col", "row", "b.*")


@query(f"with {GRIDS} select distinct col, \"row\", col * 10.0::double + 5 as x, 45.0::double - \"row\" * 10 as y from cust")
def centers(spark, sf_dir):
    return Y.with_center(customers(spark, sf_dir)).select("spatial_key.*", "center.x", "center.y")


@query(f"with {GRIDS} select distinct col, \"row\", col * 10.0::double + 5 as longitude, 45.0::double - \"row\" * 10 as latitude from cust")
def centers_lat_lng(spark, sf_dir):
    return Y.with_center_lat_lng(customers(spark, sf_dir)).select("spatial_key.*", "center.longitude", "center.latitude")


def _interleaved() -> str:
    x, y = "floor((col * 10.0::double + 5 + 180) / 360 * 2147483648)::bigint", "floor((45.0::double - \"row\" * 10 + 90) / 180 * 2147483648)::bigint"
    bits = " + ".join(f"((({v} >> {i}) & 1) << {2 * i + k})" for i in range(31) for v, k in ((x, 0), (y, 1)))
    return f"with {GRIDS} select distinct col, \"row\", ({bits})::bigint as spatial_index from cust"


@query(_interleaved())
def spatial_index(spark, sf_dir):
    return Y.with_spatial_index(customers(spark, sf_dir), ordered=False).select("spatial_key.*", "spatial_index")


#: A polygon over some keys, and what a predicate says of a key's box (x0, y0, x1, y1) against the box (12, 8) to (30, 30).
AREA = geometry.box(12, 8, 30, 30)
BOX_SQL = f"with {GRIDS}, k as (select distinct col, \"row\", col * 10 as x0, 40 - \"row\" * 10 as y0, col * 10 + 10 as x1, 50 - \"row\" * 10 as y1 from cust) select col, \"row\" from k where "
_MEET, _INNER = "x0 <= 30 and x1 >= 12 and y0 <= 30 and y1 >= 8", "x0 < 30 and x1 > 12 and y0 < 30 and y1 > 8"
_IN, _OVER = "x0 >= 12 and x1 <= 30 and y0 >= 8 and y1 <= 30", "x0 <= 12 and x1 >= 30 and y0 <= 8 and y1 >= 30"


def _st(name: str, g: geometry.Geometry):
    def run(spark, sf_dir):
        b = Y.with_bounds(customers(spark, sf_dir))
        return b.where(geometry.UDF_PREDICATES[name](F.col("bounds"), geometry.geom_lit(g))).select("spatial_key.*")

    return run


for _name, _g, _where in (
    ("intersects", AREA, _MEET), ("disjoint", AREA, f"not ({_MEET})"), ("within", AREA, _IN), ("touches", AREA, f"({_MEET}) and not ({_INNER})"),
    ("overlaps", AREA, f"({_INNER}) and not ({_IN}) and not ({_OVER})"), ("contains", geometry.box(12, 11, 18, 19), "col = 1 and \"row\" = 3"),
    ("covers", geometry.line((10, 11), (10, 19)), "col in (0, 1) and \"row\" = 3"), ("crosses", geometry.line((-5, 25), (33, 25)), "col < 4 and \"row\" = 2"),
):
    _f = _st(_name, _g)
    _f.__name__ = f"st_{_name}"
    query(BOX_SQL + _where)(_f)


@query(BOX_SQL + _MEET)
def where_intersects_pruned(spark, sf_dir):
    return where_intersects(customers(spark, sf_dir), AREA).select("spatial_key.*")


@query(BOX_SQL + "x0 < 23 and x1 > 23 and y0 < 17 and y1 > 17")
def where_contains_point(spark, sf_dir):
    return where_contains(customers(spark, sf_dir), geometry.point(23, 17)).select("spatial_key.*")


@query(BOX_SQL + "x0 <= 20 and x1 >= 20 and y0 <= 17 and y1 >= 17")
def where_covers_point(spark, sf_dir):
    return where_covers(customers(spark, sf_dir), geometry.point(20, 17)).select("spatial_key.*")


@query(f"with {GRIDS}, k as (select distinct col, \"row\", col * 10 as x0, 40 - \"row\" * 10 as y0, col * 10 + 10 as x1, 50 - \"row\" * 10 as y1 from cust), p as (select s_suppkey, (s_suppkey % 51)::double as x, (s_suppkey * 7 % 51)::double as y from supplier) select col, \"row\", s_suppkey from k join p on x >= x0 and x <= x1 and y >= y0 and y <= y1")
def points_in_keys(spark, sf_dir):
    p = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") % 51).cast("double").alias("x"), (F.col("s_suppkey") * 7 % 51).cast("double").alias("y"))
    return join_points(customers(spark, sf_dir), p, "x", "y").select("spatial_key.*", "s_suppkey")


@query("select s_suppkey, floor((s_suppkey % 50) / 10.0)::int as col, floor((50 - (s_suppkey * 7 % 50 + 0.5)) / 10.0)::int as \"row\" from supplier")
def keys_of_points(spark, sf_dir):
    x, y = (F.col("s_suppkey") % 50).cast("double"), (F.col("s_suppkey") * 7 % 50) + 0.5
    return table(spark, sf_dir, "supplier").select("s_suppkey", Y.point_key(customers(spark, sf_dir), x, y).alias("k")).select("s_suppkey", "k.*")


# -- time --------------------------------------------------------------------------------------------------------------------------


@query(f"with {EVENTS} select distinct col, \"row\", make_timestamp(instant * 1000) as \"timestamp\" from ev")
def timestamps(spark, sf_dir):
    return days(spark, sf_dir).select("spatial_key.*", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@query(f"with {EVENTS} select count(*) as n from (select distinct col, \"row\", instant from ev where instant between 1704412800000 and 1704844800000)")
def between_times(spark, sf_dir):
    return days(spark, sf_dir).where(Y.between_times("timestamp", dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 10))).agg(F.count("*").alias("n"))


@query(f"with {EVENTS} select count(*) as n from (select distinct col, \"row\", instant from ev where instant = 1704412800000)")
def at_time(spark, sf_dir):
    return days(spark, sf_dir).where(Y.at_time("timestamp", dt.datetime(2024, 1, 5))).agg(F.count("*").alias("n"))


@query(f"with {GRIDS} select distinct col, \"row\", 1700000000000::bigint as instant from cust")
def temporal_component(spark, sf_dir):
    return Y.add_temporal_component(customers(spark, sf_dir), 1_700_000_000_000).select("spatial_key.*", "temporal_key.instant")


@query(f"with {EVENTS} select \"row\", count(v) as n, round(avg(v), 4) as mean from ev group by \"row\"")
def statistics_by_hour(spark, sf_dir):
    s = days(spark, sf_dir).groupBy(F.col("spatial_key.row").alias("row")).agg(A.agg_stats("tile").alias("s"))
    return s.select("row", F.col("s.dataCells").alias("n"), F.round("s.mean", 4).alias("mean"))


# -- joins of geometries ---------------------------------------------------------------------------------------------------------------

#: Rectangles of customers and of suppliers, diamonds around suppliers, points of parts, on a plane of 1,000 by 1,000.
PLANE = """a as (select c_custkey, c_custkey * 37 % 1000 as x0, c_custkey * 91 % 1000 as y0, c_custkey * 37 % 1000 + 1 + c_nationkey as x1, c_custkey * 91 % 1000 + 1 + c_custkey % 10 as y1 from customer),
b as (select s_suppkey, s_suppkey * 53 % 1000 as x0, s_suppkey * 29 % 1000 as y0, s_suppkey * 53 % 1000 + 5 + s_nationkey as x1, s_suppkey * 29 % 1000 + 10 as y1, 5 + s_nationkey as r from supplier),
p as (select p_partkey, p_partkey * 17 % 1000 as x, p_partkey * 23 % 1000 as y from part)"""


def _rectangles(spark: SparkSession, sf_dir: str, name: str, key: str, x: int, y: int, width: Column, height: Column) -> DataFrame:
    x0, y0 = (F.col(key) * x % 1000).cast("double"), (F.col(key) * y % 1000).cast("double")
    return table(spark, sf_dir, name).select(key, geometry.polygon_of_box(x0, y0, x0 + width, y0 + height).alias(f"{key}_shape"))


def _customer_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rectangles(spark, sf_dir, "customer", "c_custkey", 37, 91, F.col("c_nationkey") + 1, F.col("c_custkey") % 10 + 1)


def _supplier_rectangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rectangles(spark, sf_dir, "supplier", "s_suppkey", 53, 29, F.col("s_nationkey") + 5, F.lit(10))


@query(f"with {PLANE} select c_custkey, s_suppkey from a join b on a.x0 <= b.x1 and b.x0 <= a.x1 and a.y0 <= b.y1 and b.y0 <= a.y1")
def geometry_join_intersects(spark, sf_dir):
    return geometry_join(_customer_rectangles(spark, sf_dir), _supplier_rectangles(spark, sf_dir), "c_custkey_shape", "s_suppkey_shape").select("c_custkey", "s_suppkey")


@query(f"with {PLANE} select c_custkey, s_suppkey from a join b on a.x0 >= b.x0 and a.x1 <= b.x1 and a.y0 >= b.y0 and a.y1 <= b.y1")
def geometry_join_within(spark, sf_dir):
    return geometry_join(_customer_rectangles(spark, sf_dir), _supplier_rectangles(spark, sf_dir), "c_custkey_shape", "s_suppkey_shape", "within").select("c_custkey", "s_suppkey")


@query(f"with {PLANE} select s_suppkey, p_partkey from b join p on abs(b.x0 - p.x) + abs(b.y0 - p.y) < b.r")
def geometry_join_contains(spark, sf_dir):
    """Points of parts inside diamonds around suppliers."""
    x, y, r = F.col("s_suppkey") * 53 % 1000, F.col("s_suppkey") * 29 % 1000, F.col("s_nationkey") + 5
    diamond = geometry.st_geom_from_wkt(F.format_string("POLYGON ((%d %d, %d %d, %d %d, %d %d, %d %d))", x - r, y, x, y + r, x + r, y, x, y - r, x - r, y))
    points = table(spark, sf_dir, "part").select("p_partkey", geometry.st_point(F.col("p_partkey") * 17 % 1000, F.col("p_partkey") * 23 % 1000).alias("at"))
    return geometry_join(table(spark, sf_dir, "supplier").select("s_suppkey", diamond.alias("diamond")), points, "diamond", "at", "contains").select("s_suppkey", "p_partkey")


@query(f"with {GRIDS}, k as (select distinct col, \"row\", col * 10 as x0, 40 - \"row\" * 10 as y0, col * 10 + 10 as x1, 50 - \"row\" * 10 as y1 from cust), p as (select p_partkey, (p_partkey % 51)::double as x, (p_partkey * 7 % 51)::double as y from part) select col, \"row\", p_partkey from k join p on x > x0 and x < x1 and y > y0 and y < y1")
def geometry_join_layer(spark, sf_dir):
    """Tiles of a layer by the points inside their bounds."""
    points = table(spark, sf_dir, "part").select("p_partkey", geometry.st_point(F.col("p_partkey") % 51, F.col("p_partkey") * 7 % 51).alias("at"))
    return geometry_join(Y.with_bounds(customers(spark, sf_dir)), points, "bounds", "at", "contains").select("spatial_key.*", "p_partkey")


# -- joins ---------------------------------------------------------------------------------------------------------------------------


def _both(how: str) -> str:
    return f"with {GRIDS}, a as (select col, \"row\", sum(v) as v from cust group by all), b as (select col, \"row\", sum(v) as v from supp group by all) select a.col as lc, a.row as lr, b.col as rc, b.row as rr, round(a.v, 2) as l, round(b.v, 2) as r from a {how} join b on a.col = b.col and a.row = b.row"


def _join(how: str):
    def run(spark, sf_dir):
        j = Y.spatial_join(customers(spark, sf_dir), suppliers(spark, sf_dir), how)
        left, right = ("spatial_key", "spatial_key") if how == "inner" else ("left_spatial_key", "right_spatial_key")
        total = lambda c: F.when(F.col(c).isNotNull(), F.round(S.tile_sum(c), 2))
        return j.select(F.col(f"{left}.col").alias("lc"), F.col(f"{left}.row").alias("lr"), F.col(f"{right}.col").alias("rc"), F.col(f"{right}.row").alias("rr"), total("tile").alias("l"), total("other").alias("r"))

    return run


for _how, _sql in {"inner": "inner", "left_outer": "left", "right_outer": "right", "fullouter": "full"}.items():
    _f = _join(_how)
    _f.__name__ = f"spatial_join_{_how}"
    query(_both(_sql))(_f)


@query(f"with {GRIDS} select distinct col, \"row\" from cust where (col, \"row\") in (select col, \"row\" from supp)")
def spatial_join_leftsemi(spark, sf_dir):
    return Y.spatial_join(customers(spark, sf_dir), suppliers(spark, sf_dir), "leftsemi").select("spatial_key.*")


@query(f"with {GRIDS} select distinct col, \"row\" from cust where (col, \"row\") not in (select col, \"row\" from supp)")
def spatial_join_leftanti(spark, sf_dir):
    return Y.spatial_join(customers(spark, sf_dir), suppliers(spark, sf_dir), "left_anti").select("spatial_key.*")


@query(f"with {EVENTS}, k as (select col, \"row\", instant, sum(v) as v from ev group by all) select count(*) as n, round(sum(a.v), 2) as v from k a join k b using (col, \"row\", instant)")
def spatial_join_temporal(spark, sf_dir):
    d = days(spark, sf_dir)
    other = Y.with_column_renamed(d.drop("timestamp"), "tile", "other")
    return Y.spatial_join(d, other).agg(F.count("*").alias("n"), F.round(F.sum(S.tile_sum("tile")), 2).alias("v"))


@query(f"with {GRIDS}, m as (select col, \"row\", pos, round(c.v + s.v, 6) as v from cust c join supp s using (col, \"row\", pos)) select m.col, m.row, count(v) as n, round(avg(v), 4) as mean from m group by all")
def add_joined_bands(spark, sf_dir):
    j = Y.spatial_join(customers(spark, sf_dir), suppliers(spark, sf_dir))
    s = j.groupBy("spatial_key").agg(A.agg_stats(S.local_add("tile", "other")).alias("s")).where("s.dataCells > 0")
    return s.select("spatial_key.*", F.col("s.dataCells").alias("n"), F.round("s.mean", 4).alias("mean"))


# -- layers, sources, rasters ------------------------------------------------------------------------------------------------------------


@query(f"with {GRIDS} select \"row\" >= 3 as low, min(col) as c0, min(\"row\") as r0, max(col) as c1, max(\"row\") as r1 from cust group by 1")
def clip_layer_extent(spark, sf_dir):
    """Key bounds of the upper and of the lower part of a layer after clipping."""
    out = []
    for low in (False, True):
        b = Y.tile_layer_metadata(Y.clip_layer_extent(customers(spark, sf_dir).where((F.col("spatial_key.row") >= 3) == low))).bounds
        out.append((low, b.col_min, b.row_min, b.col_max, b.row_max))
    return spark.createDataFrame(out, "low boolean, c0 int, r0 int, c1 int, r1 int")


@query(f"with {GRIDS} select col * 2 + (pos % 4) // 2 as col, \"row\" * 2 + (pos // 4) // 2 as \"row\", count(v) as n, round(sum(v), 2) as v from cust group by 1, 2")
def tile_subdivisions(spark, sf_dir):
    df = with_tile_subdivisions(customers(spark, sf_dir), 2).where(S.data_cells("tile") > 0)
    return df.select("spatial_key.*", S.data_cells("tile").alias("n"), F.round(S.tile_sum("tile"), 2).alias("v"))


@query(f"with {GRIDS} select col, \"row\", count(v) as n, round(sum(v), 2) as v from cust group by all")
def layer_files(spark, sf_dir):
    at = layers.Layer(shared_folder(spark, "layers"), "customers", 0)
    layers.write_layer(customers(spark, sf_dir), at)
    df = layers.read_layer(spark, at, bounds=False)
    return df.select("spatial_key.*", S.data_cells("tile").alias("n"), F.round(S.tile_sum("tile"), 2).alias("v"))


@query(f"with {GRIDS} select col, \"row\", pos % 4 as column_index, pos // 4 as row_index, round(v, 6) as v from cust where col * 10 <= 30 and col * 10 + 10 >= 12 and 40 - \"row\" * 10 <= 30 and 50 - \"row\" * 10 >= 8")
def layer_files_where(spark, sf_dir):
    """A layer file read by a geometry: intervals of the index reach the scan."""
    at = layers.Layer(shared_folder(spark, "layers"), "customers", 0)
    layers.write_layer(customers(spark, sf_dir), at)
    cells = cells_of(layers.read_layer(spark, at, where=AREA, bounds=False).select("spatial_key.*", "tile"), "tile", "col", "row")
    return cells.where("v is not null")


@query(f"with {EVENTS} select col, \"row\", instant, count(v) as n, round(sum(v), 4) as v from ev where col between 2 and 4 and \"row\" between 3 and 9 and instant between 1704240000000 and 1705536000000 group by all")
def layer_files_space_time(spark, sf_dir):
    """A space-time layer file read by a geometry and two times; its index has the day in it."""
    at = layers.Layer(shared_folder(spark, "layers"), "days", 0)
    layers.write_layer(days(spark, sf_dir).drop("timestamp"), at)
    area = geometry.box(2.5, 14.5, 4.5, 20.5)
    df = layers.read_layer(spark, at, where=area, between=(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 18)), bounds=False)
    return df.select("spatial_key.*", "temporal_key.instant", S.data_cells("tile").alias("n"), F.round(S.tile_sum("tile"), 4).alias("v"))


@query(f"""with {GRIDS} select 'customers' as name, 3 as zoom, 'float64' as kind, min(col) as first_col, max(col) as last_col, min("row") as first_row, max("row") as last_row from cust
union all select 'suppliers', 5, 'float64', min(col), max(col), min("row"), max("row") from supp""")
def layer_catalog(spark, sf_dir):
    """Two layers, with the bounds of the keys that they have."""
    base = shared_folder(spark, "catalog")
    for df, name, zoom in ((customers(spark, sf_dir), "customers", 3), (suppliers(spark, sf_dir), "suppliers", 5)):
        layers.write_layer(Y.clip_layer_extent(df), layers.Layer(base, name, zoom))
    at = lambda path: F.get_json_object("metadata", path)
    c = layers.read_catalog(spark, base)
    bounds = [at(f"$.bounds.{side}Key.{axis}").cast("int").alias(f"{end}_{axis}") for axis in ("col", "row") for side, end in (("min", "first"), ("max", "last"))]
    return c.select(F.col("layer.id.name").alias("name"), F.col("layer.id.zoom").alias("zoom"), at("$.cellType").alias("kind"), *bounds)


@query(f"with {GRIDS} select (c.col * 4 + pos % 4)::int as x, (c.row * 4 + pos // 4)::int as y, round(v, 6) as v from cust c")
def raster_of_layer(spark, sf_dir):
    df = customers(spark, sf_dir)
    r = to_raster(df, "tile", 20, 20)
    own = Y.tile_layer_metadata(Y.clip_layer_extent(df)).extent
    if own != GRID.extent:
        raise ValueError("the layer does not fill its grid")
    rows, cols = np.nonzero(~np.isnan(r.tiles[0].cells))
    data = [(int(x), int(y), float(round(r.tiles[0].cells[y, x], 6))) for y, x in zip(rows, cols)]
    return spark.createDataFrame(data, "x int, y int, v double")


@query(f"with {GRIDS} select ((c.col * 4 + pos % 4) // 10)::int as col, ((c.row * 4 + pos // 4) // 10)::int as \"row\", count(v) as n, round(sum(v), 2) as v from cust c group by 1, 2")
def layer_of_raster(spark, sf_dir):
    """A raster of a layer's cells, cut into other tiles."""
    r = to_raster(customers(spark, sf_dir), "tile", 20, 20)
    df = Y.from_raster(spark, r.tiles[0].cells, r.extent, tile_cols=10, tile_rows=10)
    return df.select("spatial_key.*", S.data_cells("tile").alias("n"), F.round(S.tile_sum("tile"), 2).alias("v"))


@query(f"""with {GRIDS}, f as (select s_suppkey, s_suppkey % 200 as v, s_suppkey * 13 % 47 as x0, s_suppkey * 13 % 47 + 3 + s_nationkey % 5 as x1, s_suppkey * 31 % 48 as y0, s_suppkey * 31 % 48 + 2 + s_nationkey % 3 as y1 from supplier),
k as (select distinct col, "row" from cust), c as (select k.*, (i % 4)::int as column_index, (i // 4)::int as row_index, (k.col * 4 + i % 4 + 0.5) * 2.5 as x, 50 - (k.row * 4 + i // 4 + 0.5) * 2.5 as y from k, unnest(range(16)) t(i))
select col, "row", column_index, row_index, arg_max(v, s_suppkey)::double as v from c left join f on x between x0 and x1 and y between y0 and y1 group by all""")
def burned_features(spark, sf_dir):
    """Labels of suppliers' rectangles in the cells of a layer, the last one's where they overlap."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    x, y = (key * 13 % 47).cast("double"), (key * 31 % 48).cast("double")
    shape = geometry.polygon_of_box(x, y, x + 3 + nation % 5, y + 2 + nation % 3)
    features = table(spark, sf_dir, "supplier").select(shape.alias("shape"), (key % 200).alias("v"), "s_suppkey")
    made = burned(customers(spark, sf_dir), features, "shape", "v", "s_suppkey")
    return cells_of(made.select("spatial_key.*", "label"), "label", "col", "row")


@query(f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, round(coalesce(x, w)::double, 6) as v from cells")
def merge_tiles(spark, sf_dir):
    return cells_of(tiles(spark, sf_dir).select("vec_id", P.merge_tiles("tile", "whole").alias("t")), "t", "vec_id")


@query(f"with {CELLS} select vec_id, (i % 8 - 2)::int as column_index, (i // 8 - 1)::int as row_index, round(w::double, 6) as v from cells where i % 8 between 2 and 5 and i // 8 between 1 and 3")
def crop_tiles(spark, sf_dir):
    return cells_of(tiles(spark, sf_dir).select("vec_id", P.crop_tile("whole", 2, 1, 5, 3).alias("t")), "t", "vec_id")


def _signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", S.array_to_tile("embedding", 8, 8).alias("t"), S.array_to_tile(F.transform("embedding", lambda x: (x > 0).cast("int")), 8, 8).alias("m"))


@query(f"with {CELLS} select vec_id, round(sum(case when w > 0 then 1 else w::double end), 5) as v from cells group by vec_id")
def local_mask(spark, sf_dir):
    return _signs(spark, sf_dir).select("vec_id", F.round(S.tile_sum(P.local_mask("t", "m", 1, 1)), 5).alias("v"))


@query(f"with {CELLS} select vec_id, round(sum(case when w > 0 then w::double else 1 end), 5) as v from cells group by vec_id")
def local_inverse_mask(spark, sf_dir):
    return _signs(spark, sf_dir).select("vec_id", F.round(S.tile_sum(P.local_inverse_mask("t", "m", 1, 1)), 5).alias("v"))


@query("select n_nationkey, n_name || ', ' || r_name as v from nation join region on n_regionkey = r_regionkey")
def merge_payloads(spark, sf_dir):
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return n.select("n_nationkey", P.merge_data(F.col("n_name"), F.col("r_name"), n.schema["n_name"].dataType).alias("v"))


@query(f"with {CELLS} select label, rank() over (order by m desc) as place, round(m, 6) as mean from (select label, avg(x::double) as m from cells group by label)")
def ranked_labels(spark, sf_dir):
    m = tiles(spark, sf_dir).groupBy("label").agg(A.agg_mean("tile").alias("m"))
    return m.selectExpr("label", "cast(rank() over (order by m desc) as bigint) as place", "round(m, 6) as mean")


@query(f"with {CELLS} select label, count(x) as n, round(avg(x::double), 6) as mean from cells group by label")
def sql_functions(spark, sf_dir):
    session.init(spark, methods=False)
    tiles(spark, sf_dir).createOrReplaceTempView("_tiles")
    return session.sql(spark, "select label, rf_aggDataCells(tile) as n, round(rf_aggMean(tile), 6) as mean from _tiles group by label")


_LEVELS = ", ".join(f"trunc(255 * pow(trunc(({b} - min({b}) over w) / (max({b}) over w - min({b}) over w) * 255) / 255, 1 / 1.4)) as {b}" for b in ("lo", "me", "hi"))


@query(f"""with {CELLS}, m as (select label, i, min(x::double) as lo, avg(x::double) as me, max(x::double) as hi from cells group by label, i),
v as (select label, {_LEVELS} from m window w as (partition by label))
select label, 8 as n_rows, 8 as n_cols, sum(lo)::bigint as red, sum(me)::bigint as green, sum(hi)::bigint as blue, count(lo) * 255 as alpha from v group by label""")
def rgb_composites(spark, sf_dir):
    """A PNG for each label, of the cell-wise minima, means and maxima; sums of its channels."""
    t = L.local_agg_by(tiles(spark, sf_dir), ["label"], "tile", {"lo": "min", "me": "mean", "hi": "max"})

    def pictures(batches):
        from rasterloom.tile import Tile

        for b in batches:
            files = [render.rgb_composite([Tile.from_row(band) for band in bands], render.NAIP_NATURAL_COLOR) for bands in zip(*(b.column(k).to_pylist() for k in (1, 2, 3)))]
            seen = [render.pixels(f) for f in files]
            sums = [pa.array([int(x[..., k].sum()) for x in seen], pa.int64()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x.shape[k] for x in seen], pa.int32()) for k in (0, 1)), *sums], ["label", "n_rows", "n_cols", "red", "green", "blue", "alpha"])

    return t.mapInArrow(pictures, "label int, n_rows int, n_cols int, red long, green long, blue long, alpha long")


@query(f"with {CELLS} select label, (i % 8)::int as column_index, (i // 8)::int as row_index, count(x)::double as n, (count(*) - count(x))::double as missing, round(avg(x::double), 6) as mean, case when count(x) = count(*) then round(min(x::double), 6) end as lo, case when count(x) = count(*) then round(max(x::double), 6) end as hi, round(var_pop(x::double), 6) as variance from cells group by label, i")
def local_agg_columns(spark, sf_dir):
    """All cell-wise aggregates of a label as columns beside each other, from one pass over the tiles."""
    return _local_cells(L.local_agg_by(tiles(spark, sf_dir), ["label"], "tile", {"n": "data_cells", "missing": "no_data_cells", "mean": "mean", "lo": "plain_min", "hi": "plain_max", "variance": "variance"}))


def _local_cells(df: DataFrame) -> DataFrame:
    names = [c for c in df.columns if c != "label"]
    return explode_tiles(df, *names).select("label", "column_index", "row_index", *[F.when(~F.isnan(c), r6(F.col(c))).alias(c) for c in names])


@query(f"with {CELLS} select label, trunc(w * 10)::double as value, count(*) as n from cells group by all")
def agg_histogram_column(spark, sf_dir):
    h = _tens(spark, sf_dir).groupBy("label").agg(A.agg_histogram("t").alias("h"))
    return h.select("label", F.explode("h.bins").alias("b")).select("label", F.col("b.value").alias("value"), F.col("b.count").alias("n"))


def _tens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("label", S.array_to_tile(F.transform("embedding", lambda x: (x * F.lit(10).cast("float")).cast("int")), 8, 8).alias("t"))


# -- SQL names -----------------------------------------------------------------------------------------------------------------------


def _views(spark: SparkSession, sf_dir: str) -> None:
    session.init(spark, methods=False)
    tiles(spark, sf_dir).createOrReplaceTempView("_tiles")


@query(f"""with {CELLS} select vec_id, round(avg(x::double), 6) as mean, round(sum(x::double), 6) as total, min(x::double) as lo, max(x::double) as hi, count(x) as n, count(*) - count(x) as missing,
  round(var_pop(x::double), 6) as variance, 'float32raw' as kind, 8::smallint as cols, 8::smallint as n_rows, count(x) as binned, round(sum(case when x is null then -2147483648.0 else trunc(x)::double end), 6) as ints,
  round(sum(w::double), 6) as doubles, 72 as drawn, 64.0::double as ones, 15 as kinds from cells group by vec_id""")
def sql_tile_functions(spark, sf_dir):
    _views(spark, sf_dir)
    return session.sql(spark, """select vec_id, round(rf_tileMean(tile), 6) as mean, round(rf_tileSum(tile), 6) as total, rf_tileMin(tile) as lo, rf_tileMax(tile) as hi, rf_dataCells(tile) as n, rf_noDataCells(tile) as missing,
      round(rf_tileStats(tile).variance, 6) as variance, rf_cellType(tile) as kind, rf_tileDimensions(tile).cols as cols, rf_tileDimensions(tile).rows as n_rows,
      aggregate(rf_tileHistogram(tile).bins, 0L, (a, b) -> a + b.count) as binned, round(aggregate(rf_tileToArrayInt(tile), 0D, (a, x) -> a + x), 6) as ints,
      round(aggregate(rf_tileToArrayDouble(whole), 0D, (a, x) -> a + x), 6) as doubles, length(rf_renderAscii(tile)) as drawn, rf_tileSum(rf_makeConstantTile(1, 8, 8, 'int8')) as ones, size(rf_cellTypes()) as kinds from _tiles""")


@query(f"""with {CELLS} select vec_id, round(sum((x + w)::float::double), 5) as added, round(sum((x - w)::float::double), 5) as less, round(sum((x * w)::float::double), 5) as times, round(sum((w / w)::float::double), 5) as one,
  round(sum((case when x is null then null else 0 end)::double), 5) as difference, sum(trunc(w * 100::float)::double) as whole, count(*) - count(case when trunc(w * 10) <> 2 then 1 end) as missing, 3.0::double as made, round(sum(coalesce(x, w)::double), 5) as merged from cells group by vec_id""")
def sql_tile_algebra(spark, sf_dir):
    _views(spark, sf_dir)
    e = table(spark, sf_dir, "embeddings")
    times = lambda k: F.transform("embedding", lambda x: x * F.lit(k).cast("float"))
    e.select("vec_id", S.array_to_tile(times(100), 8, 8).alias("h"), S.array_to_tile(F.transform(times(10), lambda x: x.cast("int")), 8, 8).alias("t")).createOrReplaceTempView("_scaled")
    return session.sql(spark, """select vec_id, round(rf_tileSum(rf_localAdd(tile, whole)), 5) as added, round(rf_tileSum(rf_localSubtract(tile, whole)), 5) as less, round(rf_tileSum(rf_localMultiply(tile, whole)), 5) as times,
      round(rf_tileSum(rf_localDivide(whole, whole)), 5) as one, round(rf_tileSum(rf_normalizedDifference(tile, tile)), 5) as difference, rf_tileSum(rf_convertCellType(h, 'int16')) as whole, rf_noDataCells(rf_withNoData(t, 2)) as missing,
      rf_tileSum(rf_arrayToTile(array(1D, 2D), 2, 1)) as made, round(rf_tileSum(rf_merge(tile, whole)), 5) as merged from _tiles join _scaled using (vec_id)""")


@query(f"with {CELLS} select label, count(x) as n, count(*) - count(x) as missing, round(avg(x::double), 6) as mean, min(x::double) as lo, max(x::double) as hi, round(var_pop(x::double), 6) as variance, count(x) as binned from cells group by label")
def sql_aggregates(spark, sf_dir):
    """Tile aggregates in SQL; what is shuffled is numbers and bins."""
    _views(spark, sf_dir)
    return session.sql(spark, """select label, rf_aggDataCells(tile) as n, rf_aggNoDataCells(tile) as missing, round(rf_aggMean(tile), 6) as mean, rf_aggStats(tile).min as lo, rf_aggStats(tile).max as hi, round(rf_aggStats(tile).variance, 6) as variance,
      aggregate(rf_aggHistogram(tile).bins, 0L, (a, b) -> a + b.count) as binned from _tiles group by label""")


@query(f"with {CELLS} select label, (i % 8)::int as column_index, (i // 8)::int as row_index, count(x)::double as n, count(x)::double as again, (count(*) - count(x))::double as missing, round(avg(x::double), 6) as mean, case when count(x) = count(*) then round(min(x::double), 6) end as lo, case when count(x) = count(*) then round(max(x::double), 6) end as hi, round(var_pop(x::double), 6) as variance from cells group by label, i")
def sql_local_aggregates(spark, sf_dir):
    _views(spark, sf_dir)
    g = session.sql(spark, """select label, rf_localAggCount(tile) as n, rf_localAggDataCells(tile) as again, rf_localAggNoDataCells(tile) as missing, rf_localAggMean(tile) as mean, rf_localAggMin(tile) as lo, rf_localAggMax(tile) as hi, rf_localAggStats(tile).variance as variance
      from _tiles group by label""")
    return _local_cells(g)


@query(f"with {CELLS} select vec_id, count(x) as n, round(sum(x::double), 6) as total, count(*) as pairs from cells group by vec_id")
def sql_explode_and_assemble(spark, sf_dir):
    _views(spark, sf_dir)
    return session.sql(spark, """with c as (select vec_id, e.* from _tiles, lateral rf_explodeTiles(tile) e),
      t as (select vec_id, rf_assembleTile(column_index, row_index, cell, 8, 8, 'float64') as t from c group by vec_id),
      two as (select vec_id, count(*) as pairs from _tiles, lateral rf_explodeTiles2(tile, whole) e where cell_1 is not null group by vec_id)
      select vec_id, rf_dataCells(t) as n, round(rf_tileSum(t), 6) as total, pairs from t join two using (vec_id)""")


@query(f"with {CELLS} select vec_id, (i % 8)::int as column_index, (i // 8)::int as row_index, round(x::double, 6) as v, round(w::double, 6) as w, round((coalesce(x, 0) + w)::double, 5) as total from cells")
def sql_tile_cells(spark, sf_dir):
    """Cells of two tiles as rows in SQL, without a Python call for each cell."""
    _views(spark, sf_dir)
    return session.sql(spark, """select vec_id, c.column_index, c.row_index, round(nanvl(c.cells[0], null), 6) as v, round(c.cells[1], 6) as w, round(nanvl(c.cells[0], 0D) + c.cells[1], 5) as total
      from (select vec_id, explode(rf_tileCells(tile, whole)) as c from _tiles)""")


@query("select n_nationkey, (n_nationkey between 5 and 15) as meets, n_nationkey = 10 as holds, abs(n_nationkey - 10)::double as away from nation")
def sql_geometry(spark, sf_dir):
    session.init(spark, methods=False)
    table(spark, sf_dir, "nation").createOrReplaceTempView("_nation")
    return session.sql(spark, """select n_nationkey, st_intersects(st_point(double(n_nationkey), 0D), st_geomFromWKT('LINESTRING (5 0, 15 0)')) as meets,
      st_contains(st_geomFromWKT('POLYGON ((9.5 -1, 10.5 -1, 10.5 1, 9.5 1, 9.5 -1))'), st_point(double(n_nationkey), 0D)) as holds, st_distance(st_point(double(n_nationkey), 0D), st_point(10D, 0D)) as away from _nation""")


# -- image files ---------------------------------------------------------------------------------------------------------------------


def _pixels(df: DataFrame, *keep: str) -> DataFrame:
    """Cells with data of a read image, by their place in it."""
    c = explode_tiles(df.select(*keep, "spatial_key", "tile"), "tile").where(~F.isnan("tile"))
    return c.select(*keep, (F.col("spatial_key.col") * 256 + F.col("column_index")).alias("x"), (F.col("spatial_key.row") * 256 + F.col("row_index")).alias("y"), r6(F.col("tile")).alias("v"))


@query(f"with {GRIDS} select (c.col * 4 + pos % 4)::int as x, (c.row * 4 + pos // 4)::int as y, round(v, 6) as v from cust c")
def geotiff_write_and_read(spark, sf_dir):
    path = f"{shared_folder(spark, 'geotiff')}/customers.tif"
    write_geotiff(customers(spark, sf_dir), path)
    return _pixels(read_geotiff(spark, path))


@query(f"with {GRIDS} select (c.col * 4 + pos % 4)::int as x, (c.row * 4 + pos // 4)::int as y, round(v, 6) as v from supp c")
def geotiff_strips(spark, sf_dir):
    """A striped file, read through its URI."""
    path = f"{shared_folder(spark, 'geotiff')}/suppliers.tif"
    write_geotiff(suppliers(spark, sf_dir), path, strips=True)
    return _pixels(read_geotiff(spark, path))


@query(f"with {GRIDS}, every as (select 'customers' as name, * from cust union all select 'suppliers', * from supp) select name, count(v) as n, round(sum(v), 2) as v, 'float64' as kind from every group by name")
def geotiff_files(spark, sf_dir):
    folder = shared_folder(spark, "geotiffs")
    write_geotiff(customers(spark, sf_dir), f"{folder}/customers.tif")
    write_geotiff(suppliers(spark, sf_dir), f"{folder}/suppliers.tif")
    f = read_files(spark, f"{folder}/*.tif").withColumn("name", F.regexp_extract("path", r"(\w+)\.tif$", 1))
    s = f.groupBy("name").agg(A.agg_stats("tile").alias("s"), F.first(F.get_json_object("context", "$.cellType")).alias("kind"))
    return s.select("name", F.col("s.dataCells").alias("n"), F.round(F.col("s.mean") * F.col("s.dataCells"), 2).alias("v"), "kind")


def _world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen keys over the world in web Mercator, with the sum of their nations' numbers in all cells."""
    n, world = table(spark, sf_dir, "nation"), crs.WORLD
    at = (F.col("n_nationkey") % 16).cast("int")
    made = n.groupBy(F.struct((at % 4).alias("col"), F.floor(at / 4).cast("int").alias("row")).alias("spatial_key")).agg(F.sum("n_nationkey").cast("double").alias("v"))
    extent = Extent(-world, -world, world, world)
    md = LayerMetadata("float64", Layout(extent, TileLayout(4, 4, 16, 16)), extent, crs.WEB_MERCATOR, KeyBounds(0, 0, 3, 3))
    return Y.as_rf(made.select("spatial_key", S.array_to_tile(F.array_repeat("v", 256), 16, 16).alias("tile")), "spatial_key", md)


_WORLD = """keys as (select (n_nationkey % 16 % 4)::int as x, (n_nationkey % 16 // 4)::int as y, sum(n_nationkey)::double as v from nation group by all),
levels as (select 2 as z, x, y, v from keys union all select 1, x // 2, y // 2, avg(v) from keys group by all union all select 0, 0, 0, avg(v) from keys)"""


def _means(batches):
    """Data cells and mean of the first band of web tiles."""
    for b in batches:
        cells = [np.frombuffer(x[0], np.float64) for x in b.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([int((~np.isnan(c)).sum()) for c in cells], pa.int32()), pa.array([float(np.nanmean(c)) for c in cells])], ["z", "x", "y", "n", "mean"])


@query(f"with {_WORLD} select z::int as z, x::int as x, y::int as y, 65536 as n, round(v, 6) as mean from levels")
def slippy_pyramid(spark, sf_dir):
    return slippy.pyramid(_world(spark, sf_dir), 2).mapInArrow(_means, "z int, x int, y int, n int, mean double").withColumn("mean", r6(F.col("mean")))


@query("""with keys as (select (n_nationkey % 16 % 4)::int as x, (n_nationkey % 16 // 4)::int as y, n_regionkey, sum(n_nationkey)::double as v from nation group by all)
select 2 as z, x, y, 65536 as n, arg_max(v, n_regionkey) as mean from keys group by x, y""")
def slippy_space_time(spark, sf_dir):
    """Web tiles of a layer with several times a key: the latest one's cells."""
    n, (at, world) = table(spark, sf_dir, "nation"), ((F.col("n_nationkey") % 16).cast("int"), crs.WORLD)
    key, time = F.struct((at % 4).alias("col"), F.floor(at / 4).cast("int").alias("row")), F.struct(F.col("n_regionkey").cast("long").alias("instant"))
    made = n.groupBy(key.alias("spatial_key"), time.alias("temporal_key")).agg(F.sum("n_nationkey").cast("double").alias("v"))
    extent = Extent(-world, -world, world, world)
    md = LayerMetadata("float64", Layout(extent, TileLayout(4, 4, 16, 16)), extent, crs.WEB_MERCATOR, KeyBounds(0, 0, 3, 3, 0, 4))
    return slippy.web_tiles(Y.as_rf(made.select("spatial_key", "temporal_key", S.array_to_tile(F.array_repeat("v", 256), 16, 16).alias("tile")), "spatial_key", md, "temporal_key"), 2).mapInArrow(_means, "z int, x int, y int, n int, mean double")


def _address(path: Column, suffix: str) -> list[Column]:
    return [F.regexp_extract(path, rf"/(\d+)/(\d+)/(\d+)\.{suffix}$", k).cast("int").alias(c) for k, c in enumerate("zxy", 1)]


@query(f"with {_WORLD} select z::int as z, x::int as x, y::int as y, 65536 as n, round(v, 6) as mean from levels where z = 2")
def slippy_geotiffs(spark, sf_dir):
    folder = shared_folder(spark, "slippy-geotiffs")
    slippy.export_geotiff(_world(spark, sf_dir), folder, 2)
    s = read_files(spark, f"{folder}/*/*/*.tiff").select(*_address(F.col("path"), "tiff"), "tile").groupBy("z", "x", "y").agg(A.agg_stats("tile").alias("s"))
    return s.select("z", "x", "y", F.col("s.dataCells").cast("int").alias("n"), r6(F.col("s.mean")).alias("mean"))


@query(f"with {_WORLD} select z::int as z, x::int as x, y::int as y, 256 as n_rows, 256 as n_cols, 16711680::bigint as alpha from levels")
def slippy_pngs(spark, sf_dir):
    folder = shared_folder(spark, "slippy-pngs")
    slippy.export_png(_world(spark, sf_dir), folder, 2)

    def shapes(batches):
        for b in batches:
            seen = [render.pixels(f) for f in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *(pa.array([x.shape[k] for x in seen], pa.int32()) for k in (0, 1)), pa.array([int(x[..., 3].sum(dtype=np.int64)) for x in seen], pa.int64())], ["z", "x", "y", "n_rows", "n_cols", "alpha"])

    files = spark.read.format("binaryFile").load(f"{folder}/*/*/*.png").select(*_address(F.col("path"), "png"), "content")
    return files.mapInArrow(shapes, "z int, x int, y int, n_rows int, n_cols int, alpha long")
