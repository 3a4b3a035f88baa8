"""Spatial and temporal filters whose coarse part Spark itself can push down.

A filter on a geometry becomes comparisons with the box of each key, which are arithmetic on the key or columns of a layer
file, so that they reach the Parquet scan and skip row groups, and the exact predicate on what is left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.geometry import Geometry, _predicate_udf, contains, covers, geom_lit, intersects, polygon_of_box
from rasterloom.operators import layer
from rasterloom.operators.metadata import LayerMetadata


#: Exact predicates that stay where they are: below an aggregate by key they would be asked once for each row in place of each key.
_STAYING = {f.__name__: _predicate_udf(f).asNondeterministic() for f in (intersects, contains, covers)}


def key_limits(md: LayerMetadata, g: Geometry) -> tuple[tuple[int, int], tuple[int, int]]:
    """First and last column, first and last row, of keys whose extents meet the geometry's box, borders included."""
    xmin, xmax, ymin, ymax = g.box()
    e, w, h = md.layout.extent, md.layout.tile_width, md.layout.tile_height
    slack = 1e-9
    c0, c1 = (xmin - e.xmin) / w - 1 - slack, (xmax - e.xmin) / w + slack
    r0, r1 = (e.ymax - ymax) / h - 1 - slack, (e.ymax - ymin) / h + slack
    return (math.ceil(c0), math.floor(c1)), (math.ceil(r0), math.floor(r1))


def key_range(df: DataFrame, g: Geometry) -> Column:
    """Comparisons that hold for all keys whose extents meet the geometry's box."""
    cols, rows = key_limits(layer.tile_layer_metadata(df), g)
    key = F.col(layer.spatial_key_column(df))
    return key["col"].between(*cols) & key["row"].between(*rows)


def _bounds(df: DataFrame) -> Column:
    return F.col(layer.BOUNDS) if layer.BOUNDS in df.columns else polygon_of_box(*layer._box(df))


def where_intersects(df: DataFrame, g: Geometry) -> DataFrame:
    """Rows whose key meets the geometry."""
    return df.where(key_range(df, g)).where(_STAYING["intersects"](_bounds(df), geom_lit(g)))


def where_contains(df: DataFrame, g: Geometry) -> DataFrame:
    """Rows whose key contains the geometry."""
    return df.where(key_range(df, g)).where(_STAYING["contains"](_bounds(df), geom_lit(g)))


def where_covers(df: DataFrame, g: Geometry) -> DataFrame:
    return df.where(key_range(df, g)).where(_STAYING["covers"](_bounds(df), geom_lit(g)))


def join_points(df: DataFrame, points: DataFrame, x: str, y: str) -> DataFrame:
    """Rows of a layer with the points inside their keys, borders included.

    Each point names the keys that it may lie in (up to four, on borders), so this is a join on equal keys in place of a
    comparison of all pairs.
    """
    md, key = layer.tile_layer_metadata(df), layer.spatial_key_column(df)
    e, w, h = md.layout.extent, md.layout.tile_width, md.layout.tile_height
    c, r = (F.col(x) - F.lit(e.xmin)) / F.lit(w), (F.lit(e.ymax) - F.col(y)) / F.lit(h)

    def near(v: Column) -> Column:
        low = F.floor(v).cast("int")
        return F.when(v == low, F.array(low - 1, low)).otherwise(F.array(low))

    placed = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("_c", F.explode(near(c))).withColumn("_r", F.explode(near(r)))
    return df.join(placed, (F.col(f"{key}.col") == F.col("_c")) & (F.col(f"{key}.row") == F.col("_r"))).drop("_c", "_r")
