"""Layers as Parquet: one folder for each layer and zoom, tiles ordered along a Z curve, attributes beside them.

``<base>/<name>/<zoom>/tiles`` holds the columns of the layer and its index, by which files are dealt and sorted: column and row
of the key interleaved, for space-time layers column, row and the instant's period (a day, unless told otherwise).
``<base>/<name>/<zoom>/attributes`` holds one JSON line with header and metadata, which a catalog reads for all layers at once.
A geometry and an interval of time become a few intervals of the index, which reach the Parquet scan as comparisons and
let it skip row groups; so do filters on the key's fields, the timestamp or other columns.
"""

from __future__ import annotations

import datetime as dt
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.geometry import Geometry
from rasterloom.operators import layer
from rasterloom.operators.metadata import LayerMetadata
from rasterloom.operators.raster import with_tile_subdivisions
from rasterloom.plans import zcurve
from rasterloom.plans.pruning import key_limits, where_intersects

INDEX, DAY_MS = "_z", 86_400_000


@dataclass(frozen=True)
class Layer:
    """Where a layer is: base folder, name and zoom."""

    base: str
    name: str
    zoom: int

    @property
    def path(self) -> str:
        return f"{self.base.rstrip('/')}/{self.name}/{self.zoom}"


def _index(df: DataFrame, period: int) -> Column:
    key, time = F.col(layer.spatial_key_column(df)), layer.temporal_key_column(df)
    return zcurve.interleave(key["col"], key["row"], *([F.floor(F.col(time)["instant"] / F.lit(period))] if time else []))


def write_layer(df: DataFrame, to: Layer, tile_column: str | None = None, partitions: int | None = None, mode: str = "errorifexists", period: int = DAY_MS) -> None:
    """Write a layer; with ``tile_column`` only that tile. Rows are dealt by ranges of the index and sorted by it.

    ``period`` is the resolution of time in a space-time layer's index, in milliseconds.
    """
    md = layer.tile_layer_metadata(layer.as_rf(df))
    if tile_column is not None:
        df = df.drop(*[t for t in layer.tile_columns(df) if t != tile_column])
    key, time = layer.spatial_key_column(df), layer.temporal_key_column(df)
    kept = df.drop(layer.BOUNDS, layer.SPATIAL_INDEX, INDEX)
    out = kept.withColumn(INDEX, _index(kept, period))
    out = out.repartitionByRange(partitions, INDEX) if partitions else out.repartitionByRange(INDEX)
    out.sortWithinPartitions(INDEX).write.mode(mode).parquet(f"{to.path}/tiles")
    attributes = {"name": to.name, "zoom": to.zoom, "header": {"format": "parquet", "keyColumn": key, "timeColumn": time, "tiles": layer.tile_columns(kept), "columns": kept.columns, "index": INDEX, "period": period if time else None}, "metadata": md.json()}
    line = df.sparkSession.range(1).select(F.lit(json.dumps(attributes)).alias("value"))
    line.coalesce(1).write.mode("overwrite" if mode == "overwrite" else "errorifexists").text(f"{to.path}/attributes")


def _asked(df: DataFrame, head: dict, where: Geometry | None, between: tuple | None) -> Column | None:
    """Intervals of the index for what a geometry and two times can meet."""
    time = head["timeColumn"]
    if "index" not in head or where is None and (between is None or not time):
        return None
    top = (1 << zcurve.BITS[3 if time else 2]) - 1
    low, high = [0, 0], [top, top]
    if where is not None:
        (low[0], high[0]), (low[1], high[1]) = key_limits(layer.tile_layer_metadata(df), where)
    if time:
        ends = [layer._instant(t) // head["period"] for t in between] if between is not None else [0, top]
        low.append(ends[0])
        high.append(ends[1])
    return zcurve.within(F.col(head["index"]), zcurve.ranges(tuple(low), tuple(high)))


def read_attributes(spark: SparkSession, of: Layer) -> dict:
    return json.loads(spark.read.text(f"{of.path}/attributes").first()["value"])


def read_layer(spark: SparkSession, of: Layer, tile_subdivisions: int = 0, num_partitions: int | None = None, where: Geometry | None = None, bounds: bool = True, between: tuple[int | dt.datetime, int | dt.datetime] | None = None) -> DataFrame:
    """A layer: keys, timestamp, bounds, tiles and whatever else was written.

    ``where`` keeps keys that meet a geometry, ``between`` instants from one to another, both included: as intervals of the index
    and as comparisons that the scan sees, then the exact predicate.
    """
    if tile_subdivisions < 0:
        raise ValueError(f"cannot divide tiles by {tile_subdivisions}")
    a = read_attributes(spark, of)
    md, head = LayerMetadata.from_json(a["metadata"]), a["header"]
    df = layer.as_rf(spark.read.parquet(f"{of.path}/tiles"), head["keyColumn"], md, head["timeColumn"])
    wanted = _asked(df, head, where, between)
    df = (df if wanted is None else df.where(wanted)).select(*head["columns"])
    if between is not None:
        df = df.where(F.col(head["timeColumn"])["instant"].between(*map(layer._instant, between)))
    if where is not None:
        df = where_intersects(df, where)
    if tile_subdivisions > 1:
        df = with_tile_subdivisions(df, tile_subdivisions)
    if bounds and layer.BOUNDS not in df.columns:
        df = layer.with_bounds(df)
    return df.repartition(num_partitions) if num_partitions else df


def read_catalog(spark: SparkSession, base: str) -> DataFrame:
    """``index, layer, header, metadata``: one row for each layer under a base folder, without opening a tile."""
    lines = spark.read.text(f"{base.rstrip('/')}/*/*/attributes")
    at = lambda p: F.get_json_object("value", p)
    place = F.struct(F.lit(base).alias("base"), F.struct(at("$.name").alias("name"), at("$.zoom").cast("int").alias("zoom")).alias("id"))
    return lines.select(F.xxhash64(at("$.name"), at("$.zoom")).alias("index"), place.alias("layer"), at("$.header").alias("header"), at("$.metadata").alias("metadata"))
