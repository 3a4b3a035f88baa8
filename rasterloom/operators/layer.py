"""Layers: DataFrames with a spatial key, tile columns, and metadata on the key column."""

from __future__ import annotations

import datetime as dt
import json
import warnings
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import crs as projections
from rasterloom.celltype import CellType, of_dtype
from rasterloom.celltype import parse as parse_cell_type
from rasterloom.geometry import polygon_of_box
from rasterloom.operators.metadata import CONTEXT, ROLE, SPATIAL, TEMPORAL, Extent, KeyBounds, LayerMetadata, Layout, TileLayout
from rasterloom.tile import TILE_TYPE, Tile, is_tile

SPATIAL_KEY, TEMPORAL_KEY, TIMESTAMP, BOUNDS, CENTER, SPATIAL_INDEX, TILE, TILE_DATA, METADATA = "spatial_key", "temporal_key", "timestamp", "bounds", "center", "spatial_index", "tile", "tile_data", "metadata"
SPATIAL_KEY_TYPE = T.StructType([T.StructField("col", T.IntegerType()), T.StructField("row", T.IntegerType())])
TEMPORAL_KEY_TYPE = T.StructType([T.StructField("instant", T.LongType())])


# -- columns and their metadata -----------------------------------------------------------------------------------------


def _field(df: DataFrame, name: str) -> T.StructField:
    return df.schema[name]


def add_column_metadata(df: DataFrame, name: str, key: str, value) -> DataFrame:
    """Add an entry to a column's metadata."""
    return df.withMetadata(name, {**_field(df, name).metadata, key: value})


def map_column_attribute(df: DataFrame, name: str, change) -> DataFrame:
    """Replace a column's metadata by a function of it."""
    return df.withMetadata(name, change(dict(_field(df, name).metadata)))


def column_role(df: DataFrame, name: str) -> str | None:
    return _field(df, name).metadata.get(ROLE)


def set_spatial_role(df: DataFrame, name: str, metadata: LayerMetadata) -> DataFrame:
    return df.withMetadata(name, {**_field(df, name).metadata, ROLE: SPATIAL, CONTEXT: json.dumps(metadata.json())})


def set_temporal_role(df: DataFrame, name: str) -> DataFrame:
    return add_column_metadata(df, name, ROLE, TEMPORAL)


def tile_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if is_tile(f.dataType)]


def _with_role(df: DataFrame, role: str) -> list[str]:
    return [f.name for f in df.schema if f.metadata.get(ROLE) == role]


def spatial_key_column(df: DataFrame) -> str | None:
    found = _with_role(df, SPATIAL)
    return found[0] if found else None


def temporal_key_column(df: DataFrame) -> str | None:
    found = _with_role(df, TEMPORAL)
    return found[0] if found else None


def describe_full_schema(df: DataFrame) -> str:
    """The schema with all column metadata, as JSON."""
    return json.dumps(json.loads(df.schema.json()), indent=2)


# -- certification --------------------------------------------------------------------------------------------------------


def is_rf(df: DataFrame) -> bool:
    """Whether there is one spatial key with layer metadata, and a tile."""
    keys = _with_role(df, SPATIAL)
    return len(keys) == 1 and CONTEXT in _field(df, keys[0]).metadata and bool(tile_columns(df))


def as_rf(df: DataFrame, spatial_key: str | None = None, metadata: LayerMetadata | dict | str | None = None, temporal_key: str | None = None) -> DataFrame:
    """Certify a DataFrame as a layer; with a key and metadata, tag it first."""
    if spatial_key is not None:
        if isinstance(metadata, str):
            metadata = json.loads(metadata)
        if isinstance(metadata, dict):
            metadata = LayerMetadata.from_json(metadata)
        df = set_spatial_role(df, spatial_key, metadata)
        if temporal_key is not None:
            df = set_temporal_role(df, temporal_key)
    if not is_rf(df):
        raise ValueError("a layer needs one spatial key column with layer metadata and at least one tile column")
    return df


def as_rf_safely(df: DataFrame) -> DataFrame | None:
    return df if is_rf(df) else None


def tile_layer_metadata(df: DataFrame) -> LayerMetadata:
    key = spatial_key_column(df)
    if key is None or CONTEXT not in _field(df, key).metadata:
        raise ValueError("no column has layer metadata")
    return LayerMetadata.from_json(json.loads(_field(df, key).metadata[CONTEXT]))


def layer_crs(df: DataFrame) -> str:
    return tile_layer_metadata(df).crs


# -- keys to map space ------------------------------------------------------------------------------------------------------


def _box(df: DataFrame) -> tuple[Column, Column, Column, Column]:
    """xmin, ymin, xmax, ymax of each row's key, as arithmetic on it."""
    layout, key = tile_layer_metadata(df).layout, F.col(spatial_key_column(df))
    x = F.lit(layout.extent.xmin) + key["col"] * F.lit(layout.tile_width)
    y = F.lit(layout.extent.ymax) - key["row"] * F.lit(layout.tile_height)
    return x, y - F.lit(layout.tile_height), x + F.lit(layout.tile_width), y


def map_transform(df: DataFrame):
    """The layout, whose ``key_extent``, ``point_key`` and ``extent_keys`` go between keys and map coordinates."""
    return tile_layer_metadata(df).layout


def point_key(df: DataFrame, x: Column, y: Column) -> Column:
    """The spatial key of points in map coordinates, as a struct; a key's upper and left edges belong to it."""
    layout = tile_layer_metadata(df).layout
    col, row = (x - F.lit(layout.extent.xmin)) / F.lit(layout.tile_width), (F.lit(layout.extent.ymax) - y) / F.lit(layout.tile_height)
    return F.struct(F.floor(col).cast("int").alias("col"), F.floor(row).cast("int").alias("row"))


def with_bounds(df: DataFrame, name: str = BOUNDS) -> DataFrame:
    """Add the polygon (WKB) that each key covers."""
    return df.withColumn(name, polygon_of_box(*_box(df)))


def with_bbox(df: DataFrame, name: str = "bbox") -> DataFrame:
    """Add the box of each key as a struct of doubles, for filters that reach a Parquet scan."""
    return df.withColumn(name, F.struct(*[c.alias(n) for c, n in zip(_box(df), ("xmin", "ymin", "xmax", "ymax"))]))


def with_center(df: DataFrame, name: str = CENTER) -> DataFrame:
    """Add the centre of each key, as a struct of x and y."""
    x0, y0, x1, y1 = _box(df)
    return df.withColumn(name, F.struct(((x0 + x1) / 2).alias("x"), ((y0 + y1) / 2).alias("y")))


def _lat_lng(crs: str):
    kind = T.StructType([T.StructField("longitude", T.DoubleType()), T.StructField("latitude", T.DoubleType())])

    @F.arrow_udf(kind)
    def run(x: pa.Array, y: pa.Array) -> pa.Array:
        lon, lat = projections.unproject(crs, x.to_numpy(zero_copy_only=False), y.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(lon), pa.array(lat)], ["longitude", "latitude"])

    return run


def _center_lat_lng(df: DataFrame) -> Column:
    x0, y0, x1, y1 = _box(df)
    x, y = (x0 + x1) / 2, (y0 + y1) / 2
    crs = layer_crs(df)
    if projections.parse(crs)["proj"] in ("longlat", "latlong"):
        return F.struct(x.alias("longitude"), y.alias("latitude"))
    return _lat_lng(crs)(x, y)


def with_center_lat_lng(df: DataFrame, name: str = CENTER) -> DataFrame:
    return df.withColumn(name, _center_lat_lng(df))


def z2(lon: Column, lat: Column) -> Column:
    """Index on the Z curve: 31 bits of longitude and latitude, interleaved with longitude in the even bits; no Python."""
    cells = 1 << 31

    def spread(v: Column) -> Column:
        for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    def scaled(v: Column, low: float, high: float) -> Column:
        return F.least(F.greatest(F.floor((v - low) / (high - low) * cells), F.lit(0)), F.lit(cells - 1)).cast("long")

    return spread(scaled(lon, -180.0, 180.0)).bitwiseOR(F.shiftleft(spread(scaled(lat, -90.0, 90.0)), 1))


def with_spatial_index(df: DataFrame, name: str = SPATIAL_INDEX, ordered: bool = True) -> DataFrame:
    """Add the Z index of each key's centre, and sort by it unless told otherwise."""
    c = _center_lat_lng(df)
    out = df.withColumn(name, z2(c["longitude"], c["latitude"]))
    return out.orderBy(name) if ordered else out


# -- time -------------------------------------------------------------------------------------------------------------------


def with_timestamp(df: DataFrame, name: str = TIMESTAMP) -> DataFrame:
    return df.withColumn(name, F.timestamp_millis(F.col(temporal_key_column(df))["instant"]))


def _instant(t: int | dt.datetime) -> int:
    if isinstance(t, dt.datetime):
        t = t if t.tzinfo else t.replace(tzinfo=dt.timezone.utc)
        return round(t.timestamp() * 1000)
    return int(t)


def add_temporal_component(df: DataFrame, time: int | dt.datetime) -> DataFrame:
    """Give all rows one temporal key (epoch milliseconds or a time; without a zone it is UTC)."""
    if temporal_key_column(df) is not None:
        raise ValueError("the layer has a temporal key already")
    md, instant = tile_layer_metadata(df), _instant(time)
    md = replace(md, bounds=replace(md.bounds, instant_min=instant, instant_max=instant))
    out = df.withColumn(TEMPORAL_KEY, F.struct(F.lit(instant).cast("long").alias("instant")))
    return as_rf(out, spatial_key_column(df), md, TEMPORAL_KEY)


def between_times(column: str | Column, a: dt.datetime, b: dt.datetime) -> Column:
    """Both ends included."""
    c = F.col(column) if isinstance(column, str) else column
    return c.between(F.lit(a), F.lit(b))


def at_time(column: str | Column, t: dt.datetime) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    return c == F.lit(t)


# -- names ------------------------------------------------------------------------------------------------------------------


def with_column_renamed(df: DataFrame, old: str, new: str) -> DataFrame:
    return df.withColumnRenamed(old, new)


def with_prefixed_names(df: DataFrame, prefix: str) -> DataFrame:
    return df.toDF(*[prefix + c for c in df.columns])


def parquet_friendly(name: str) -> str:
    """A column name without characters that Parquet refuses."""
    return "".join("_" if c in " ,;{}()\n\t=" else c for c in name)


# -- bounds -----------------------------------------------------------------------------------------------------------------


def clip_layer_extent(df: DataFrame) -> DataFrame:
    """Metadata whose bounds and extent are those of the keys that are there; one aggregate over the keys alone."""
    md, key, time = tile_layer_metadata(df), spatial_key_column(df), temporal_key_column(df)
    wanted = [F.min(f"{key}.col"), F.min(f"{key}.row"), F.max(f"{key}.col"), F.max(f"{key}.row")]
    wanted += [F.min(f"{time}.instant"), F.max(f"{time}.instant")] if time else []
    found = tuple(df.agg(*wanted).first())
    if found[0] is None:
        return df
    bounds = KeyBounds(*found)
    low, high = md.layout.key_extent(bounds.col_min, bounds.row_min), md.layout.key_extent(bounds.col_max, bounds.row_max)
    own = Extent(low.xmin, high.ymin, high.xmax, low.ymax).intersection(md.extent) or md.extent
    return set_spatial_role(df, key, replace(md, bounds=bounds, extent=own))


# -- rasters to layers --------------------------------------------------------------------------------------------------------


def layout_for(extent: Extent, cols: int, rows: int, tile_cols: int, tile_rows: int) -> Layout:
    """The grid of tiles over a raster; its extent reaches beyond the raster where tiles do not fill it."""
    n, m = -(-cols // tile_cols), -(-rows // tile_rows)
    w, h = extent.width / cols, extent.height / rows
    return Layout(Extent(extent.xmin, extent.ymax - m * tile_rows * h, extent.xmin + n * tile_cols * w, extent.ymax), TileLayout(n, m, tile_cols, tile_rows))


def from_raster(spark: SparkSession, cells: np.ndarray | list[np.ndarray], extent: Extent, crs: str = projections.LATLNG, tile_cols: int | None = None, tile_rows: int | None = None, time: int | dt.datetime | None = None, cell_type: str | None = None, name: str = TILE) -> DataFrame:
    """A layer from one raster on the driver (several bands give ``name_1`` and so on), cut into tiles; edges are filled with NoData.

    The raster is sent row by row of tiles, as it is in the driver's memory anyway; larger images are read by the GeoTIFF source.
    """
    bands = [np.asarray(b) for b in cells] if isinstance(cells, list) or np.ndim(cells) == 3 else [np.asarray(cells)]
    rows, cols = bands[0].shape
    w, h = tile_cols or cols, tile_rows or rows
    ct: CellType = parse_cell_type(cell_type) if cell_type else of_dtype(bands[0].dtype)
    layout = layout_for(extent, cols, rows, w, h)
    names = [name] if len(bands) == 1 else [f"{name}_{k}" for k in range(1, len(bands) + 1)]
    fill = np.full(1, np.nan)

    def cut(band: np.ndarray, c: int, r: int) -> tuple:
        part = band[r * h : (r + 1) * h, c * w : (c + 1) * w].astype(ct.native)
        if part.shape != (h, w):
            padded = np.full((h, w), ct.from_doubles(fill)[0], ct.native)
            padded[: part.shape[0], : part.shape[1]] = part
            part = padded
        return Tile(ct, part).row()

    data = [((c, r), *(cut(b, c, r) for b in bands)) for r in range(layout.tiles.layout_rows) for c in range(layout.tiles.layout_cols)]
    schema = T.StructType([T.StructField(SPATIAL_KEY, SPATIAL_KEY_TYPE), *(T.StructField(n, TILE_TYPE) for n in names)])
    bounds = KeyBounds(0, 0, layout.tiles.layout_cols - 1, layout.tiles.layout_rows - 1)
    out = as_rf(spark.createDataFrame(data, schema), SPATIAL_KEY, LayerMetadata(ct.name, layout, extent, crs, bounds))
    return out if time is None else with_timestamp(add_temporal_component(out, time))


def from_tiles(spark: SparkSession, rows: list[tuple], metadata: LayerMetadata, name: str = TILE) -> DataFrame:
    """A layer from (col, row, tile) or (col, row, instant, tile) on the driver."""
    temporal = metadata.temporal
    fields = [T.StructField(SPATIAL_KEY, SPATIAL_KEY_TYPE), *([T.StructField(TEMPORAL_KEY, TEMPORAL_KEY_TYPE)] if temporal else []), T.StructField(name, TILE_TYPE)]
    data = [((r[0], r[1]), *([(r[2],)] if temporal else []), r[-1].row() if r[-1] is not None else None) for r in rows]
    out = as_rf(spark.createDataFrame(data, T.StructType(fields)), SPATIAL_KEY, metadata, TEMPORAL_KEY if temporal else None)
    return with_timestamp(out) if temporal else out


def to_tile_layer(df: DataFrame, tile: str) -> DataFrame:
    """Key and one tile column."""
    return to_multiband_tile_layer(df, [tile])


def to_multiband_tile_layer(df: DataFrame, tiles: list[str]) -> DataFrame:
    """Key and some tile columns."""
    keys = [k for k in (spatial_key_column(df), temporal_key_column(df)) if k]
    return df.select(*keys, *tiles)


# -- joins --------------------------------------------------------------------------------------------------------------------


def spatial_join(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join two layers on their spatial keys, and on their temporal keys where both have one.

    After an inner join the left names of the keys are restored and the right keys dropped; other joins keep both, as
    ``left_...`` and ``right_...``. Semi and anti joins keep the left columns as they are. Layouts that differ are warned of.
    The keys are plain structs, so the join is Spark's: broadcast, hash or merge, with its handling of skew.
    """
    lm, rm = tile_layer_metadata(left), tile_layer_metadata(right)
    if lm.layout != rm.layout:
        warnings.warn("the layers have different layouts, equal keys may stand for different places", stacklevel=2)
    ls, rs, lt, rt = spatial_key_column(left), spatial_key_column(right), temporal_key_column(left), temporal_key_column(right)
    lkeys, rkeys = [k for k in (ls, lt) if k], [k for k in (rs, rt) if k]
    a = left.select(*[F.col(c).alias(f"left_{c}", metadata=_field(left, c).metadata) if c in lkeys else F.col(c) for c in left.columns])
    b = right.select(*[F.col(c).alias(f"right_{c}", metadata=_field(right, c).metadata) if c in rkeys else F.col(c) for c in right.columns])
    on = a[f"left_{ls}"] == b[f"right_{rs}"]
    if lt and rt:
        on = on & (a[f"left_{lt}"] == b[f"right_{rt}"])
    out = a.join(b, on, how)
    kind = how.lower().replace("_", "")
    if kind in ("leftsemi", "semi", "leftanti", "anti"):
        return out.select(*[F.col(f"left_{c}").alias(c, metadata=_field(left, c).metadata) if c in lkeys else F.col(c) for c in left.columns])
    if kind != "inner":
        return out
    for k in rkeys:
        out = out.drop(f"right_{k}")
    for k in lkeys:
        out = out.withColumnRenamed(f"left_{k}", k)
    return set_spatial_role(out, ls, lm)
