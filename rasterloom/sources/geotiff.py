"""GeoTIFF source and sink.

``geotiff`` is a Python data source: the driver reads the tags, each task reads the blocks of some rows of tiles, in ranges, from
local paths and the stores that pyarrow reaches. Tiled files give a row for each internal tile; striped files are cut into tiles of at
most 256 cells a side, and tasks read the strips that their tiles cover. :func:`read_files` reads many files through Spark's
own binary reader, from whatever store that can reach; so does :func:`read_geotiff` where only Spark reaches the file.

Files are written by the tasks: blocks are put together by key and compressed, the driver gets their sizes alone and writes the
directory, and tasks put the blocks to their places in the file, or one task streams them where a store has no such writes.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from rasterloom.celltype import parse, union
from rasterloom.functions import mosaic
from rasterloom.geometry import Geometry, box
from rasterloom.operators import layer
from rasterloom.operators.metadata import KeyBounds, LayerMetadata, Layout
from rasterloom.operators.raster import NEAREST, resampled
from rasterloom.plans.pruning import key_limits, where_intersects
from rasterloom.runtime import staged
from rasterloom.sources import storage
from rasterloom.sources.storage import reaches
from rasterloom.sources.tiff import Form, Tiff
from rasterloom.tile import ARROW_TILE, TILE_TYPE, build

LARGEST = 256
#: Tiles that one task reads, and tiles of one Arrow batch.
TILES_PER_TASK, TILES_PER_BATCH = 64, 16


def layout_of(t: Tiff) -> Layout:
    cols, rows = t.block if t.tiled else (min(LARGEST, t.width), min(LARGEST, t.height))
    return layer.layout_for(t.extent, t.width, t.height, cols, rows)


def metadata_of(t: Tiff) -> LayerMetadata:
    layout = layout_of(t)
    return LayerMetadata(t.cell_type.name, layout, t.extent, t.crs, KeyBounds(0, 0, layout.tiles.layout_cols - 1, layout.tiles.layout_rows - 1))


def _tile_names(bands: int) -> list[str]:
    return ["tile"] if bands == 1 else [f"tile_{k}" for k in range(1, bands + 1)]


def schema_of(bands: int, context: str | None = None) -> T.StructType:
    tag = {layer.ROLE: layer.SPATIAL, layer.CONTEXT: context} if context else {}
    return T.StructType(
        [
            T.StructField("spatial_key", layer.SPATIAL_KEY_TYPE, True, tag),
            T.StructField("bounds", T.BinaryType()),
            T.StructField("metadata", T.MapType(T.StringType(), T.StringType())),
            *(T.StructField(n, TILE_TYPE) for n in _tile_names(bands)),
        ]
    )


def _batch(t: Tiff, layout: Layout, keys: list[tuple[int, int]], more: dict[str, str] | None = None) -> pa.RecordBatch:
    """Rows of some keys, as Arrow columns; ``more`` are constants before them."""
    n, w, h = len(keys), layout.tiles.tile_cols, layout.tiles.tile_rows
    cells = np.empty((t.bands, n, h * w), t.cell_type.native)
    bounds = []
    for i, (c, r) in enumerate(keys):
        cells[:, i] = t.window(c * w, r * h, w, h).reshape(t.bands, -1)
        e = layout.key_extent(c, r)
        bounds.append(box(e.xmin, e.ymin, e.xmax, e.ymax).wkb())
    at = pa.StructArray.from_arrays([pa.array([k[j] for k in keys], pa.int32()) for j in range(2)], ["col", "row"])
    tags = pa.array([list(t.metadata().items())] * n, pa.map_(pa.string(), pa.string()))
    tiles = [build(n, [(np.arange(n), t.cell_type, w, h, b)]) if n else pa.array([], ARROW_TILE) for b in cells]
    own = more or {}
    columns = [*(pa.array([v] * n, pa.string()) for v in own.values()), at, pa.array(bounds, pa.binary()), tags, *tiles]
    return pa.RecordBatch.from_arrays(columns, [*own, "spatial_key", "bounds", "metadata", *_tile_names(t.bands)])


def _keys(layout: Layout, cols: tuple[int, int] | None = None, rows: tuple[int, int] | None = None) -> list[tuple[int, int]]:
    """Keys of a layout, or those from the first to the last column and row given."""
    c0, c1 = cols or (0, layout.tiles.layout_cols - 1)
    r0, r1 = rows or (0, layout.tiles.layout_rows - 1)
    return [(c, r) for r in range(max(0, r0), min(layout.tiles.layout_rows - 1, r1) + 1) for c in range(max(0, c0), min(layout.tiles.layout_cols - 1, c1) + 1)]


class Keys(InputPartition):
    def __init__(self, keys: list[tuple[int, int]]) -> None:
        self.keys = keys


class GeoTiffReader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, cols: tuple[int, int] | None, rows: tuple[int, int] | None) -> None:
        self.path, self.layout, self.cols, self.rows = path, layout, cols, rows

    def partitions(self) -> list[InputPartition]:
        keys = _keys(self.layout, self.cols, self.rows)
        return [Keys(keys[i : i + TILES_PER_TASK]) for i in range(0, len(keys), TILES_PER_TASK)] or [Keys([])]

    def read(self, partition: Keys) -> Iterator[pa.RecordBatch]:
        t = Tiff.open(self.path)
        with t.file:
            for at in range(0, len(partition.keys), TILES_PER_BATCH):
                yield _batch(t, self.layout, partition.keys[at : at + TILES_PER_BATCH])


class PushingReader(GeoTiffReader):
    """For sessions that let Python sources have filters (``spark.sql.python.filterPushdown.enabled``)."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Equality on the key's fields chooses tiles; everything is checked again by Spark."""
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("spatial_key", "col"):
                self.cols = _narrower(self.cols, f.value)
            elif isinstance(f, EqualTo) and f.attribute == ("spatial_key", "row"):
                self.rows = _narrower(self.rows, f.value)
            yield f


def _narrower(limits: tuple[int, int] | None, value: int) -> tuple[int, int]:
    return (value, value) if limits is None else (max(limits[0], value), min(limits[1], value))


class GeoTiffSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "geotiff"

    def _open(self) -> Tiff:
        if "path" not in self.options:
            raise ValueError("geotiff needs a path")
        return Tiff.open(self.options["path"])

    def schema(self) -> T.StructType:
        t = self._open()
        with t.file:
            return schema_of(t.bands)

    def reader(self, schema: T.StructType) -> DataSourceReader:
        t = self._open()
        with t.file:
            kind = PushingReader if self.options.get("pushdown", "false").lower() == "true" else GeoTiffReader
            limits = [tuple(map(int, self.options[n].split(","))) if n in self.options else None for n in ("columns", "rows")]
            return kind(self.options["path"], layout_of(t), *limits)


def read_geotiff(spark: SparkSession, path: str, where: Geometry | None = None) -> DataFrame:
    """A layer of one file; its metadata is on the key column. ``where`` keeps keys that meet a geometry, and only their blocks are read.

    Filters on the key's fields choose blocks too in sessions with ``spark.sql.python.filterPushdown.enabled``. A file that Python
    cannot open, as only Spark knows its store, is read whole by one task (so it has to be under 2 GB).
    """
    if not reaches(path):
        return _through_spark(spark, path, where)
    spark.dataSource.register(GeoTiffSource)
    t = Tiff.open(path)
    with t.file:
        md = metadata_of(t)
    reader = spark.read.format("geotiff").option("pushdown", spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"))
    if where is not None:
        cols, rows = key_limits(md, where)
        reader = reader.option("columns", f"{cols[0]},{cols[1]}").option("rows", f"{rows[0]},{rows[1]}")
    out = layer.as_rf(reader.load(path), layer.SPATIAL_KEY, md)
    return out if where is None else where_intersects(out, where)


def _through_spark(spark: SparkSession, path: str, where: Geometry | None) -> DataFrame:
    """The same by Spark's binary reader; of the tags only number of bands and metadata come to the driver."""

    def tags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0):
                t = Tiff.open(content.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([t.bands], pa.int32()), pa.array([json.dumps(metadata_of(t).json())])], ["bands", "context"])

    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(tags, "bands int, context string").first()
    if found is None:
        raise FileNotFoundError(path)
    out = layer.as_rf(read_files(spark, path, found["bands"]).drop("path", "context"), layer.SPATIAL_KEY, LayerMetadata.from_json(json.loads(found["context"])))
    return out if where is None else where_intersects(out, where)


def read_files(spark: SparkSession, path: str, bands: int = 1) -> DataFrame:
    """``path, context`` (layer metadata as JSON) and the columns of a layer, for all files under a path or glob.

    Each file is read whole by one task, so this is for many files of moderate size. Files have to have ``bands`` bands.
    """
    schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("context", T.StringType()), *schema_of(bands)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                t = Tiff.open(content.as_py())
                if t.bands != bands:
                    raise ValueError(f"{name} has {t.bands} bands, not {bands}")
                layout = layout_of(t)
                more, keys = {"path": name.as_py(), "context": json.dumps(metadata_of(t).json())}, _keys(layout)
                for at in range(0, len(keys), TILES_PER_BATCH):
                    yield _batch(t, layout, keys[at : at + TILES_PER_BATCH], more)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


#: Sides of the square blocks of files that are written.
SIDE = 256


def _block_parts(df: DataFrame, names: list[str], form: Form, layout: Layout, method: str) -> DataFrame:
    """Each tile's cells in the file, cut at the borders of its blocks: ``block`` and the columns of a mosaic's parts."""
    key, time = layer.spatial_key_column(df), layer.temporal_key_column(df)
    n, (bw, bh) = len(names), form.block

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, at, own in resampled(b, n, layout, form.extent, form.width, form.height, method):
                when, blocks, places, cells = b.column(n + 1)[i].as_py(), [], [], []
                for r in range(at.row // bh, -(-(at.row + at.rows) // bh)):
                    for c in range(at.col // bw, -(-(at.col + at.cols) // bw)):
                        x0, x1, y0, y1 = max(at.col, c * bw), min(at.col + at.cols, (c + 1) * bw), max(at.row, r * bh), min(at.row + at.rows, (r + 1) * bh)
                        blocks.append(r * form.across + c)
                        places.append((x0 - c * bw, y0 - r * bh, x1 - x0, y1 - y0))
                        cells.append([None if v is None else np.ascontiguousarray(v[1][y0 - at.row : y1 - at.row, x0 - at.col : x1 - at.col]).tobytes() for v in own])
                yield mosaic.part_batch({"block": pa.array(blocks, pa.int64())}, places, [when] * len(blocks), cells)

    instant = F.coalesce(F.col(time)["instant"], F.lit(mosaic.NO_TIME)) if time else F.lit(mosaic.NO_TIME)
    return df.select(F.col(key).alias("_key"), *names, instant.alias("_instant")).mapInArrow(run, f"block long, {mosaic.PART}")


def write_geotiff(df: DataFrame, path: str, image_width: int | None = None, image_height: int | None = None, tiles: list[str] | None = None, strips: bool = False, method: str = NEAREST) -> None:
    """Write a layer as one file, by default at its own resolution, in square blocks or in strips.

    Of tiles for the same place (temporal layers) each cell is the latest one's with data, of equal times the greatest value. Blocks
    that no tile covers are NoData and share the bytes of one. No cell goes to the driver: it gets two numbers for each block.
    On file systems that are mounted everywhere tasks write to their places in the one file; elsewhere one task streams the blocks.
    """
    df = layer.clip_layer_extent(layer.as_rf(df))
    md, names = layer.tile_layer_metadata(df), tiles or layer.tile_columns(df)
    width = image_width or round(md.extent.width / md.layout.tile_width * md.layout.tiles.tile_cols)
    height = image_height or round(md.extent.height / md.layout.tile_height * md.layout.tiles.tile_rows)
    kinds = [r[0] for r in df.select(F.explode(F.array(*[F.col(n)["cellType"] for n in names])).alias("k")).where("k is not null").distinct().orderBy("k").collect()]
    form = Form(width, height, len(names), reduce(union, map(parse, kinds)) if kinds else parse(md.cell_type), md.extent, md.crs, None if strips else SIDE)
    whole = mosaic.merged(_block_parts(df, names, form, md.layout, method), ["block"], form.bands, *form.block)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = []
            for k, cells in zip(b.column(0).to_pylist(), b.column(1)):
                rows = form.window(k)[3]
                x = np.stack([np.frombuffer(c.as_buffer(), np.float64).reshape(form.block[::-1]) for c in cells.values])[:, :rows]
                data.append(form.pack(form.cell_type.from_doubles(x)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], ["block", "size", "data"])

    blocks = staged(whole.mapInArrow(packed, "block long, size long, data binary"))
    head, places = _planned(form, blocks.select("block", "size").toArrow())
    _written(blocks, path, head, places)


def _planned(form: Form, found: pa.Table) -> tuple[bytes, np.ndarray]:
    """All that stands before the blocks that were made, and the place of each block in the file; -1: it is none of them."""
    sizes = np.full(form.blocks, -1, np.int64)
    sizes[found["block"].to_numpy()] = found["size"].to_numpy()
    made = sizes >= 0
    empty, shared = b"", {}
    for k in np.flatnonzero(~made).tolist():
        w, h = form.window(k)[2:]
        if (w, h) not in shared:
            one = form.pack(form.cell_type.from_doubles(np.full((form.bands, h, w), np.nan)))
            shared[w, h] = len(empty), len(one)
            empty += one
    places = np.zeros(form.blocks, np.int64)
    places[made] = len(empty) + np.concatenate(([0], np.cumsum(sizes[made])[:-1]))
    for k in np.flatnonzero(~made).tolist():
        places[k], sizes[k] = shared[form.window(k)[2:]]
    directory = form.directory(sizes.tolist(), places.tolist(), int(sizes.sum()) + len(empty))
    return directory + empty, np.where(made, places + len(directory), -1)


def _written(blocks: DataFrame, path: str, head: bytes, places: np.ndarray) -> None:
    """The file: blocks at their places by the tasks that have them, or in order by one task."""
    sent = blocks.sparkSession.sparkContext.broadcast(places)  # as large as the file's own directory
    target = storage.local(path)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(part, "r+b") as f:
            for b in batches:
                for k, data in zip(b.column(0).to_pylist(), b.column(1)):
                    os.pwrite(f.fileno(), data.as_buffer(), int(sent.value[k]))
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = storage.place(path)
        n = 0
        with store.open_output_stream(at) as f:
            f.write(head)
            for b in batches:
                for data in b.column(1):
                    f.write(data.as_buffer())
                    n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    own = blocks.select("block", "data")
    if target is None:
        own.repartition(1).sortWithinPartitions("block").mapInArrow(stream, "n long").collect()
        return
    os.makedirs(os.path.dirname(target), exist_ok=True)
    part = f"{target}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        f.write(head)
    if own.mapInArrow(put, "n long").agg(F.sum("n")).first()[0] not in (None, int((places >= 0).sum())):
        raise RuntimeError(f"blocks of {path} are missing")
    os.replace(part, target)
