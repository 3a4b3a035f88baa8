"""Set up a session: SQL functions, data sources, methods."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.functions import ArrowUDFType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from rasterloom import celltype, geometry
from rasterloom.functions import aggregate, local_aggregate, payload, scalar
from rasterloom.operators import layer
from rasterloom.runtime import ship
from rasterloom.sources.geotiff import GeoTiffSource, read_geotiff
from rasterloom.sources.layers import Layer, read_catalog, read_layer
from rasterloom.tile import TILE_TYPE, Tile

#: SQL function bodies that need no Python.
SQL_BODIES = {
    "rf_tileDimensions": ("tile {t}", "struct<cols:smallint,rows:smallint>", "if(tile is null, null, named_struct('cols', tile.cols, 'rows', tile.rows))"),
    "rf_cellType": ("tile {t}", "string", "tile.cellType"),
}


@F.arrow_udf(TILE_TYPE)
def _constant(value: pa.Array, cols: pa.Array, rows: pa.Array, names: pa.Array) -> pa.Array:
    import numpy as np

    out = []
    for v, c, r, n in zip(*(x.to_pylist() for x in (value, cols, rows, names))):
        if None in (v, c, r, n):
            out.append(None)
            continue
        ct = celltype.parse(n)
        payload_ = scalar.pack(ct, np.full((1, c * r if ct.family == "bool" else 1), v).astype(ct.native))[0]
        out.append({"cellType": ct.name, "cols": c, "rows": r, "data": payload_})
    return pa.array(out, pa.struct([("cellType", pa.string()), ("cols", pa.int16()), ("rows", pa.int16()), ("data", pa.binary())]))


@F.arrow_udf(TILE_TYPE)
def _convert(tiles: pa.Array, names: pa.Array) -> pa.Array:
    from rasterloom.tile import build, groups

    wanted, parts = names.to_pylist(), []
    for g in groups(tiles):
        for k, i in enumerate(g.at.tolist()):
            ct = celltype.parse(wanted[i])
            parts.append((g.at[k : k + 1], ct, g.cols, g.rows, ct.from_doubles(g.cell_type.doubles(g.cells[k : k + 1]))))
    return build(len(tiles), parts)


@F.arrow_udf(TILE_TYPE)
def _with_nodata(tiles: pa.Array, values: pa.Array) -> pa.Array:
    from rasterloom.tile import build, groups

    wanted, parts = values.to_pylist(), []
    for g in groups(tiles):
        for k, i in enumerate(g.at.tolist()):
            parts.append((g.at[k : k + 1], celltype.with_nodata(g.cell_type, wanted[i]), g.cols, g.rows, g.cells[k : k + 1]))
    return build(len(tiles), parts)


@F.arrow_udf(TILE_TYPE)
def _array_to_tile(arrays: pa.Array, cols: pa.Array, rows: pa.Array) -> pa.Array:
    import numpy as np

    out = []
    for a, c, r in zip(*(x.to_pylist() for x in (arrays, cols, rows))):
        out.append(None if not a else dict(zip(("cellType", "cols", "rows", "data"), Tile.of(np.array(a, float).reshape(r, c), "float64raw").row())))
    return pa.array(out, pa.struct([("cellType", pa.string()), ("cols", pa.int16()), ("rows", pa.int16()), ("data", pa.binary())]))


def _grouped(kernel, kind: T.DataType):
    """A grouped aggregate for SQL over raw tiles: simple, but tiles of a group are shuffled to one task."""

    def run(tiles: pa.Array) -> object:
        return kernel(tiles).to_pylist()[0]

    run.__annotations__ = {"tiles": pa.Array, "return": object}

    return F.arrow_udf(run, kind, ArrowUDFType.GROUPED_AGG)


def _one(tiles: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(tiles)], pa.int32()), tiles if isinstance(tiles, pa.Array) else tiles.combine_chunks())


def _agg_stats(tiles: pa.Array) -> pa.Array:
    p = [x for x in aggregate.UDF_PARTIAL.func(tiles).to_pylist() if x]
    n = sum(x["n"] for x in p)
    if not n:
        return pa.array([{"dataCells": 0, "min": None, "max": None, "mean": float("nan"), "variance": float("nan")}])
    mean = sum(x["sum"] for x in p) / n
    some = [x for x in p if x["n"]]
    return pa.array([{"dataCells": n, "min": min(x["min"] for x in some), "max": max(x["max"] for x in some), "mean": mean, "variance": max(sum(x["squares"] for x in p) / n - mean * mean, 0.0)}])


def _sum_of(field: str):
    def run(tiles: pa.Array) -> pa.Array:
        p = [x for x in aggregate.UDF_PARTIAL.func(tiles).to_pylist() if x]
        return pa.array([sum(x["n"] for x in p) if field == "n" else sum(x["cells"] - x["n"] for x in p)])

    return run


def _agg_mean(tiles: pa.Array) -> pa.Array:
    stats = _agg_stats(tiles).to_pylist()[0]
    return pa.array([stats["mean"] if stats["dataCells"] else None], pa.float64())


def _agg_histogram(tiles: pa.Array) -> pa.Array:
    binned = aggregate.UDF_BINNED.func(tiles)
    return aggregate.UDF_MERGE_BINNED.func(_one(binned.drop_null()))


def _local(name: str):
    return lambda tiles: local_aggregate.UDF_MERGED[name].func(_one(tiles))


def _local_stats(tiles: pa.Array) -> pa.Array:
    parts = {n: local_aggregate.UDF_MERGED[n].func(_one(tiles)).to_pylist()[0] for n in local_aggregate.STATS}
    return pa.array([parts if parts["count"] is not None else None])


def _assembled():
    """``rf_assembleTile(column, row, cell, columns, rows, type)`` over a group's cells."""
    import numpy as np

    def run(c: pa.Array, r: pa.Array, v: pa.Array, cols: pa.Array, rows: pa.Array, kind: pa.Array) -> object:
        w, h, ct = cols[0].as_py(), rows[0].as_py(), celltype.parse(kind[0].as_py())
        x, y = (a.to_numpy(zero_copy_only=False).astype(np.int64) for a in (c, r))
        value = v.cast(pa.float64()).to_numpy(zero_copy_only=False)
        if ((x < 0) | (x >= w) | (y < 0) | (y >= h)).any():
            raise ValueError(f"cell index outside of {w} x {h}")
        out = np.full((h, w), np.nan)
        order = np.argsort(value, kind="stable")  # NaN last
        order = np.concatenate([order[np.isnan(value[order])], order[~np.isnan(value[order])]])
        out[y[order], x[order]] = value[order]
        return dict(zip(("cellType", "cols", "rows", "data"), Tile(ct, ct.from_doubles(out)).row()))

    run.__annotations__ = {**{n: pa.Array for n in ("c", "r", "v", "cols", "rows", "kind")}, "return": object}
    return F.arrow_udf(run, TILE_TYPE, ArrowUDFType.GROUPED_AGG)


def register_functions(spark: SparkSession) -> None:
    """All SQL functions. Aggregates are grouped ones here; :func:`sql` and the DataFrame functions compose them of partial sums."""
    u = spark.udf.register
    for name, f in {
        "rf_tileMean": scalar.UDF_MEAN, "rf_tileSum": scalar.UDF_SUM, "rf_tileMin": scalar.UDF_MIN, "rf_tileMax": scalar.UDF_MAX,
        "rf_tileStats": scalar.UDF_STATS, "rf_tileHistogram": scalar.UDF_HISTOGRAM, "rf_dataCells": scalar.UDF_DATA_CELLS, "rf_noDataCells": scalar.UDF_NO_DATA_CELLS,
        "rf_localAdd": scalar.UDF_ALGEBRA["Add"], "rf_localSubtract": scalar.UDF_ALGEBRA["Subtract"], "rf_localMultiply": scalar.UDF_ALGEBRA["Multiply"], "rf_localDivide": scalar.UDF_ALGEBRA["Divide"],
        "rf_normalizedDifference": scalar.UDF_NORMALIZED, "rf_renderAscii": scalar.UDF_ASCII, "rf_tileToArrayInt": scalar.UDF_TO_ARRAY["int"], "rf_tileToArrayDouble": scalar.UDF_TO_ARRAY["double"],
        "rf_makeConstantTile": _constant, "rf_convertCellType": _convert, "rf_withNoData": _with_nodata, "rf_arrayToTile": _array_to_tile, "rf_merge": payload.UDF_MERGE,
        "rf_tilePartial": aggregate.UDF_PARTIAL, "rf_tileBins": aggregate.UDF_BINNED, "rf_mergeBins": aggregate.UDF_MERGE_BINNED,
        "rf_box2D": geometry.UDF_BOX, "st_geomFromWKT": geometry.UDF_FROM_WKT, "st_point": geometry.UDF_POINT, "st_distance": geometry.UDF_DISTANCE,
    }.items():
        u(name, f)
    for name, f in geometry.UDF_PREDICATES.items():
        u(f"st_{name}", f)
    for name, f in geometry.UDF_MEASURES.items():
        u(name, f)
    u("rf_aggStats", _grouped(_agg_stats, scalar.STATS_TYPE))
    u("rf_aggMean", _grouped(_agg_mean, T.DoubleType()))
    u("rf_aggDataCells", _grouped(_sum_of("n"), T.LongType()))
    u("rf_aggNoDataCells", _grouped(_sum_of("missing"), T.LongType()))
    u("rf_aggHistogram", _grouped(_agg_histogram, scalar.HISTOGRAM_TYPE))
    u("rf_localAggStats", _grouped(_local_stats, local_aggregate.LOCAL_STATS_TYPE))
    for name, what in {"Max": "plain_max", "Min": "plain_min", "Mean": "mean", "Count": "data_cells", "DataCells": "data_cells", "NoDataCells": "no_data_cells"}.items():
        u(f"rf_localAgg{name}", _grouped(_local(what), TILE_TYPE))
    u("rf_assembleTile", _assembled())
    tile = "struct<cellType:string,cols:smallint,rows:smallint,data:binary>"
    for name, (args, kind, body) in SQL_BODIES.items():
        spark.sql(f"create or replace temporary function {name}({args.format(t=tile)}) returns {kind} return {body}")
    types = ", ".join(f"'{n}'" for n in celltype.names())
    spark.sql(f"create or replace temporary function rf_cellTypes() returns array<string> return array({types})")
    u("rf_tileCells", F.arrow_udf(_tile_cells, T.ArrayType(_CELLS_TYPE), ArrowUDFType.SCALAR))
    for name in ("rf_explodeTiles", "rf_explodeTiles2", "rf_explodeTiles3"):  # the last two for texts that have them
        spark.udtf.register(name, F.udtf(ExplodeTiles))


_CELLS_TYPE = T.StructType([T.StructField("column_index", T.IntegerType()), T.StructField("row_index", T.IntegerType()), T.StructField("cells", T.ArrayType(T.DoubleType()))])


def _tile_cells(*tiles: pa.Array) -> pa.Array:
    """Cells of each row's tiles as an array of structs: index of column and row, and one double for each tile (NaN: NoData or no tile).

    Rows without any tile give null. Built from whole matrices; ``explode(rf_tileCells(a, b))`` does the rest without Python.
    """
    import numpy as np

    from rasterloom.tile import groups

    n, count = len(tiles[0]), len(tiles)
    cols, rows = np.zeros(n, np.int64), np.zeros(n, np.int64)
    found = [list(groups(t)) for t in tiles]
    for g in (g for own in found for g in own):
        if ((cols[g.at] != 0) & ((cols[g.at] != g.cols) | (rows[g.at] != g.rows))).any():
            raise ValueError("tiles of a row have different sizes")
        cols[g.at], rows[g.at] = g.cols, g.rows
    size = cols * rows
    first = np.concatenate(([0], np.cumsum(size)))
    cells = np.full((first[-1], count), np.nan)
    for k, own in enumerate(found):
        for g in own:
            cells[(first[g.at][:, None] + np.arange(g.cols * g.rows)).ravel(), k] = g.doubles().ravel()
    at = np.arange(first[-1]) - np.repeat(first[:-1], size)
    wide = np.repeat(np.maximum(cols, 1), size)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, first[-1] * count + 1, count), pa.int32()), pa.array(cells.ravel()))
    made = pa.StructArray.from_arrays([pa.array((at % wide).astype(np.int32)), pa.array((at // wide).astype(np.int32)), lists], ["column_index", "row_index", "cells"])
    missing = size == 0
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), made, mask=pa.array(missing) if missing.any() else None)


class ExplodeTiles:
    """A table function over any number of tiles: ``select ... from t, lateral rf_explodeTiles(a, b, c)``; one tile gives ``cell``, more ``cell_0`` and so on."""

    @staticmethod
    def analyze(*tiles: AnalyzeArgument) -> AnalyzeResult:
        names = ["cell"] if len(tiles) == 1 else [f"cell_{k}" for k in range(len(tiles))]
        return AnalyzeResult(T.StructType([T.StructField("column_index", T.IntegerType()), T.StructField("row_index", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in names)]))

    def eval(self, *tiles) -> Iterator[tuple]:
        import numpy as np

        read = [None if t is None else Tile.from_row(t).doubles() for t in tiles]
        some = [t for t in read if t is not None]
        if not some:
            return
        if len({t.shape for t in some}) > 1:
            raise ValueError("tiles of a row have different sizes")
        rows, cols = some[0].shape
        flat = [np.full(rows * cols, np.nan).tolist() if t is None else t.ravel().tolist() for t in read]
        at = np.arange(rows * cols)
        yield from zip((at % cols).tolist(), (at // cols).tolist(), *flat)


#: Aggregates by partial results of each tile: what a call becomes, with ``{0}`` for the tile. Spark's own aggregates stand above them.
COMPOSED = {
    "rf_aggstats": "named_struct('dataCells', coalesce(sum({p}.n), 0L), 'min', min({p}.min), 'max', max({p}.max), 'mean', coalesce(try_divide(sum({p}.sum), sum({p}.n)), double('NaN')),"
    " 'variance', if(sum({p}.n) > 0, greatest(sum({p}.squares) / sum({p}.n) - power(sum({p}.sum) / sum({p}.n), 2), 0.0D), double('NaN')))",
    "rf_aggmean": "try_divide(sum({p}.sum), sum({p}.n))",
    "rf_aggdatacells": "coalesce(sum({p}.n), 0L)",
    "rf_aggnodatacells": "coalesce(sum({p}.cells - {p}.n), 0L)",
    "rf_agghistogram": "rf_mergeBins(collect_list(rf_tileBins({0})))",
}
#: Text that is no code: strings, quoted names, comments; else a name before a parenthesis, or any character.
_TOKEN = re.compile(r"""'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.|"")*"|`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/|[A-Za-z_]\w*(?=\s*\()|\w+|.""", re.S)


def composed(text: str) -> str:
    """SQL text with calls of tile aggregates written out over partial results, so that they shuffle numbers or bins and not tiles.

    Calls that are distinct, filtered or over windows stay what they are.
    """
    tokens = _TOKEN.findall(text)

    def closing(i: int) -> int | None:
        depth = 0
        for k in range(i, len(tokens)):
            depth += (tokens[k] == "(") - (tokens[k] == ")")
            if tokens[k] == ")" and not depth:
                return k
        return None

    def written(start: int, end: int) -> str:
        out, i = [], start
        while i < end:
            name, at = tokens[i].lower(), i + 1
            if name in COMPOSED:
                while tokens[at].isspace():
                    at += 1
                close = closing(at)
                after = [t.lower() for t in tokens[(close or 0) + 1 :] if not t.isspace() and not t.startswith(("--", "/*"))][:1]
                if close is not None and close < end and after not in (["filter"], ["over"]):
                    tile = written(at + 1, close).strip()
                    if not re.match(r"distinct\b", tile, re.I):
                        out.append("(" + COMPOSED[name].format(tile, p=f"rf_tilePartial({tile})") + ")")
                        i = close + 1
                        continue
            out.append(tokens[i])
            i += 1
        return "".join(out)

    return written(0, len(tokens))


def sql(spark: SparkSession, text: str) -> DataFrame:
    """``spark.sql`` with tile aggregates composed of partial results (see :func:`composed`)."""
    return spark.sql(composed(text))


def init(spark: SparkSession, methods: bool = True) -> SparkSession:
    """Register everything; with ``methods``, also ``spark.read.geotiff`` and the like and ``df.asRF``."""
    ship(spark)
    register_functions(spark)
    spark.dataSource.register(GeoTiffSource)
    if methods:
        SparkSession.rasterSql = sql
        SparkSession.withRasters = lambda self: init(self)
        DataFrame.asRF = lambda self, spatial_key=None, metadata=None, temporal_key=None: layer.as_rf(self, spatial_key, metadata, temporal_key)
        DataFrame.tileColumns = layer.tile_columns
        DataFrame.spatialKeyColumn = layer.spatial_key_column
        DataFrame.temporalKeyColumn = layer.temporal_key_column
        DataFrame.tileLayerMetadata = layer.tile_layer_metadata
        DataFrame.spatialJoin = layer.spatial_join
        DataFrameReader.geotiff = lambda self, path: read_geotiff(self._spark, path)
        DataFrameReader.layer = lambda self, path, layer, zoom, **k: read_layer(self._spark, Layer(path, layer, zoom), **k)
        DataFrameReader.layer_catalog = lambda self, path: read_catalog(self._spark, path)
    return spark
