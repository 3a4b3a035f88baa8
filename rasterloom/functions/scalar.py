"""Scalar tile functions: Arrow kernels for what touches cells, plain columns for what does not.

Null tiles give null where the result is a tile, struct, array or text, NaN where it is a double and zero where it is
a count. NoData cells are skipped by statistics and poison the result of cell-wise algebra.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom import celltype
from rasterloom.celltype import CellType, parse
from rasterloom.tile import TILE_TYPE, Group, build, groups, map_tiles, pack, reduce_cells

ColumnOrName = Column | str


def _col(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _alias(name: str, *columns: ColumnOrName) -> str:
    """``fn(a, b)`` from the columns' own names."""
    def of(c: ColumnOrName) -> str:
        return c if isinstance(c, str) else repr(c).removeprefix("Column<'").removesuffix("'>")

    return f"{name}({', '.join(map(of, columns))})"


# -- native -----------------------------------------------------------------------------------------------------------


def tile_dimensions(tile: ColumnOrName) -> Column:
    """struct(cols, rows); no cell leaves the JVM and the payload is pruned from scans."""
    t = _col(tile)
    return F.when(t.isNotNull(), F.struct(t["cols"].alias("cols"), t["rows"].alias("rows"))).alias(_alias("tileDimensions", tile))


def cell_type(tile: ColumnOrName) -> Column:
    return _col(tile)["cellType"].alias(_alias("cellType", tile))


def cell_types() -> Column:
    return F.array(*[F.lit(n) for n in celltype.names()]).alias("cellTypes()")


def make_constant_tile(value: float, cols: int, rows: int, cell_type_name: str) -> Column:
    """A tile whose payload is one cell."""
    ct = parse(cell_type_name)
    n = cols * rows if ct.family == "bool" else 1
    data = pack(ct, np.full((1, n), value).astype(ct.native))[0]
    fields = F.struct(F.lit(ct.name).alias("cellType"), F.lit(cols).cast("short").alias("cols"), F.lit(rows).cast("short").alias("rows"), F.lit(bytearray(data)).alias("data"))
    return fields.alias(f"makeConstantTile({value}, {cols}, {rows}, {cell_type_name})")


def with_no_data(tile: ColumnOrName, value: float) -> Column:
    """The same cells under a type with the user's NoData value: only the name changes, so this stays a struct rewrite."""
    t = _col(tile)
    family = F.regexp_extract(t["cellType"], "^(bool|u?int8|u?int16|int32|float32|float64)", 1)
    text = F.when(family.startswith("float"), F.lit(str(float(value)))).otherwise(F.lit(str(int(value))))
    name = F.when(family == "bool", F.raise_error(F.lit("bool has no NoData value"))).otherwise(F.concat(family, F.lit("ud"), text))
    return F.when(t.isNotNull(), F.struct(name.alias("cellType"), t["cols"].alias("cols"), t["rows"].alias("rows"), t["data"].alias("data"))).alias(_alias("withNoData", tile))


# -- statistics -------------------------------------------------------------------------------------------------------


def _quiet(kernel: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
    def run(x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            return kernel(x)

    return run


def _sum(x: np.ndarray) -> np.ndarray:
    return np.nansum(x, axis=1)


def _count(x: np.ndarray) -> np.ndarray:
    return np.count_nonzero(~np.isnan(x), axis=1)


def _mean(x: np.ndarray) -> np.ndarray:
    return _sum(x) / _count(x)


def _min(x: np.ndarray) -> np.ndarray:
    least = np.fmin.reduce(x, axis=1)
    return least


def _max(x: np.ndarray) -> np.ndarray:
    return np.fmax.reduce(x, axis=1)


def _double_udf(kernel: Callable[[np.ndarray], np.ndarray]):
    @F.arrow_udf(T.DoubleType())
    def run(tiles: pa.Array) -> pa.Array:
        return pa.array(reduce_cells(tiles, np.nan, _quiet(kernel)), from_pandas=False)

    return run


UDF_MEAN, UDF_SUM, UDF_MIN, UDF_MAX = map(_double_udf, (_mean, _sum, _min, _max))


@F.arrow_udf(T.LongType())
def UDF_DATA_CELLS(tiles: pa.Array) -> pa.Array:
    return pa.array(reduce_cells(tiles, 0, _count).astype(np.int64))


@F.arrow_udf(T.LongType())
def UDF_NO_DATA_CELLS(tiles: pa.Array) -> pa.Array:
    return pa.array(reduce_cells(tiles, 0, lambda x: x.shape[1] - _count(x)).astype(np.int64))


def tile_mean(tile: ColumnOrName) -> Column:
    return UDF_MEAN(_col(tile)).alias(_alias("tileMean", tile))


def tile_sum(tile: ColumnOrName) -> Column:
    return UDF_SUM(_col(tile)).alias(_alias("tileSum", tile))


def tile_min(tile: ColumnOrName) -> Column:
    return UDF_MIN(_col(tile)).alias(_alias("tileMin", tile))


def tile_max(tile: ColumnOrName) -> Column:
    return UDF_MAX(_col(tile)).alias(_alias("tileMax", tile))


def data_cells(tile: ColumnOrName) -> Column:
    return UDF_DATA_CELLS(_col(tile)).alias(_alias("dataCells", tile))


def no_data_cells(tile: ColumnOrName) -> Column:
    return UDF_NO_DATA_CELLS(_col(tile)).alias(_alias("noDataCells", tile))


STATS_TYPE = T.StructType(
    [T.StructField("dataCells", T.LongType()), *(T.StructField(n, T.DoubleType()) for n in ("min", "max", "mean", "variance"))]
)


def _stats_struct(size: int, rows: dict[str, np.ndarray], live: np.ndarray) -> pa.StructArray:
    fields = [pa.array(rows["dataCells"].astype(np.int64)), *(pa.array(rows[n], from_pandas=False) for n in ("min", "max", "mean", "variance"))]
    return pa.StructArray.from_arrays(fields, ["dataCells", "min", "max", "mean", "variance"], mask=pa.array(~live))


@F.arrow_udf(STATS_TYPE)
def UDF_STATS(tiles: pa.Array) -> pa.Array:
    size = len(tiles)
    out = {n: np.zeros(size) for n in ("dataCells", "min", "max", "mean", "variance")}
    live = np.zeros(size, bool)
    with np.errstate(all="ignore"):
        for g in groups(tiles):
            x = g.doubles()
            n, s = _count(x), _sum(x)
            mean = s / n
            live[g.at] = n > 0
            for name, v in (("dataCells", n), ("min", _min(x)), ("max", _max(x)), ("mean", mean), ("variance", np.nansum((x - mean[:, None]) ** 2, axis=1) / n)):
                out[name][g.at] = v
    return _stats_struct(size, out, live)


def tile_stats(tile: ColumnOrName) -> Column:
    """Struct of count, least, greatest, mean and population variance; null where there is no data."""
    return UDF_STATS(_col(tile)).alias(_alias("tileStats", tile))


HISTOGRAM_TYPE = T.StructType(
    [
        T.StructField("stats", STATS_TYPE),
        T.StructField("bins", T.ArrayType(T.StructType([T.StructField("value", T.DoubleType()), T.StructField("count", T.LongType())]))),
    ]
)
BINS = 80
_ARROW_BINS = pa.list_(pa.struct([("value", pa.float64()), ("count", pa.int64())]))
_ARROW_STATS = pa.struct([("dataCells", pa.int64()), ("min", pa.float64()), ("max", pa.float64()), ("mean", pa.float64()), ("variance", pa.float64())])


def merge_bins(values: np.ndarray, counts: np.ndarray, limit: int = BINS) -> tuple[np.ndarray, np.ndarray]:
    """At most ``limit`` bins: equal values are one bin, then the closest neighbours are merged to their weighted mean, the fewest cells first among equal gaps."""
    values, inverse = np.unique(np.asarray(values) + 0.0, return_inverse=True)  # no negative zero
    counts = np.bincount(inverse.ravel(), counts, len(values)).astype(np.int64)
    while len(values) > limit:
        # merge as many of the narrowest disjoint gaps as are too many, a round at a time
        gap = np.diff(values)
        chosen = np.zeros(len(values), bool)
        taken = np.zeros(len(values), bool)
        budget = len(values) - limit
        for i in np.lexsort((counts[:-1] + counts[1:], gap))[: 2 * budget].tolist():
            if budget and not taken[i] and not taken[i + 1]:
                chosen[i] = taken[i] = taken[i + 1] = True
                budget -= 1
        group = np.cumsum(~np.concatenate(([False], chosen[:-1]))) - 1
        n = np.bincount(group, counts)
        values, counts = np.bincount(group, values * counts) / n, n.astype(np.int64)
    return values, counts


def histogram_of(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    data = cells[~np.isnan(cells)]
    values, counts = np.unique(data, return_counts=True)
    return merge_bins(values, counts)


@F.arrow_udf(HISTOGRAM_TYPE)
def UDF_HISTOGRAM(tiles: pa.Array) -> pa.Array:
    out: list[dict | None] = [None] * len(tiles)
    with np.errstate(all="ignore"):
        for g in groups(tiles):
            for i, x in zip(g.at.tolist(), g.doubles()):
                v, c = histogram_of(x)
                data = x[~np.isnan(x)]
                stats = {"dataCells": len(data), "min": data.min(), "max": data.max(), "mean": data.mean(), "variance": data.var()} if len(data) else None
                out[i] = {"stats": stats, "bins": [{"value": a, "count": b} for a, b in zip(v.tolist(), c.tolist())]}
    return pa.array(out, pa.struct([("stats", _ARROW_STATS), ("bins", _ARROW_BINS)]))


def tile_histogram(tile: ColumnOrName) -> Column:
    """Exact counts of up to 80 values, else 80 bins; with the tile's statistics."""
    return UDF_HISTOGRAM(_col(tile)).alias(_alias("histogram", tile))


# -- cell-wise algebra ------------------------------------------------------------------------------------------------


def _divide(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.where(b == 0, np.nan, np.trunc(a / np.where(b == 0, 1, b)))


#: Kernels over doubles for integer and for floating cells; NaN is NoData.
OPERATIONS: dict[str, tuple[Callable, Callable]] = {
    "Add": (np.add, np.add),
    "Subtract": (np.subtract, np.subtract),
    "Multiply": (np.multiply, np.multiply),
    "Divide": (_divide, np.divide),
}


def _paired(l: pa.Array, r: pa.Array, kernel: Callable[[Group, Group], tuple[CellType, np.ndarray]]) -> pa.StructArray:
    """Apply a kernel to tiles of both sides; null where either is null, an error where sizes differ."""
    index = np.flatnonzero(pc.and_(l.is_valid(), r.is_valid()).to_numpy(zero_copy_only=False))
    out = []
    for g in groups(l.take(pa.array(index))):
        rows = r.take(pa.array(index[g.at]))
        for h in groups(rows):
            if (h.cols, h.rows) != (g.cols, g.rows):
                raise ValueError(f"tiles have different sizes: {g.cols} x {g.rows} and {h.cols} x {h.rows}")
            own = Group(g.at[h.at], g.cell_type, g.cols, g.rows, g.cells[h.at])
            ct, cells = kernel(own, h)
            out.append((index[own.at], ct, g.cols, g.rows, cells))
    return build(len(l), out)


def _algebra(op: Callable[[np.ndarray, np.ndarray], np.ndarray] | tuple[Callable, Callable]):
    whole, floating = op if isinstance(op, tuple) else (op, op)

    @F.arrow_udf(TILE_TYPE)
    def run(l: pa.Array, r: pa.Array) -> pa.Array:
        def kernel(a: Group, b: Group) -> tuple[CellType, np.ndarray]:
            ct = celltype.union(a.cell_type, b.cell_type)
            with np.errstate(all="ignore"):
                return ct, ct.from_doubles((floating if ct.floating else whole)(a.doubles(), b.doubles()))

        return _paired(l, r, kernel)

    return run


UDF_ALGEBRA = {name: _algebra(op) for name, op in OPERATIONS.items()}


def local_algebra(op: str | Callable[[np.ndarray, np.ndarray], np.ndarray], left: ColumnOrName, right: ColumnOrName) -> Column:
    """Any cell-wise operation of two tiles: a name of ``OPERATIONS``, or a vectorised function of two float64 arrays."""
    udf = UDF_ALGEBRA[op] if isinstance(op, str) else _algebra(op)
    name = op if isinstance(op, str) else getattr(op, "__name__", "op")
    return udf(_col(left), _col(right)).alias(_alias(name.lower(), left, right))


def local_add(l: ColumnOrName, r: ColumnOrName) -> Column:
    return local_algebra("Add", l, r)


def local_subtract(l: ColumnOrName, r: ColumnOrName) -> Column:
    return local_algebra("Subtract", l, r)


def local_multiply(l: ColumnOrName, r: ColumnOrName) -> Column:
    return local_algebra("Multiply", l, r)


def local_divide(l: ColumnOrName, r: ColumnOrName) -> Column:
    return local_algebra("Divide", l, r)


@F.arrow_udf(TILE_TYPE)
def UDF_NORMALIZED(l: pa.Array, r: pa.Array) -> pa.Array:
    def kernel(a: Group, b: Group) -> tuple[CellType, np.ndarray]:
        ct = celltype.union(a.cell_type, b.cell_type)
        with np.errstate(all="ignore"):
            x, y = a.doubles(), b.doubles()
            # each step has the tiles' type, as if the operations were composed
            top, bottom = (ct.doubles(ct.from_doubles(v)) for v in (x - y, x + y))
            return ct, ct.from_doubles((np.divide if ct.floating else _divide)(top, bottom))

    return _paired(l, r, kernel)


def normalized_difference(l: ColumnOrName, r: ColumnOrName) -> Column:
    """(l - r) / (l + r) in the tiles' own type, in one crossing to Python."""
    return UDF_NORMALIZED(_col(l), _col(r)).alias(_alias("normalizedDifference", l, r))


# -- conversions ------------------------------------------------------------------------------------------------------


def convert_cell_type(tile: ColumnOrName, name: str) -> Column:
    """The same values in another type; NoData becomes that type's NoData."""
    ct = parse(name)

    @F.arrow_udf(TILE_TYPE)
    def run(tiles: pa.Array) -> pa.Array:
        return map_tiles(tiles, lambda g: (ct, g.cols, g.rows, ct.from_doubles(g.doubles())))

    return run(_col(tile)).alias(_alias("convertCellType", tile))


_ARRAY_TYPES = {
    "int": (T.IntegerType(), pa.int32(), "int32"),
    "double": (T.DoubleType(), pa.float64(), "float64"),
    "float": (T.FloatType(), pa.float32(), "float32"),
    "short": (T.ShortType(), pa.int16(), "int16"),
    "byte": (T.ByteType(), pa.int8(), "int8"),
}


def _lists(size: int, parts: list[tuple[np.ndarray, np.ndarray]], kind: pa.DataType) -> pa.ListArray:
    """A list array from matrices with a row for each index; null elsewhere."""
    if len(parts) == 1 and len(parts[0][0]) == size and (np.diff(parts[0][0]) == 1).all():
        cells = parts[0][1]
        offsets = np.arange(size + 1, dtype=np.int32) * cells.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel(), kind, from_pandas=False))
    rows: list[np.ndarray | None] = [None] * size
    for at, cells in parts:
        for i, x in zip(at.tolist(), cells):
            rows[i] = x
    lengths = np.array([0 if x is None else len(x) for x in rows])
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    values = np.concatenate([x for x in rows if x is not None]) if any(x is not None for x in rows) else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind, from_pandas=False), mask=pa.array([x is None for x in rows]))


def _to_array(kind: str):
    spark_type, arrow_type, family = _ARRAY_TYPES[kind]
    target = parse(family)

    @F.arrow_udf(T.ArrayType(spark_type))
    def run(tiles: pa.Array) -> pa.Array:
        return _lists(len(tiles), [(g.at, g.doubles() if kind == "double" else target.from_doubles(g.doubles())) for g in groups(tiles)], arrow_type)

    return run


UDF_TO_ARRAY = {k: _to_array(k) for k in _ARRAY_TYPES}


def tile_to_array(tile: ColumnOrName, kind: str = "double") -> Column:
    """Cells in row-major order as an array of int, double, float, short or byte; NoData becomes that type's NoData."""
    return UDF_TO_ARRAY[kind](_col(tile)).alias(_alias("tileToArray", tile))


def tile_to_int_array(tile: ColumnOrName) -> Column:
    return tile_to_array(tile, "int")


def tile_to_double_array(tile: ColumnOrName) -> Column:
    return tile_to_array(tile, "double")


def array_to_tile(array: ColumnOrName, cols: int, rows: int) -> Column:
    """A raw tile of the array's element type; null for null and empty arrays."""

    @F.arrow_udf(TILE_TYPE)
    def run(arrays: pa.Array) -> pa.Array:
        kind = {pa.int8(): "int8", pa.int16(): "int16", pa.int32(): "int32", pa.int64(): "int32", pa.float32(): "float32", pa.float64(): "float64", pa.bool_(): "bool"}[arrays.type.value_type]
        ct = parse(kind if kind == "bool" else kind + "raw")
        sizes = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        live = np.flatnonzero(sizes > 0)
        if (sizes[live] != cols * rows).any():
            raise ValueError(f"arrays for tiles of {cols} x {rows} cells need {cols * rows} elements")
        flat = arrays.take(pa.array(live)).flatten().to_numpy(zero_copy_only=False)
        return build(len(arrays), [(live, ct, cols, rows, flat.astype(ct.native).reshape(len(live), cols * rows))] if len(live) else [])

    return run(_col(array)).alias(_alias("arrayToTile", array))


#: From nothing to full.
ASCII_RAMP = " .:-=+*#%@"


@F.arrow_udf(T.StringType())
def UDF_ASCII(tiles: pa.Array) -> pa.Array:
    out: list[str | None] = [None] * len(tiles)
    for g in groups(tiles):
        for i, x in zip(g.at.tolist(), g.doubles()):
            data = x[~np.isnan(x)]
            low, high = (data.min(), data.max()) if len(data) else (0.0, 1.0)
            level = np.nan_to_num((x - low) / (high - low) if high > low else np.zeros_like(x))
            pick = np.minimum((level * len(ASCII_RAMP)).astype(int), len(ASCII_RAMP) - 1)
            chars = np.where(np.isnan(x), "?", np.array(list(ASCII_RAMP))[pick])
            out[i] = "\n".join("".join(r) for r in chars.reshape(g.rows, g.cols)) + "\n"
    return pa.array(out, pa.string())


def render_ascii(tile: ColumnOrName) -> Column:
    """The tile as lines of characters, darker for greater values; ``?`` is NoData."""
    return UDF_ASCII(_col(tile)).alias(_alias("renderAscii", tile))
