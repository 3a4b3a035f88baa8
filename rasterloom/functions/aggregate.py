"""Aggregates over tile columns.

Statistics are composed: one Arrow kernel reduces each tile to five numbers, and Spark's own partial and final aggregates sum those
up, so no tile is shuffled. Histograms and assembled tiles gather bins or cells of a group, not tiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.celltype import parse
from rasterloom.functions.scalar import _ARROW_BINS, _ARROW_STATS, HISTOGRAM_TYPE, ColumnOrName, _alias, _col, _count, _max, _min, _sum, merge_bins
from rasterloom.tile import TILE_TYPE, build, groups

PARTIAL_TYPE = T.StructType(
    [T.StructField("cells", T.LongType()), T.StructField("n", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("min", "max", "sum", "squares"))]
)


@F.arrow_udf(PARTIAL_TYPE)
def UDF_PARTIAL(tiles: pa.Array) -> pa.Array:
    """Numbers of each tile; null for null tiles, null extremes where there is no data (NaN would win every maximum)."""
    size = len(tiles)
    cells, n = np.zeros(size, np.int64), np.zeros(size, np.int64)
    low, high, total, squares = (np.zeros(size) for _ in range(4))
    live = np.zeros(size, bool)
    with np.errstate(all="ignore"):
        for g in groups(tiles):
            x = g.doubles()
            live[g.at], cells[g.at], n[g.at] = True, x.shape[1], _count(x)
            low[g.at], high[g.at], total[g.at] = _min(x), _max(x), _sum(x)
            np.multiply(x, x, out=x)
            squares[g.at] = np.nansum(x, axis=1)
    empty = n == 0
    fields = [pa.array(cells), pa.array(n), pa.array(low, mask=empty), pa.array(high, mask=empty), pa.array(total), pa.array(squares)]
    return pa.StructArray.from_arrays(fields, ["cells", "n", "min", "max", "sum", "squares"], mask=pa.array(~live))


def stats_of_partials(p: Column) -> Column:
    """Statistics of a column of partial structs. Without data: count 0, null extremes, NaN mean and variance."""
    n, total = F.coalesce(F.sum(p["n"]), F.lit(0)), F.sum(p["sum"])
    mean = F.when(n > 0, total / n).otherwise(F.lit(float("nan")))
    variance = F.when(n > 0, F.greatest(F.sum(p["squares"]) / n - mean * mean, F.lit(0.0))).otherwise(F.lit(float("nan")))
    return F.struct(n.alias("dataCells"), F.min(p["min"]).alias("min"), F.max(p["max"]).alias("max"), mean.alias("mean"), variance.alias("variance"))


def agg_stats(tile: ColumnOrName) -> Column:
    return stats_of_partials(UDF_PARTIAL(_col(tile))).alias(_alias("aggStats", tile))


def agg_mean(tile: ColumnOrName) -> Column:
    """Mean over all data cells; null without any."""
    p = UDF_PARTIAL(_col(tile))
    return F.try_divide(F.sum(p["sum"]), F.sum(p["n"])).alias(_alias("agg_mean", tile))


def agg_data_cells(tile: ColumnOrName) -> Column:
    return F.coalesce(F.sum(UDF_PARTIAL(_col(tile))["n"]), F.lit(0)).alias(_alias("agg_data_cells", tile))


def agg_no_data_cells(tile: ColumnOrName) -> Column:
    p = UDF_PARTIAL(_col(tile))
    return F.coalesce(F.sum(p["cells"] - p["n"]), F.lit(0)).alias(_alias("agg_no_data_cells", tile))


# -- histograms -------------------------------------------------------------------------------------------------------


def _histogram(values: np.ndarray, counts: np.ndarray, partials: list[dict]) -> dict:
    n, total, squares = (sum(p[k] for p in partials) for k in ("n", "sum", "squares"))
    v, c = merge_bins(values, counts)
    mean = total / n if n else float("nan")
    stats = {"dataCells": n, "min": min(p["min"] for p in partials), "max": max(p["max"] for p in partials), "mean": mean, "variance": max(squares / n - mean * mean, 0.0)} if n else None
    return {"stats": stats, "bins": [{"value": a, "count": int(b)} for a, b in zip(v.tolist(), c.tolist())]}


_BINNED = T.StructType([*PARTIAL_TYPE.fields[1:], T.StructField("values", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
_ARROW_BINNED = pa.struct([("n", pa.int64()), *((x, pa.float64()) for x in ("min", "max", "sum", "squares")), ("values", pa.list_(pa.float64())), ("counts", pa.list_(pa.int64()))])


def _binned(tiles: pa.Array) -> list[dict | None]:
    out: list[dict | None] = [None] * len(tiles)
    for g in groups(tiles):
        for i, x in zip(g.at.tolist(), g.doubles()):
            data = x[~np.isnan(x)]
            if len(data):
                v, c = merge_bins(*np.unique(data, return_counts=True))
                out[i] = {"n": len(data), "min": data.min(), "max": data.max(), "sum": data.sum(), "squares": float(data @ data), "values": v, "counts": c}
    return out


@F.arrow_udf(_BINNED)
def UDF_BINNED(tiles: pa.Array) -> pa.Array:
    return pa.array(_binned(tiles), _ARROW_BINNED)


#: Parts in which the partial histograms of a group meet first.
FAN = 64


@F.arrow_udf(_BINNED)
def UDF_JOIN_BINNED(lists: pa.Array) -> pa.Array:
    """One partial histogram of several."""
    out = []
    for parts in lists.to_pylist():
        v, c = merge_bins(np.concatenate([np.asarray(p["values"], float) for p in parts]), np.concatenate([np.asarray(p["counts"], np.int64) for p in parts]))
        sums = {k: sum(p[k] for p in parts) for k in ("n", "sum", "squares")}
        out.append({**sums, "min": min(p["min"] for p in parts), "max": max(p["max"] for p in parts), "values": v, "counts": c})
    return pa.array(out, _ARROW_BINNED)


@F.arrow_udf(HISTOGRAM_TYPE)
def UDF_MERGE_BINNED(lists: pa.Array) -> pa.Array:
    out = []
    for parts in lists.to_pylist():
        parts = parts or []
        values = np.concatenate([p["values"] for p in parts]) if parts else np.empty(0)
        counts = np.concatenate([p["counts"] for p in parts]) if parts else np.empty(0, np.int64)
        out.append(_histogram(values, counts, parts))
    return pa.array(out, pa.struct([("stats", _ARROW_STATS), ("bins", _ARROW_BINS)]))


def agg_histogram(tile: ColumnOrName) -> Column:
    """Histogram of a group from at most 80 bins of each tile; null tiles are skipped.

    The bins of all tiles of a group meet in one task; :func:`histogram_by` first merges them in each task.
    """
    return UDF_MERGE_BINNED(F.collect_list(UDF_BINNED(_col(tile)))).alias(_alias("aggHistogram", tile))


def histogram_by(df: DataFrame, keys: list[str], tile: str, result: str = "histogram") -> DataFrame:
    """``keys, result``: the same histogram with a partial histogram for each task and group, so that only those are shuffled."""
    key_fields = [df.schema[k] for k in keys]
    partial = T.StructType([*key_fields, *_BINNED.fields])
    arrow_keys = len(keys)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, dict] = {}
        schema = None
        for b in batches:
            schema = schema or b.schema
            for key, one in zip(zip(*(b.column(k).to_pylist() for k in range(arrow_keys))) if arrow_keys else [()] * b.num_rows, _binned(b.column(arrow_keys))):
                if one is None:
                    held.setdefault(key, {"n": 0, "min": np.inf, "max": -np.inf, "sum": 0.0, "squares": 0.0, "values": np.empty(0), "counts": np.empty(0, np.int64)})
                    continue
                old = held.get(key)
                if old is None:
                    held[key] = one
                else:
                    v, c = merge_bins(np.concatenate([old["values"], one["values"]]), np.concatenate([old["counts"], one["counts"]]))
                    held[key] = {"n": old["n"] + one["n"], "min": min(old["min"], one["min"]), "max": max(old["max"], one["max"]), "sum": old["sum"] + one["sum"], "squares": old["squares"] + one["squares"], "values": v, "counts": c}
        if schema is not None:
            columns = [pa.array([k[i] for k in held], schema.field(i).type) for i in range(arrow_keys)]
            rest = pa.array(list(held.values()), _ARROW_BINNED)
            yield pa.RecordBatch.from_arrays([*columns, *rest.flatten()], [*keys, *(f.name for f in _BINNED.fields)])

    # partial histograms of a group meet in FAN parts first, so that no row gathers one for each task
    folded = df.select(*keys, tile).mapInArrow(fold, partial).withColumn("_part", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    one = F.struct(*(f.name for f in _BINNED.fields))
    parts = folded.groupBy(*keys, "_part").agg(UDF_JOIN_BINNED(F.collect_list(one)).alias("_one"))
    return parts.groupBy(*keys).agg(UDF_MERGE_BINNED(F.collect_list("_one")).alias(result))


# -- tiles from cells -------------------------------------------------------------------------------------------------


def assemble_tile(column_index: ColumnOrName, row_index: ColumnOrName, cell: ColumnOrName, cols: int, rows: int, cell_type: str) -> Column:
    """One tile of each group from its cells; cells that no row names are NoData, an index outside is an error.

    Of rows for the same cell the one with the greatest value stays (NaN counts as NoData).
    """
    ct = parse(cell_type)
    struct = pa.struct([("at", pa.int64()), ("cell", pa.float64())])

    @F.arrow_udf(TILE_TYPE)
    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        flat = lists.flatten()
        at, value = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        value = value.astype(np.float64)
        owner = np.repeat(np.arange(len(lists)), sizes)
        out = np.full((len(lists), cols * rows), np.nan)
        order = np.argsort(value, kind="stable")  # NaN last, so data is written after it
        order = np.concatenate([order[np.isnan(value[order])], order[~np.isnan(value[order])]])
        out[owner[order], at[order]] = value[order]
        return build(len(lists), [(np.arange(len(lists)), ct, cols, rows, ct.from_doubles(out))])

    c, r = _col(column_index), _col(row_index)
    inside = (c >= 0) & (c < cols) & (r >= 0) & (r < rows)
    place = F.when(inside, r.cast("long") * cols + c).otherwise(F.raise_error(F.lit(f"cell index outside of {cols} x {rows}")).cast("long"))
    return run(F.collect_list(F.struct(place.alias("at"), F.coalesce(_col(cell).cast("double"), F.lit(float("nan"))).alias("cell")))).alias(_alias("assembleTile", column_index, row_index, cell))
