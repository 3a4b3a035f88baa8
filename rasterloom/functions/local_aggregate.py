"""Cell-wise aggregates: tiles of a group are combined cell by cell.

The operators here reduce in a tree. Each task folds its tiles into running sums for each cell, a few matrices for each group, and
hands them on in blocks of ``BLOCK`` cells, when they exceed ``HELD`` bytes or at its end. States of one block of a group meet in
``FAN`` parts, dealt by the task that they come from, and each part is summed as it streams in; then the parts of all
blocks of a group meet, at most ``FAN`` for each cell, and become its tiles. So no task reads more than the states of a block from
one in ``FAN`` tasks, or ``FAN`` times a tile's state, whatever the number of tiles in a group.
Tiles of a group must have the same size. Null tiles are skipped; a group of null tiles only gives null.

``count`` counts data cells, ``min``, ``max``, ``mean`` and ``variance`` ignore NoData; where a cell has none at all, count is zero
and the others are NoData. ``plain_min`` and ``plain_max`` are NoData where any tile is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rasterloom.celltype import CellType, parse, union
from rasterloom.functions.scalar import ColumnOrName, _alias, _col
from rasterloom.tile import ARROW_TILE, TILE_TYPE, build, groups

HELD = 256 << 20

#: Cells of a block of states, and parts in which the states of a block meet first.
BLOCK, FAN = 4096, 32

#: Tiles of a list that are matrices of doubles at once.
TILES = 4096

STATS = ("count", "min", "max", "mean", "variance")
LOCAL_STATS_TYPE = T.StructType([T.StructField(n, TILE_TYPE) for n in STATS])


class Running:
    """Sums of a group's tiles: data and NoData counts, extremes, sum, sum of squares, for each cell."""

    FIELDS = ("n", "missing", "min", "max", "sum", "squares")

    def __init__(self, cols: int, rows: int, cell_type: CellType, values: np.ndarray | None = None) -> None:
        self.cols, self.rows, self.cell_type = cols, rows, cell_type
        self.values = np.zeros((6, cols * rows)) if values is None else values
        if values is None:
            self.values[2], self.values[3] = np.inf, -np.inf

    def check(self, cols: int, rows: int) -> None:
        if (cols, rows) != (self.cols, self.rows):
            raise ValueError(f"tiles of one group have different sizes: {self.cols} x {self.rows} and {cols} x {rows}")

    def add(self, x: np.ndarray, cell_type: CellType) -> None:
        """Fold a matrix of doubles, one tile a row."""
        self.cell_type = union(self.cell_type, cell_type)
        data = ~np.isnan(x)
        n = data.sum(axis=0)
        v = self.values
        v[0] += n
        v[1] += len(x) - n
        v[2] = np.fmin(v[2], np.fmin.reduce(x, axis=0))
        v[3] = np.fmax(v[3], np.fmax.reduce(x, axis=0))
        filled = np.where(data, x, 0.0)
        v[4] += filled.sum(axis=0)
        v[5] += np.einsum("ij,ij->j", filled, filled)

    def merge(self, other: Running) -> None:
        self.check(other.cols, other.rows)
        self.cell_type = union(self.cell_type, other.cell_type)
        a, b = self.values, other.values
        for k in (0, 1, 4, 5):
            a[k] += b[k]
        a[2], a[3] = np.fmin(a[2], b[2]), np.fmax(a[3], b[3])

    def result(self, name: str) -> tuple[CellType, np.ndarray]:
        n, missing, low, high, total, squares = self.values
        some = n > 0
        with np.errstate(all="ignore"):
            if name in ("count", "data_cells"):
                return parse("int32"), n.astype(np.int32)
            if name == "no_data_cells":
                return parse("int32"), missing.astype(np.int32)
            mean = np.where(some, total / n, np.nan)
            if name == "mean":
                return parse("float64"), mean
            if name == "variance":
                return parse("float64"), np.where(some, np.maximum(squares / n - mean * mean, 0), np.nan)
            extreme = low if name.endswith("min") else high
            whole = some & (missing == 0) if name.startswith("plain") else some
            ct = self.cell_type if name.startswith("plain") else parse("float64")
            return ct, ct.from_doubles(np.where(whole, extreme, np.nan))


def _fold(tiles: pa.Array, code: np.ndarray, held: dict[int, Running]) -> None:
    """Fold tiles into the running values of their groups' codes."""
    for g in groups(tiles):
        own = code[g.at]
        order = np.argsort(own, kind="stable")
        cut = np.flatnonzero(np.concatenate(([True], np.diff(own[order]) != 0)))
        x = g.doubles()
        for part in np.split(order, cut[1:]):
            k = int(own[part[0]])
            if k not in held:
                held[k] = Running(g.cols, g.rows, g.cell_type)
            held[k].check(g.cols, g.rows)
            # some rows at a time, so that temporaries stay small
            step = max(1, (4 << 20) // x.shape[1])
            for a in range(0, len(part), step):
                held[k].add(x[part[a : a + step]], g.cell_type)


class Blocks:
    """Sums of blocks of one group as they stream in: the state of a whole tile, or of one of its blocks."""

    def __init__(self) -> None:
        self.whole: Running | None = None
        self.key: list[pa.Array] = []

    def take(self, b: pa.RecordBatch, nk: int, one_block: bool) -> None:
        """Fold a batch of states: keys, then ``STATE``."""
        if not self.key and b.num_rows:
            self.key = [b.column(i).slice(0, 1) for i in range(nk)]
        cols, rows, kinds, at, values = (b.column(b.schema.get_field_index(n)) for n in ("_cols", "_rows", "_type", "_block", "_values"))
        for w, h, kind, k, own in zip(cols.to_pylist(), rows.to_pylist(), kinds.to_pylist(), at.to_pylist(), values):
            if w is None:
                continue
            state = np.frombuffer(own.as_buffer(), np.float64).reshape(6, -1)
            if self.whole is None:
                self.whole = Running(w, h, parse(kind), np.zeros((6, state.shape[1] if one_block else w * h)))
                self.whole.values[2], self.whole.values[3] = np.inf, -np.inf
            self.whole.check(w, h)
            first = 0 if one_block else k
            part = Running(w, h, self.whole.cell_type, self.whole.values[:, first : first + state.shape[1]])  # a view
            part.merge(Running(w, h, parse(kind), state))
            self.whole.cell_type = part.cell_type


def _state_type(df: DataFrame, keys: list[str]) -> T.StructType:
    """Keys, then a block of a group's state: the tile's size and type, the block's first cell, the part it is summed in, the sums."""
    own = (("_cols", T.ShortType()), ("_rows", T.ShortType()), ("_type", T.StringType()), ("_block", T.IntegerType()), ("_part", T.IntegerType()), ("_values", T.BinaryType()))
    return T.StructType([*(df.schema[k] for k in keys), *(T.StructField(x, k) for x, k in own)])


def _state_rows(key: list[pa.Array], r: Running | None, first: int, part: int, names: list[str]) -> pa.RecordBatch:
    """Blocks of one group's state, named by their first cells, from ``first`` on; one row without a state if there is none."""
    cuts = range(0, r.values.shape[1], BLOCK) if r else [0]
    n = len(cuts)
    columns = [pa.concat_arrays([k] * n) for k in key]
    columns += [pa.array([x] * n, kind) for x, kind in ((r and r.cols, pa.int16()), (r and r.rows, pa.int16()), (r and r.cell_type.name, pa.string()))]
    columns += [pa.array([first + a for a in cuts], pa.int32()), pa.array([part] * n, pa.int32()), pa.array([r and np.ascontiguousarray(r.values[:, a : a + BLOCK]).tobytes() for a in cuts], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names)


def partial_states(df: DataFrame, keys: list[str], tile: str) -> DataFrame:
    """States of the groups that each task has, in blocks; also of streams, for each of their batches."""
    nk, state = len(keys), _state_type(df, keys)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple, int] = {}
        held: dict[int, Running] = {}
        schema, part = None, TaskContext.get().partitionId() % FAN

        def out() -> Iterator[pa.RecordBatch]:
            for key, k in codes.items():
                yield _state_rows([pa.array([x], schema.field(i).type) for i, x in enumerate(key)], held.get(k), 0, part, state.names)

        for b in batches:
            schema = schema or b.schema
            code = np.fromiter((codes.setdefault(k, len(codes)) for k in zip(*(b.column(i).to_pylist() for i in range(nk)))), np.int64, b.num_rows)
            _fold(b.column(nk), code, held)
            if sum(r.values.nbytes for r in held.values()) > HELD:
                yield from out()
                codes, held = {}, {}
        yield from out()

    return df.select(*keys, tile).mapInArrow(partial, state)


def tiles_of_states(states: DataFrame, keys: list[str], results: dict[str, str]) -> DataFrame:
    """``keys`` and the tiles of ``results`` from blocks of states."""
    nk, names = len(keys), list(results)
    out_type = T.StructType([*(states.schema[k] for k in keys), *(T.StructField(n, TILE_TYPE) for n in names)])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Blocks()
        for b in batches:
            sums.take(b, nk, False)
        columns = list(sums.key)
        for n in names:
            if sums.whole is None:
                columns.append(pa.array([None], ARROW_TILE))
            else:
                ct, cells = sums.whole.result(results[n])
                columns.append(build(1, [(np.array([0]), ct, sums.whole.cols, sums.whole.rows, cells.reshape(1, -1))]))
        if sums.key:
            yield pa.RecordBatch.from_arrays(columns, [*keys, *names])

    total.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    return states.groupBy(*keys).applyInArrow(total, out_type)


def local_agg_by(df: DataFrame, keys: list[str], tile: str, results: dict[str, str]) -> DataFrame:
    """``keys`` and a tile column for each entry of ``results`` (name to one of count, min, max, mean, variance, plain_min, plain_max, data_cells, no_data_cells)."""
    if not keys:
        whole = _unused("_all", df)
        return local_agg_by(df.select(F.lit(1).alias(whole), tile), [whole], tile, results).drop(whole)
    nk, state = len(keys), _state_type(df, keys)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, first, part = Blocks(), 0, 0
        for b in batches:
            if b.num_rows:
                first, part = (b.column(b.schema.get_field_index(n))[0].as_py() for n in ("_block", "_part"))
            sums.take(b, nk, True)
        if sums.key:
            yield _state_rows(sums.key, sums.whole, first, part, state.names)

    merged.__annotations__ = {"batches": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    states = partial_states(df, keys, tile).groupBy(*keys, "_block", "_part").applyInArrow(merged, state)
    return tiles_of_states(states, keys, results)


def _unused(name: str, df: DataFrame) -> str:
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name += "_"
    return name


def local_agg_stats_by(df: DataFrame, keys: list[str], tile: str, result: str = "localAggStats") -> DataFrame:
    """``keys`` and a struct of the five tiles count, min, max, mean, variance; null without a tile."""
    made = local_agg_by(df, keys, tile, {f"_{n}": n for n in STATS})
    return made.select(*keys, F.when(F.col("_count").isNotNull(), F.struct(*[F.col(f"_{n}").alias(n) for n in STATS])).alias(result))


# -- as columns -------------------------------------------------------------------------------------------------------


def _merged_udf(name: str):
    @F.arrow_udf(TILE_TYPE)
    def run(lists: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        held: dict[int, Running] = {}
        tiles, owner = lists.flatten(), np.repeat(np.arange(len(lists)), sizes)
        for a in range(0, len(tiles), TILES):
            _fold(tiles.slice(a, TILES), owner[a : a + TILES], held)
        return build(len(lists), [(np.array([k]), ct, r.cols, r.rows, cells.reshape(1, -1)) for k, r in sorted(held.items()) for ct, cells in [r.result(name)]])

    return run


UDF_MERGED = {n: _merged_udf(n) for n in (*STATS, "plain_min", "plain_max", "data_cells", "no_data_cells")}


def _local(name: str, label: str, tile: ColumnOrName) -> Column:
    return UDF_MERGED[name](F.collect_list(_col(tile))).alias(_alias(label, tile))


def local_agg_stats(tile: ColumnOrName) -> Column:
    """As a column, for groups of moderate size: the tiles of a group meet in one task. See :func:`local_agg_stats_by`."""
    tiles = F.collect_list(_col(tile))
    return F.when(F.size(tiles) > 0, F.struct(*[UDF_MERGED[n](tiles).alias(n) for n in STATS])).alias(_alias("localAggStats", tile))


def local_agg_max(tile: ColumnOrName) -> Column:
    return _local("plain_max", "localAggMax", tile)


def local_agg_min(tile: ColumnOrName) -> Column:
    return _local("plain_min", "localAggMin", tile)


def local_agg_mean(tile: ColumnOrName) -> Column:
    return _local("mean", "localAggMean", tile)


def local_agg_data_cells(tile: ColumnOrName) -> Column:
    return _local("data_cells", "localCount", tile)


local_agg_count = local_agg_data_cells


def local_agg_no_data_cells(tile: ColumnOrName) -> Column:
    return _local("no_data_cells", "localNoDataCells", tile)


def biased_add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cell-wise sum of doubles where NoData and a value give the value."""
    return np.where(np.isnan(a), b, np.where(np.isnan(b), a, a + b))


def biased_min(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fmin(a, b)


def biased_max(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.fmax(a, b)
