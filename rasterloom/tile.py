"""The tile: a struct column of cell type, columns, rows and packed cells, and its vectorised codec.

Cells are row-major and big-endian; ``bool`` packs eight cells to a byte, lowest bit first; a constant tile may have the bytes
of a single cell. Kernels work on matrices: all tiles of an Arrow batch with the same type and size are one matrix with a row
for each tile, taken from the batch's buffer without a loop where the tiles lie there one after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T

from rasterloom.celltype import CellType, parse

TILE_TYPE = T.StructType(
    [
        T.StructField("cellType", T.StringType()),
        T.StructField("cols", T.ShortType()),
        T.StructField("rows", T.ShortType()),
        T.StructField("data", T.BinaryType()),
    ]
)
TILE_DDL = "struct<cellType:string,cols:smallint,rows:smallint,data:binary>"
ARROW_TILE = pa.struct([("cellType", pa.string()), ("cols", pa.int16()), ("rows", pa.int16()), ("data", pa.binary())])


def is_tile(kind: T.DataType) -> bool:
    """Whether a column's type is a tile's, whatever may be null."""
    return isinstance(kind, T.StructType) and [(f.name, f.dataType) for f in kind] == [(f.name, f.dataType) for f in TILE_TYPE]


@dataclass(frozen=True)
class Tile:
    """One tile on the driver: its type and its cells as a two-dimensional array."""

    cell_type: CellType
    cells: np.ndarray

    @property
    def cols(self) -> int:
        return self.cells.shape[1]

    @property
    def rows(self) -> int:
        return self.cells.shape[0]

    def doubles(self) -> np.ndarray:
        return self.cell_type.doubles(self.cells)

    @staticmethod
    def of(cells, cell_type: str | CellType | None = None) -> Tile:
        from rasterloom.celltype import of_dtype

        cells = np.asarray(cells)
        ct = of_dtype(cells.dtype) if cell_type is None else parse(cell_type) if isinstance(cell_type, str) else cell_type
        return Tile(ct, cells.astype(ct.native))

    def row(self) -> tuple[str, int, int, bytes]:
        """As a value of the struct column."""
        return self.cell_type.name, self.cols, self.rows, pack(self.cell_type, self.cells.reshape(1, -1))[0]

    @staticmethod
    def from_row(row) -> Tile | None:
        if row is None:
            return None
        ct = parse(row["cellType"])
        return Tile(ct, unpack(ct, row["cols"] * row["rows"], bytes(row["data"])).reshape(row["rows"], row["cols"]))


def unpack(ct: CellType, n: int, data: bytes) -> np.ndarray:
    """Cells of one payload."""
    if ct.family == "bool":
        return np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[:n]
    cells = np.frombuffer(data, ct.stored).astype(ct.native)
    return np.full(n, cells[0]) if len(cells) < n else cells


def pack(ct: CellType, cells: np.ndarray) -> list[bytes]:
    """Payload of each row of a matrix."""
    if ct.family == "bool":
        packed = np.packbits(cells != 0, axis=1, bitorder="little")
    else:
        packed = np.ascontiguousarray(cells.astype(ct.stored)).view(np.uint8).reshape(len(cells), -1)
    return [r.tobytes() for r in packed]


@dataclass(frozen=True)
class Group:
    """Tiles of a batch with one type and size: their indexes and a matrix of their cells."""

    at: np.ndarray
    cell_type: CellType
    cols: int
    rows: int
    cells: np.ndarray

    def doubles(self) -> np.ndarray:
        return self.cell_type.doubles(self.cells)


def groups(tiles: pa.StructArray) -> Iterator[Group]:
    """The non-null tiles of an array, by type and size."""
    if isinstance(tiles, pa.ChunkedArray):
        tiles = tiles.combine_chunks()
    live = np.flatnonzero(tiles.is_valid().to_numpy(zero_copy_only=False))
    if not len(live):
        return
    fields = [tiles.field(k) for k in range(4)]
    kinds = fields[0].dictionary_encode()
    code = kinds.indices.to_numpy(zero_copy_only=False)[live]
    cols, rows = (f.to_numpy(zero_copy_only=False)[live].astype(np.int64) for f in fields[1:3])
    data = fields[3]
    wide = pa.types.is_large_binary(data.type)
    offsets = np.frombuffer(data.buffers()[1], np.int64 if wide else np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    body = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.empty(0, np.uint8)
    start, size = offsets[live], offsets[live + 1] - offsets[live]
    key = np.column_stack([code.astype(np.int64), cols, rows, size])
    same = (key == key[0]).all()
    parts = [np.arange(len(live))] if same else [np.flatnonzero(inverse == k) for inverse in (np.unique(key, axis=0, return_inverse=True)[1].ravel(),) for k in range(inverse.max() + 1)]
    for part in parts:
        c, w, h, b = key[part[0]].tolist()
        ct, n = parse(kinds.dictionary[int(c)].as_py()), w * h
        first = start[part]
        if len(part) == 1 or (np.diff(first) == b).all():
            raw = body[first[0] : first[0] + b * len(part)].reshape(len(part), b)
        else:
            raw = body[(first[:, None] + np.arange(b)[None, :])] if b < 4096 else np.stack([body[a : a + b] for a in first.tolist()])
        if ct.family == "bool":
            cells = np.unpackbits(raw, axis=1, bitorder="little")[:, :n]
        else:
            cells = np.ascontiguousarray(raw).view(ct.stored).astype(ct.native)
            if cells.shape[1] < n:
                cells = np.repeat(cells[:, :1], n, axis=1)
        yield Group(live[part], ct, w, h, cells)


def build(size: int, parts: list[tuple[np.ndarray, CellType, int, int, np.ndarray]]) -> pa.StructArray:
    """An array of ``size`` tiles, null where no part (indexes, type, columns, rows, matrix) has one."""
    names, cols, rows, data = [None] * size, [None] * size, [None] * size, [None] * size
    for at, ct, w, h, cells in parts:
        name = ct.name
        for i, payload in zip(at.tolist(), pack(ct, cells)):
            names[i], cols[i], rows[i], data[i] = name, w, h, payload
    missing = pa.array([x is None for x in names])
    fields = [pa.array(names, pa.string()), pa.array(cols, pa.int16()), pa.array(rows, pa.int16()), pa.array(data, pa.binary())]
    return pa.StructArray.from_arrays(fields, fields=list(ARROW_TILE), mask=missing)


def reduce_cells(tiles: pa.StructArray, fill: float, kernel: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """One double for each tile from a kernel over matrices of doubles (NaN: NoData); ``fill`` for null tiles."""
    out = np.full(len(tiles), fill)
    for g in groups(tiles):
        out[g.at] = kernel(g.doubles())
    return out


def map_tiles(tiles: pa.StructArray, kernel: Callable[[Group], tuple[CellType, int, int, np.ndarray]]) -> pa.StructArray:
    """Tiles from a kernel over groups; null stays null."""
    return build(len(tiles), [(g.at, *kernel(g)) for g in groups(tiles)])
