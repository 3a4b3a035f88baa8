"""A reader and writer of TIFF files with georeference, on struct, zlib and numpy alone.

Reads classic and big TIFF, strips and tiles, chunky and planar bands, no compression, LZW, deflate and PackBits, and predictors
1 to 3. Blocks are read one at a time, so windows of large files cost what they cover.
"""

from __future__ import annotations

import io
import struct
import zlib
from dataclasses import dataclass, field
from typing import BinaryIO

import numpy as np

from rasterloom.celltype import CellType, of_dtype, parse
from rasterloom.crs import LATLNG, from_epsg
from rasterloom.operators.metadata import Extent
from rasterloom.sources.storage import open_input

# TIFF field types (size, struct code) and tag numbers.
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, "B"), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d"), 16: (8, "Q"), 17: (8, "q"), 18: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, DESCRIPTION = 256, 257, 258, 259, 262, 270
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR, DATE, PREDICTOR = 273, 277, 278, 279, 284, 306, 317
TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES, EXTRA, FORMAT = 322, 323, 324, 325, 338, 339
PIXEL_SCALE, TIEPOINT, TRANSFORMATION, GEO_KEYS, GEO_DOUBLES, GEO_ASCII, GDAL_METADATA, GDAL_NODATA = 33550, 33922, 34264, 34735, 34736, 34737, 42112, 42113
NAMES = {WIDTH: "ImageWidth", HEIGHT: "ImageLength", COMPRESSION: "Compression", DESCRIPTION: "ImageDescription", DATE: "DateTime", GDAL_METADATA: "GDAL_METADATA", GDAL_NODATA: "GDAL_NODATA"}


def _lzw(data: bytes) -> bytes:
    out, table, bits, at, width, prev = bytearray(), [], 0, 0, 9, None
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    value, n = 0, len(data)
    while True:
        while bits < width:
            if at >= n:
                return bytes(out)
            value = (value << 8 | data[at]) & 0xFFFFFFFF
            at, bits = at + 1, bits + 8
        code = value >> (bits - width) & ((1 << width) - 1)
        bits -= width
        if code == 257:
            return bytes(out)
        if code == 256:
            table, width, prev = list(base), 9, None
            continue
        if prev is None:
            entry = table[code] if table else base[code]
            table = table or list(base)
        else:
            entry = table[code] if code < len(table) else prev + prev[:1]
            table.append(prev + entry[:1])
        out += entry
        prev = entry
        size = len(table)
        width = 9 if size < 511 else 10 if size < 1023 else 11 if size < 2047 else 12


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2
    return bytes(out)


@dataclass
class Tiff:
    """The first image of a file: its tags, and access to its blocks."""

    file: BinaryIO
    order: str = "<"
    tags: dict[int, tuple] = field(default_factory=dict)

    @staticmethod
    def open(source: str | bytes | BinaryIO) -> Tiff:
        f = open_input(source) if isinstance(source, str) else io.BytesIO(source) if isinstance(source, bytes) else source
        t = Tiff(f)
        head = f.read(16)
        t.order = {b"II": "<", b"MM": ">"}.get(head[:2], "")
        if not t.order:
            raise ValueError("not a TIFF file")
        magic = struct.unpack(t.order + "H", head[2:4])[0]
        if magic not in (42, 43):
            raise ValueError("not a TIFF file")
        big = magic == 43
        at = struct.unpack(t.order + ("Q" if big else "I"), head[8:16] if big else head[4:8])[0]
        f.seek(at)
        n = struct.unpack(t.order + ("Q" if big else "H"), f.read(8 if big else 2))[0]
        size = 20 if big else 12
        body = f.read(n * size)
        for i in range(n):
            e = body[i * size : (i + 1) * size]
            tag, kind = struct.unpack(t.order + "HH", e[:4])
            count = struct.unpack(t.order + ("Q" if big else "I"), e[4 : 12 if big else 8])[0]
            if kind not in TYPES:
                continue
            each, code = TYPES[kind]
            room = 8 if big else 4
            raw = e[-room:]
            if each * count > room:
                f.seek(struct.unpack(t.order + ("Q" if big else "I"), raw)[0])
                raw = f.read(each * count)
            raw = raw[: each * count]
            t.tags[tag] = (raw.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(t.order + code[0] * (count * len(code)), raw)
        return t

    def one(self, tag: int, default=None):
        return self.tags[tag][0] if tag in self.tags else default

    @property
    def width(self) -> int:
        return self.one(WIDTH)

    @property
    def height(self) -> int:
        return self.one(HEIGHT)

    @property
    def bands(self) -> int:
        return self.one(SAMPLES, 1)

    @property
    def tiled(self) -> bool:
        return TILE_OFFSETS in self.tags

    @property
    def block(self) -> tuple[int, int]:
        """Columns and rows of a block."""
        if self.tiled:
            return self.one(TILE_WIDTH), self.one(TILE_HEIGHT)
        return self.width, min(self.one(ROWS_PER_STRIP, self.height), self.height)

    @property
    def dtype(self) -> np.dtype:
        bits, kind = self.one(BITS, 1), {1: "u", 2: "i", 3: "f"}.get(self.one(FORMAT, 1), "u")
        return np.dtype("u1") if bits == 1 else np.dtype(f"{self.order}{kind}{bits // 8}")

    @property
    def cell_type(self) -> CellType:
        if self.one(BITS, 1) == 1:
            return parse("bool")
        text = self.one(GDAL_NODATA)
        try:
            nodata = float(text.strip()) if text else None
        except ValueError:
            nodata = None
        if nodata is not None and nodata != nodata:
            return of_dtype(self.dtype)
        return of_dtype(self.dtype, nodata)

    @property
    def extent(self) -> Extent:
        if PIXEL_SCALE in self.tags and TIEPOINT in self.tags:
            sx, sy = self.tags[PIXEL_SCALE][:2]
            i, j, _, x, y = self.tags[TIEPOINT][:5]
            x0, y1 = x - i * sx, y + j * sy
        elif TRANSFORMATION in self.tags:
            m = self.tags[TRANSFORMATION]
            sx, sy, x0, y1 = m[0], -m[5], m[3], m[7]
        else:
            sx = sy = 1.0
            x0, y1 = 0.0, float(self.height)
        return Extent(x0, y1 - sy * self.height, x0 + sx * self.width, y1)

    @property
    def crs(self) -> str:
        keys = self.tags.get(GEO_KEYS, ())
        found = {keys[i]: keys[i + 3] for i in range(4, len(keys) - 3, 4) if keys[i + 1] == 0}
        for key in (3072, 2048):
            if key in found and found[key] != 32767:
                if found[key] == 4326 or key == 2048:
                    return LATLNG
                try:
                    return from_epsg(found[key])
                except ValueError:
                    return f"EPSG:{found[key]}"
        return LATLNG

    def metadata(self) -> dict[str, str]:
        return {NAMES[k]: str(v[0]) for k, v in sorted(self.tags.items()) if k in NAMES}

    def _decode(self, raw: bytes, cols: int, rows: int, samples: int) -> np.ndarray:
        compression = self.one(COMPRESSION, 1)
        if compression in (8, 32946):
            raw = zlib.decompress(raw)
        elif compression == 5:
            raw = _lzw(raw)
        elif compression == 32773:
            raw = _packbits(raw)
        elif compression != 1:
            raise ValueError(f"compression {compression} is not supported")
        if self.one(BITS, 1) == 1:
            line = -(-cols * samples // 8)
            return np.unpackbits(np.frombuffer(raw, np.uint8)[: line * rows].reshape(rows, line), axis=1)[:, : cols * samples].reshape(rows, cols, samples)
        dtype, predictor = self.dtype, self.one(PREDICTOR, 1)
        need = rows * cols * samples * dtype.itemsize
        raw = raw.ljust(need, b"\0")[:need]
        if predictor == 3:
            lines = np.frombuffer(raw, np.uint8).reshape(rows, -1)
            step = lines.reshape(rows, -1, samples).cumsum(axis=1, dtype=np.uint8).reshape(rows, dtype.itemsize, cols * samples)
            cells = np.ascontiguousarray(step.transpose(0, 2, 1)).view(">f%d" % dtype.itemsize)
            return cells.reshape(rows, cols, samples)
        cells = np.frombuffer(raw, dtype).reshape(rows, cols, samples)
        if predictor == 2:
            cells = cells.astype(dtype.newbyteorder("=")).cumsum(axis=1, dtype=dtype.newbyteorder("="))
        return cells

    def read_block(self, index: int, band: int | None = None) -> np.ndarray:
        """One block as (rows, cols, samples); with planar bands the block of one band."""
        cols, rows = self.block
        offsets, sizes = (TILE_OFFSETS, TILE_SIZES) if self.tiled else (STRIP_OFFSETS, STRIP_SIZES)
        planar = self.one(PLANAR, 1) == 2
        if planar:
            index += (band or 0) * self.blocks_across * self.blocks_down
        at = index % (self.blocks_across * self.blocks_down)
        if not self.tiled:
            rows = min(rows, self.height - at * rows)
        samples = 1 if planar else self.bands
        start, size = self.tags[offsets][index], self.tags[sizes][index]
        if size == 0:  # a sparse file's missing block
            return np.zeros((rows, cols, samples), self.dtype)
        self.file.seek(start)
        return self._decode(self.file.read(size), cols, rows, samples)

    @property
    def blocks_across(self) -> int:
        return -(-self.width // self.block[0])

    @property
    def blocks_down(self) -> int:
        return -(-self.height // self.block[1])

    def window(self, col: int, row: int, cols: int, rows: int) -> np.ndarray:
        """(bands, rows, cols) of a window; cells outside of the image are NoData."""
        ct = self.cell_type
        fill = ct.from_doubles(np.array([np.nan]))[0]
        out = np.full((self.bands, rows, cols), fill, ct.native)
        bw, bh = self.block
        planar = self.one(PLANAR, 1) == 2
        for by in range(max(0, row // bh), min(self.blocks_down, -(-(row + rows) // bh))):
            for bx in range(max(0, col // bw), min(self.blocks_across, -(-(col + cols) // bw))):
                for band in range(self.bands if planar else 1):
                    b = self.read_block(by * self.blocks_across + bx, band)
                    x0, x1 = max(col, bx * bw), min(col + cols, bx * bw + b.shape[1], self.width)
                    y0, y1 = max(row, by * bh), min(row + rows, by * bh + b.shape[0], self.height)
                    if x0 >= x1 or y0 >= y1:
                        continue
                    part = b[y0 - by * bh : y1 - by * bh, x0 - bx * bw : x1 - bx * bw]
                    if planar:
                        out[band, y0 - row : y1 - row, x0 - col : x1 - col] = part[:, :, 0]
                    else:
                        out[:, y0 - row : y1 - row, x0 - col : x1 - col] = part.transpose(2, 0, 1)
        return out


#: Rows of a strip.
STRIP = 64


@dataclass(frozen=True)
class Form:
    """What a file is written as: square tiles with sides of ``tile`` cells, or strips of ``STRIP`` rows; bands side by side."""

    width: int
    height: int
    bands: int
    cell_type: CellType
    extent: Extent
    crs: str = LATLNG
    tile: int | None = None
    compress: bool = True

    @property
    def block(self) -> tuple[int, int]:
        return (self.tile, self.tile) if self.tile else (self.width, STRIP)

    @property
    def across(self) -> int:
        return -(-self.width // self.block[0])

    @property
    def blocks(self) -> int:
        return self.across * -(-self.height // self.block[1])

    def window(self, block: int) -> tuple[int, int, int, int]:
        """First column and row, columns and rows of a block; tiles reach beyond the image, strips do not."""
        (w, h), (r, c) = self.block, divmod(block, self.across)
        return c * w, r * h, w, h if self.tile else min(h, self.height - r * h)

    def pack(self, cells: np.ndarray) -> bytes:
        """A block's bytes from (bands, rows, cols)."""
        raw = np.ascontiguousarray(cells.astype(self.cell_type.native.newbyteorder("<")).transpose(1, 2, 0)).tobytes()
        return zlib.compress(raw) if self.compress else raw

    def directory(self, sizes: list[int], places: list[int], total: int) -> bytes:
        """All before the blocks, whose ``places`` count from its end; a big TIFF where ``total`` bytes of blocks need it."""
        big = total + 24 * len(sizes) + (1 << 16) >= 1 << 32
        room, number, at_kind = (8, "Q", 16) if big else (4, "I", 4)
        dtype = self.cell_type.native
        epsg, projected = _epsg(self.crs)
        keys = [1, 1, 0, 3, 1024, 0, 1, 1 if projected else 2, 1025, 0, 1, 1, 3072 if projected else 2048, 0, 1, epsg]
        entries: list[tuple[int, int, tuple]] = [
            (WIDTH, 4, (self.width,)),
            (HEIGHT, 4, (self.height,)),
            (BITS, 3, (dtype.itemsize * 8,) * self.bands),
            (COMPRESSION, 3, (8 if self.compress else 1,)),
            (PHOTOMETRIC, 3, (2 if self.bands == 3 and dtype.itemsize == 1 else 1,)),
            (SAMPLES, 3, (self.bands,)),
            (PLANAR, 3, (1,)),
            (FORMAT, 3, ({"f": 3, "i": 2, "u": 1}[dtype.kind],) * self.bands),
            (PIXEL_SCALE, 12, (self.extent.width / self.width, self.extent.height / self.height, 0.0)),
            (TIEPOINT, 12, (0.0, 0.0, 0.0, self.extent.xmin, self.extent.ymax, 0.0)),
            (GEO_KEYS, 3, tuple(keys)),
        ]
        nodata = self.cell_type.nodata
        if nodata is not None:
            text = ("nan" if nodata != nodata else repr(float(nodata)) if self.cell_type.floating else str(int(nodata))).encode() + b"\0"
            entries.append((GDAL_NODATA, 2, (text,)))
        of_sizes, of_places = (TILE_SIZES, TILE_OFFSETS) if self.tile else (STRIP_SIZES, STRIP_OFFSETS)
        entries += [(TILE_WIDTH, 3, (self.tile,)), (TILE_HEIGHT, 3, (self.tile,))] if self.tile else [(ROWS_PER_STRIP, 3, (STRIP,))]
        entries += [(of_places, at_kind, tuple(places)), (of_sizes, 4, tuple(sizes))]
        entries.sort(key=lambda e: e[0])

        def packed(kind: int, values: tuple) -> bytes:
            return values[0] if kind == 2 else struct.pack("<" + TYPES[kind][1] * len(values), *values)

        raws = {tag: packed(kind, values) for tag, kind, values in entries}
        head = struct.pack("<2sHHHQQ", b"II", 43, 8, 0, 16, len(entries)) if big else struct.pack("<2sHIH", b"II", 42, 8, len(entries))
        extra_at = len(head) + len(entries) * (4 + 2 * room) + room
        first = extra_at + sum(-(-len(r) // 2) * 2 for r in raws.values() if len(r) > room)
        raws[of_places] = packed(at_kind, tuple(x + first for x in places))
        out, extra, at = [head], [], extra_at
        for tag, kind, values in entries:
            raw = raws[tag]
            count = len(raw) if kind == 2 else len(values)
            out.append(struct.pack("<HH" + number, tag, kind, count))
            if len(raw) <= room:
                out.append(raw.ljust(room, b"\0"))
            else:
                out.append(struct.pack("<" + number, at))
                extra.append(raw + b"\0" * (len(raw) % 2))
                at += len(extra[-1])
        return b"".join([*out, struct.pack("<" + number, 0), *extra])


def encode(cells: np.ndarray, cell_type: CellType, extent: Extent, crs: str = LATLNG, tile: int | None = None, compress: bool = True) -> bytes:
    """A TIFF file of (bands, rows, cols) cells, in strips of 64 rows or in square tiles."""
    cells = np.asarray(cells)
    if cells.ndim == 2:
        cells = cells[None]
    bands, rows, cols = cells.shape
    form = Form(cols, rows, bands, cell_type, extent, crs, tile, compress)
    blocks = []
    for k in range(form.blocks):
        x, y, w, h = form.window(k)
        part = cells[:, y : y + h, x : x + w]
        whole = np.zeros((bands, h, w), cells.dtype)
        whole[:, : part.shape[1], : part.shape[2]] = part
        blocks.append(form.pack(whole))
    sizes = list(map(len, blocks))
    places = np.concatenate(([0], np.cumsum(sizes)[:-1])).astype(int).tolist()
    return b"".join([form.directory(sizes, places, sum(sizes)), *blocks])


def _epsg(crs: str) -> tuple[int, bool]:
    """EPSG code, and whether it is projected; 32767 (user-defined) where none is known."""
    from rasterloom.crs import parse as parse_crs

    p = parse_crs(crs)
    if p["proj"] in ("longlat", "latlong"):
        return 4326, False
    if p["proj"] == "merc" and p.get("a") == p.get("b"):
        return 3857, True
    if p["proj"] == "utm":
        return (32700 if "south" in p else 32600) + int(p["zone"]), True
    return 32767, True
