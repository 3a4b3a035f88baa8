"""Layer metadata: extents, layouts and key bounds, kept as JSON in the metadata of the spatial key column."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

#: Keys of the column metadata: the layer's JSON, and a column's role.
CONTEXT, ROLE = "_context", "_stRole"
SPATIAL, TEMPORAL = "spatial", "temporal"


@dataclass(frozen=True)
class Extent:
    xmin: float
    ymin: float
    xmax: float
    ymax: float

    @property
    def width(self) -> float:
        return self.xmax - self.xmin

    @property
    def height(self) -> float:
        return self.ymax - self.ymin

    @property
    def center(self) -> tuple[float, float]:
        return (self.xmin + self.xmax) / 2, (self.ymin + self.ymax) / 2

    def intersection(self, other: Extent) -> Extent | None:
        e = Extent(max(self.xmin, other.xmin), max(self.ymin, other.ymin), min(self.xmax, other.xmax), min(self.ymax, other.ymax))
        return e if e.xmin <= e.xmax and e.ymin <= e.ymax else None

    def json(self) -> dict:
        return {"xmin": self.xmin, "ymin": self.ymin, "xmax": self.xmax, "ymax": self.ymax}


@dataclass(frozen=True)
class TileLayout:
    layout_cols: int
    layout_rows: int
    tile_cols: int
    tile_rows: int

    def subdivide(self, n: int) -> TileLayout:
        """n by n tiles in place of one; no change for 0 and 1."""
        if n < 0:
            raise ValueError(f"cannot divide tiles by {n}")
        if n <= 1:
            return self
        if self.tile_cols % n or self.tile_rows % n:
            raise ValueError(f"{n} does not divide tiles of {self.tile_cols} x {self.tile_rows}")
        return TileLayout(self.layout_cols * n, self.layout_rows * n, self.tile_cols // n, self.tile_rows // n)

    def json(self) -> dict:
        return {"layoutCols": self.layout_cols, "layoutRows": self.layout_rows, "tileCols": self.tile_cols, "tileRows": self.tile_rows}


@dataclass(frozen=True)
class Layout:
    """A grid of tiles over an extent; row 0 is the northernmost."""

    extent: Extent
    tiles: TileLayout

    @property
    def tile_width(self) -> float:
        return self.extent.width / self.tiles.layout_cols

    @property
    def tile_height(self) -> float:
        return self.extent.height / self.tiles.layout_rows

    def key_extent(self, col: int, row: int) -> Extent:
        x, y = self.extent.xmin + col * self.tile_width, self.extent.ymax - row * self.tile_height
        return Extent(x, y - self.tile_height, x + self.tile_width, y)

    def point_key(self, x: float, y: float) -> tuple[int, int]:
        return math.floor((x - self.extent.xmin) / self.tile_width), math.floor((self.extent.ymax - y) / self.tile_height)

    def extent_keys(self, e: Extent) -> tuple[int, int, int, int]:
        """colMin, rowMin, colMax, rowMax of the keys that an extent covers; an edge on a border belongs to the inner key."""
        c0, r0 = self.point_key(e.xmin, e.ymax)
        c1 = math.ceil((e.xmax - self.extent.xmin) / self.tile_width - 1e-9) - 1
        r1 = math.ceil((self.extent.ymax - e.ymin) / self.tile_height - 1e-9) - 1
        return c0, r0, max(c0, c1), max(r0, r1)


@dataclass(frozen=True)
class KeyBounds:
    """Least and greatest keys; instants (epoch milliseconds) for layers with a temporal key."""

    col_min: int
    row_min: int
    col_max: int
    row_max: int
    instant_min: int | None = None
    instant_max: int | None = None

    def subdivide(self, n: int) -> KeyBounds:
        if n <= 1:
            return self
        return replace(self, col_min=self.col_min * n, row_min=self.row_min * n, col_max=(self.col_max + 1) * n - 1, row_max=(self.row_max + 1) * n - 1)

    def json(self) -> dict:
        low, high = {"col": self.col_min, "row": self.row_min}, {"col": self.col_max, "row": self.row_max}
        if self.instant_min is not None:
            low["instant"], high["instant"] = self.instant_min, self.instant_max
        return {"minKey": low, "maxKey": high}


def subdivide_key(col: int, row: int, n: int) -> list[tuple[int, int]]:
    """The n * n keys in place of one, row by row."""
    return [(col * n + j, row * n + i) for i in range(n) for j in range(n)]


@dataclass(frozen=True)
class LayerMetadata:
    cell_type: str
    layout: Layout
    extent: Extent
    crs: str
    bounds: KeyBounds

    @property
    def temporal(self) -> bool:
        return self.bounds.instant_min is not None

    def subdivide(self, n: int) -> LayerMetadata:
        return replace(self, layout=replace(self.layout, tiles=self.layout.tiles.subdivide(n)), bounds=self.bounds.subdivide(n))

    def json(self) -> dict:
        return {
            "cellType": self.cell_type,
            "layoutDefinition": {"extent": self.layout.extent.json(), "tileLayout": self.layout.tiles.json()},
            "extent": self.extent.json(),
            "crs": self.crs,
            "bounds": self.bounds.json(),
        }

    @staticmethod
    def from_json(j: dict) -> LayerMetadata:
        e = lambda x: Extent(float(x["xmin"]), float(x["ymin"]), float(x["xmax"]), float(x["ymax"]))
        t, low, high = j["layoutDefinition"]["tileLayout"], j["bounds"]["minKey"], j["bounds"]["maxKey"]
        return LayerMetadata(
            j["cellType"],
            Layout(e(j["layoutDefinition"]["extent"]), TileLayout(*(int(t[k]) for k in ("layoutCols", "layoutRows", "tileCols", "tileRows")))),
            e(j["extent"]),
            j["crs"],
            KeyBounds(int(low["col"]), int(low["row"]), int(high["col"]), int(high["row"]), low.get("instant"), high.get("instant")),
        )
