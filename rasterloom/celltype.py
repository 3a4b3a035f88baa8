"""Cell types: names, numpy types, NoData values, unions and conversions."""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

# Cell type families with their big-endian payload types and default NoData values.
FAMILIES = {
    "bool": ("u1", None),
    "int8": ("i1", -128),
    "uint8": ("u1", 0),
    "int16": ("i2", -32768),
    "uint16": ("u2", 0),
    "int32": ("i4", -2147483648),
    "float32": ("f4", float("nan")),
    "float64": ("f8", float("nan")),
}

#: What a tile read as integers has in place of NoData.
INT_NODATA = -2147483648


@dataclass(frozen=True)
class CellType:
    """A family with no NoData (``raw``), its default NoData, or a value of the user's (``ud<value>``)."""

    family: str
    kind: str  # "raw", "default" or "user"
    nodata: float | None

    @property
    def name(self) -> str:
        if self.family == "bool":
            return "bool"
        if self.kind == "raw":
            return f"{self.family}raw"
        if self.kind == "default":
            return self.family
        return f"{self.family}ud{self.nodata if self.floating else int(self.nodata)}"

    @property
    def floating(self) -> bool:
        return self.family.startswith("float")

    @property
    def stored(self) -> np.dtype:
        """Type of the payload: big-endian."""
        return np.dtype(">" + FAMILIES[self.family][0])

    @property
    def native(self) -> np.dtype:
        return np.dtype(FAMILIES[self.family][0])

    @property
    def bits(self) -> int:
        return 1 if self.family == "bool" else 8 * self.native.itemsize

    def mask(self, cells: np.ndarray) -> np.ndarray | None:
        """True where cells have data; None: everywhere."""
        if self.nodata is None:
            return None
        if self.floating and np.isnan(self.nodata):
            return ~np.isnan(cells)
        out = cells != np.array(self.nodata).astype(self.native)
        # a user's NoData does not turn NaN into data
        return out & ~np.isnan(cells) if self.floating else out

    def doubles(self, cells: np.ndarray) -> np.ndarray:
        """Cells as float64, NoData as NaN."""
        out = cells.astype(np.float64)
        mask = self.mask(cells)
        if mask is not None and not mask.all():
            out[~mask] = np.nan
        return out

    def from_doubles(self, values: np.ndarray) -> np.ndarray:
        """Cells of this type from float64 with NaN as NoData; integers are cut off and wrap, NaN is zero without a NoData value."""
        missing = np.isnan(values)
        if self.floating:
            out = values.astype(self.native)
            if self.nodata is not None and not np.isnan(self.nodata):
                out[missing] = self.nodata
            return out
        if self.family == "bool":
            return (np.where(missing, 0, values) != 0).astype(self.native)
        whole = np.clip(np.where(missing, 0, values), -(2.0**63), 2.0**63 - 1024).astype(np.int64).astype(self.native)
        if missing.any() and self.nodata is not None:
            whole[missing] = np.array(int(self.nodata)).astype(self.native)
        return whole


@lru_cache(maxsize=4096)
def parse(name: str) -> CellType:
    """``int8``, ``uint16raw``, ``float32ud-9999.0`` and so on."""
    m = re.fullmatch(r"(bool|u?int8|u?int16|int32|float32|float64)(raw|ud(.+))?", name)
    if m is None or (m[1] == "bool" and m[2]):
        raise ValueError(f"unknown cell type: {name}")
    family, kind, value = m.groups()
    if family == "bool" or kind == "raw":
        return CellType(family, "raw", None)
    if kind is None:
        return CellType(family, "default", FAMILIES[family][1])
    return CellType(family, "user", float(value))


def with_nodata(ct: CellType, value: float) -> CellType:
    """The same family with a NoData value of the user's."""
    if ct.family == "bool":
        raise ValueError("bool has no NoData value")
    return CellType(ct.family, "user", float(value))


def union(a: CellType, b: CellType) -> CellType:
    """The wider of two types; of equally wide ones a floating type, else the first."""
    if a.bits != b.bits:
        return a if a.bits > b.bits else b
    return b if b.floating and not a.floating else a


def names() -> list[str]:
    """All types without a NoData value of the user's."""
    return ["bool"] + [f + k for f in FAMILIES if f != "bool" for k in ("raw", "")]


def of_dtype(dtype: np.dtype, nodata: float | None = None) -> CellType:
    """The type that holds a numpy array's values; raw for integers without a NoData value."""
    kind = {"b": "bool", "i1": "int8", "u1": "uint8", "i2": "int16", "u2": "uint16", "i4": "int32", "f4": "float32", "f8": "float64"}
    dtype = np.dtype(dtype)
    key = "b" if dtype.kind == "b" else f"{dtype.kind}{dtype.itemsize}"
    family = kind.get(key, "int32" if dtype.kind in "iu" and dtype.itemsize <= 4 else "float64")
    if family == "bool":
        return parse("bool")
    if nodata is not None:
        return CellType(family, "user", float(nodata))
    return parse(family) if family.startswith("float") else parse(family + "raw")
