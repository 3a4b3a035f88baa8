"""Z curves over keys: interleaved bits as columns, and the ranges of a box on the curve, so that filters reach sorted files.

An index interleaves the low bits of two or three coordinates, the first one in the lowest bit. Coordinates are clamped to what
the bits can hold, for rows and boxes alike, so a box never loses a row. ``ranges`` covers a box by few intervals of the curve:
squares (or cubes) of the recursive halving that are inside, and coarser ones where there would be too many. As
comparisons on a column that a file is sorted by they let Parquet skip whatever its statistics exclude.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each coordinate, by the number of coordinates: an index is a positive long.
BITS = {2: 31, 3: 21}

#: Intervals that a box is covered by, at most.
MOST = 64


def steps(dims: int) -> list[tuple[int, int]]:
    """Shifts and masks that spread a coordinate's bits ``dims`` apart: each step halves the groups that lie together."""
    bits, out = BITS[dims], []
    group = 1 << (bits - 1).bit_length()
    while group > 1:
        group //= 2
        out.append((group * (dims - 1), sum(1 << (i // group * group * dims + i % group) for i in range(bits))))
    return out


def _clamped(v: int, dims: int) -> int:
    return max(0, min(v, (1 << BITS[dims]) - 1))


def interleave(*coordinates: Column) -> Column:
    """The index of two or three whole coordinates; no Python."""
    dims = len(coordinates)

    def spread(v: Column) -> Column:
        v = F.least(F.greatest(v.cast("long"), F.lit(0)), F.lit((1 << BITS[dims]) - 1))
        for shift, mask in steps(dims):
            v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
        return v

    return reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(spread(v), k) if k else spread(v) for k, v in enumerate(coordinates)])


def interleaved(*coordinates: int) -> int:
    """The same for whole numbers."""
    dims = len(coordinates)
    return sum((_clamped(v, dims) >> i & 1) << (i * dims + k) for k, v in enumerate(coordinates) for i in range(BITS[dims]))


def ranges(low: tuple[int, ...], high: tuple[int, ...], most: int = MOST) -> list[tuple[int, int]]:
    """Intervals of the curve, both ends included, that hold all of a box (both corners included) and as little else as ``most`` allow."""
    dims = len(low)
    low, high = (tuple(_clamped(v, dims) for v in c) for c in (low, high))
    if any(a > b for a, b in zip(low, high)):
        return []
    done: list[tuple[int, int]] = []
    level, open_ = BITS[dims], [(0, (0,) * dims)]  # cells of a level: start on the curve, corner

    def inside(corner: tuple[int, ...], side: int) -> bool:
        return all(a <= c and c + side - 1 <= b for a, b, c in zip(low, high, corner))

    def meets(corner: tuple[int, ...], side: int) -> bool:
        return all(c <= b and a <= c + side - 1 for a, b, c in zip(low, high, corner))

    while open_:
        side = 1 << level
        done += [(z, z + (1 << level * dims) - 1) for z, c in open_ if inside(c, side)]
        open_ = [(z, c) for z, c in open_ if not inside(c, side)]
        finer = []
        for z, c in open_:
            for k in range(1 << dims):
                corner = tuple(v + (side // 2 if k >> i & 1 else 0) for i, v in enumerate(c))
                if meets(corner, side // 2):
                    finer.append((z + (k << (level - 1) * dims), corner))
        if len(_joined(done + [(z, z + (1 << (level - 1) * dims) - 1) for z, _ in finer])) > most:
            done += [(z, z + (1 << level * dims) - 1) for z, _ in open_]
            break
        open_, level = finer, level - 1
    return _joined(done)


def _joined(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def within(index: Column, found: list[tuple[int, int]]) -> Column:
    """Whether an index is in one of the intervals."""
    return reduce(or_, [index.between(a, b) for a, b in found], F.lit(False)) if found else F.lit(False)
