"""Geometries as WKB columns: codec, literals, predicates and measures.

Predicates follow the usual intersection model for points, lines, polygons, their multiples and collections. They work on the
noded arrangement of both geometries: boundaries are cut where they cross, and the pieces' midpoints, the vertices and points
inside faces are located in the other geometry, which says which of interior, boundary and exterior meet, and in what dimension.
"""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-12

# WKB type codes.
CODES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}
NUMBERS = {v: k for k, v in CODES.items()}

Pt = tuple[float, float]


@dataclass(frozen=True)
class Geometry:
    """Points, lines and polygons (rings, the first one outside) of a geometry, with the name of its type."""

    kind: str
    points: tuple[Pt, ...] = ()
    lines: tuple[tuple[Pt, ...], ...] = ()
    polygons: tuple[tuple[tuple[Pt, ...], ...], ...] = ()
    parts: tuple[Geometry, ...] = field(default=(), compare=False)

    @property
    def dimension(self) -> int:
        return 2 if self.polygons else 1 if self.lines else 0 if self.points else -1

    def coordinates(self) -> list[Pt]:
        return [*self.points, *(p for x in self.lines for p in x), *(p for x in self.polygons for ring in x for p in ring)]

    def box(self) -> tuple[float, float, float, float]:
        """minX, maxX, minY, maxY."""
        xy = np.array(self.coordinates())
        return float(xy[:, 0].min()), float(xy[:, 0].max()), float(xy[:, 1].min()), float(xy[:, 1].max())

    def wkb(self) -> bytes:
        return to_wkb(self)


def point(x: float, y: float) -> Geometry:
    return Geometry("Point", points=((float(x), float(y)),))


def line(*coordinates: Pt) -> Geometry:
    return Geometry("LineString", lines=(tuple((float(x), float(y)) for x, y in coordinates),))


def polygon(shell: list[Pt], *holes: list[Pt]) -> Geometry:
    def closed(ring: list[Pt]) -> tuple[Pt, ...]:
        r = [(float(x), float(y)) for x, y in ring]
        return tuple(r if r[0] == r[-1] else [*r, r[0]])

    return Geometry("Polygon", polygons=(tuple(closed(r) for r in (shell, *holes)),))


def box(xmin: float, ymin: float, xmax: float, ymax: float) -> Geometry:
    return polygon([(xmin, ymin), (xmin, ymax), (xmax, ymax), (xmax, ymin)])


def collection(*parts: Geometry, kind: str = "GeometryCollection") -> Geometry:
    join = lambda name: tuple(x for p in parts for x in getattr(p, name))
    return Geometry(kind, join("points"), join("lines"), join("polygons"), parts)


# -- codecs ---------------------------------------------------------------------------------------------------------------


def to_wkb(g: Geometry) -> bytes:
    head = struct.pack("<BI", 1, NUMBERS[g.kind])
    ring = lambda r: struct.pack("<I", len(r)) + b"".join(struct.pack("<dd", *p) for p in r)
    if g.kind == "Point":
        return head + (struct.pack("<dd", *g.points[0]) if g.points else struct.pack("<dd", float("nan"), float("nan")))
    if g.kind == "LineString":
        return head + ring(g.lines[0] if g.lines else ())
    if g.kind == "Polygon":
        rings = g.polygons[0] if g.polygons else ()
        return head + struct.pack("<I", len(rings)) + b"".join(map(ring, rings))
    parts = g.parts or tuple([*(point(*p) for p in g.points), *(Geometry("LineString", lines=(x,)) for x in g.lines), *(Geometry("Polygon", polygons=(x,)) for x in g.polygons)])
    return head + struct.pack("<I", len(parts)) + b"".join(map(to_wkb, parts))


@lru_cache(maxsize=8192)
def from_wkb(data: bytes) -> Geometry:
    return _read_wkb(data, 0)[0]


def _read_wkb(data: bytes, at: int) -> tuple[Geometry, int]:
    order = "<" if data[at] == 1 else ">"
    code = struct.unpack_from(order + "I", data, at + 1)[0]
    kind, at = CODES[code & 0xFF], at + 5

    def ring() -> tuple[Pt, ...]:
        nonlocal at
        n = struct.unpack_from(order + "I", data, at)[0]
        flat = struct.unpack_from(f"{order}{2 * n}d", data, at + 4)
        at += 4 + 16 * n
        return tuple(zip(flat[::2], flat[1::2]))

    if kind == "Point":
        x, y = struct.unpack_from(order + "dd", data, at)
        return (Geometry(kind) if x != x else point(x, y)), at + 16
    if kind == "LineString":
        r = ring()
        return Geometry(kind, lines=(r,) if r else ()), at
    n = struct.unpack_from(order + "I", data, at)[0]
    at += 4
    if kind == "Polygon":
        rings = tuple(ring() for _ in range(n))
        return Geometry(kind, polygons=(rings,) if rings else ()), at
    parts = []
    for _ in range(n):
        g, at = _read_wkb(data, at)
        parts.append(g)
    return collection(*parts, kind=kind), at


def from_wkt(text: str) -> Geometry:
    m = re.match(r"\s*([A-Za-z]+)\s*(.*)$", text, re.S)
    kinds = {k.upper(): k for k in NUMBERS}
    kind, body = kinds[m[1].upper()], m[2].strip()
    if body.upper() == "EMPTY":
        return Geometry(kind)
    if kind == "GeometryCollection":
        parts, depth, start = [], 0, 1
        for i, c in enumerate(body):
            depth += (c == "(") - (c == ")")
            if (c == "," and depth == 1) or depth == 0:
                parts.append(from_wkt(body[start:i]))
                start = i + 1
        return collection(*parts)
    nested = json.loads(re.sub(r"(-?[0-9.]+(?:[eE][-+]?\d+)?)\s+(-?[0-9.]+(?:[eE][-+]?\d+)?)", lambda p: f"[{_plain(p[1])},{_plain(p[2])}]", body).replace("(", "[").replace(")", "]"))
    return from_coordinates(kind, nested[0] if kind == "Point" else [p[0] if kind == "MultiPoint" and isinstance(p[0], list) else p for p in nested])


def _plain(number: str) -> str:
    return repr(float(number))


def from_coordinates(kind: str, c) -> Geometry:
    """From the nested coordinates of GeoJSON."""
    if kind == "Point":
        return point(*c[:2])
    if kind == "LineString":
        return line(*[p[:2] for p in c])
    if kind == "Polygon":
        return polygon(*[[p[:2] for p in r] for r in c])
    return collection(*[from_coordinates(kind[5:], x) for x in c], kind=kind)


def from_geojson(g: dict) -> Geometry:
    if g["type"] == "GeometryCollection":
        return collection(*map(from_geojson, g["geometries"]))
    return from_coordinates(g["type"], g["coordinates"])


def to_wkt(g: Geometry) -> str:
    num = lambda v: repr(v).removesuffix(".0")
    ring = lambda r: "(" + ", ".join(f"{num(x)} {num(y)}" for x, y in r) + ")"
    shape = lambda rings: "(" + ", ".join(map(ring, rings)) + ")"
    name = g.kind.upper()
    if g.dimension < 0:
        return f"{name} EMPTY"
    body = {
        "Point": lambda: ring(g.points),
        "LineString": lambda: ring(g.lines[0]),
        "Polygon": lambda: shape(g.polygons[0]),
        "MultiPoint": lambda: shape([(p,) for p in g.points]),
        "MultiLineString": lambda: shape(g.lines),
        "MultiPolygon": lambda: "(" + ", ".join(map(shape, g.polygons)) + ")",
        "GeometryCollection": lambda: "(" + ", ".join(map(to_wkt, g.parts)) + ")",
    }[g.kind]()
    return f"{name} {body}"


# -- location -----------------------------------------------------------------------------------------------------------------

INTERIOR, BOUNDARY, EXTERIOR = 0, 1, 2


def _on_segment(p: Pt, a: Pt, b: Pt) -> bool:
    cross = (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    size = max(abs(b[0] - a[0]), abs(b[1] - a[1]), 1e-300)
    if abs(cross) > 1e-9 * size * max(size, 1e-300):
        return False
    slack = 1e-9 * size
    return min(a[0], b[0]) - slack <= p[0] <= max(a[0], b[0]) + slack and min(a[1], b[1]) - slack <= p[1] <= max(a[1], b[1]) + slack


def _in_ring(p: Pt, ring: tuple[Pt, ...]) -> int:
    inside = False
    for a, b in zip(ring, ring[1:]):
        if _on_segment(p, a, b):
            return BOUNDARY
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return INTERIOR if inside else EXTERIOR


def _in_polygon(p: Pt, rings: tuple[tuple[Pt, ...], ...]) -> int:
    where = _in_ring(p, rings[0])
    if where != INTERIOR:
        return where
    for hole in rings[1:]:
        inner = _in_ring(p, hole)
        if inner != EXTERIOR:
            return BOUNDARY if inner == BOUNDARY else EXTERIOR
    return INTERIOR


def locate(p: Pt, g: Geometry) -> int:
    """Whether a point is in a geometry's interior, on its boundary or outside; boundaries of lines by the mod-2 rule."""
    best = EXTERIOR
    for rings in g.polygons:
        best = min(best, _in_polygon(p, rings))
    if best == INTERIOR:
        return best
    on_line, ends = False, 0
    for x in g.lines:
        if any(_on_segment(p, a, b) for a, b in zip(x, x[1:])):
            on_line = True
            if x[0] != x[-1]:
                ends += (p == x[0]) + (p == x[-1])
    if on_line:
        best = min(best, BOUNDARY if ends % 2 else INTERIOR)
    if p in g.points:
        best = min(best, INTERIOR)
    return best


def _segments(g: Geometry) -> list[tuple[Pt, Pt]]:
    runs = [*g.lines, *(r for x in g.polygons for r in x)]
    return [(a, b) for r in runs for a, b in zip(r, r[1:]) if a != b]


def _cuts(s: tuple[Pt, Pt], others: list[tuple[Pt, Pt]], points: tuple[Pt, ...]) -> list[Pt]:
    """The ends of a segment and all places where the others or points meet it, in order along it."""
    (ax, ay), (bx, by) = s
    dx, dy = bx - ax, by - ay
    found = {0.0: s[0], 1.0: s[1]}

    def add(p: Pt) -> None:
        t = ((p[0] - ax) * dx + (p[1] - ay) * dy) / (dx * dx + dy * dy)
        if EPS < t < 1 - EPS:
            found[t] = p

    for c, d in others:
        ex, ey = d[0] - c[0], d[1] - c[1]
        den = dx * ey - dy * ex
        if abs(den) > EPS * max(abs(dx), abs(dy)) * max(abs(ex), abs(ey)):
            t = ((c[0] - ax) * ey - (c[1] - ay) * ex) / den
            u = ((c[0] - ax) * dy - (c[1] - ay) * dx) / den
            if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS:
                add((ax + t * dx, ay + t * dy))
        else:
            for p in (c, d):
                if _on_segment(p, *s):
                    add(p)
    for p in points:
        if _on_segment(p, *s):
            add(p)
    return [found[t] for t in sorted(found)]


def _inner_points(g: Geometry, others: list[tuple[Pt, Pt]]) -> list[Pt]:
    """Points inside the faces that the arrangement cuts a geometry's polygons into: on either side of each piece of an edge."""
    out = []
    for a, b in [*_segments(Geometry("", polygons=g.polygons)), *others]:
        pieces = _cuts((a, b), [*others, *_segments(g)], ())
        for p, q in zip(pieces, pieces[1:]):
            mx, my, dx, dy = (p[0] + q[0]) / 2, (p[1] + q[1]) / 2, q[0] - p[0], q[1] - p[1]
            for side in (1e-6, -1e-6):
                out.append((mx - dy * side, my + dx * side))
    return out


def relate(a: Geometry, b: Geometry) -> np.ndarray:
    """Dimension of each pair of interior, boundary and exterior of both; -1: they do not meet."""
    m = np.full((3, 3), -1)
    m[EXTERIOR, EXTERIOR] = 2
    if a.dimension < 0 or b.dimension < 0:
        return m
    sa, sb = _segments(a), _segments(b)
    for g, own, other_segments, other, flip in ((a, sa, sb, b, False), (b, sb, sa, a, True)):
        def note(p: Pt, dimension: int, where: int | None = None) -> None:
            i, j = locate(p, g) if where is None else where, locate(p, other)
            if flip:
                i, j = j, i
            m[i, j] = max(m[i, j], dimension)

        for p in g.points:
            note(p, 0)
        for s in own:
            pieces = _cuts(s, [*other_segments, *own], other.points)
            for p in pieces:
                note(p, 0)
            for p, q in zip(pieces, pieces[1:]):
                note(((p[0] + q[0]) / 2, (p[1] + q[1]) / 2), 1)
        if g.polygons:
            for p in _inner_points(g, other_segments):
                if locate(p, Geometry("", polygons=g.polygons)) == INTERIOR:
                    # faces have the dimension of both sides' interiors there
                    where = locate(p, other)
                    if where == EXTERIOR or (where == INTERIOR and other.polygons):
                        note(p, 2)
            # a polygon's interior reaches around whatever is smaller
            if not other.polygons:
                i, j = (INTERIOR, EXTERIOR) if not flip else (EXTERIOR, INTERIOR)
                m[i, j] = 2
    return m


def intersects(a: Geometry, b: Geometry) -> bool:
    if not _boxes_meet(a, b):
        return False
    return bool((relate(a, b)[:2, :2] >= 0).any())


def _boxes_meet(a: Geometry, b: Geometry) -> bool:
    if a.dimension < 0 or b.dimension < 0:
        return False
    p, q = a.box(), b.box()
    return p[0] <= q[1] and q[0] <= p[1] and p[2] <= q[3] and q[2] <= p[3]


def disjoint(a: Geometry, b: Geometry) -> bool:
    return not intersects(a, b)


def contains(a: Geometry, b: Geometry) -> bool:
    if not _boxes_meet(a, b):
        return False
    m = relate(a, b)
    return bool(m[0, 0] >= 0 and m[2, 0] < 0 and m[2, 1] < 0)


def covers(a: Geometry, b: Geometry) -> bool:
    if not _boxes_meet(a, b):
        return False
    m = relate(a, b)
    return bool((m[:2, :2] >= 0).any() and m[2, 0] < 0 and m[2, 1] < 0)


def within(a: Geometry, b: Geometry) -> bool:
    return contains(b, a)


def touches(a: Geometry, b: Geometry) -> bool:
    if not _boxes_meet(a, b) or a.dimension == b.dimension == 0:
        return False
    m = relate(a, b)
    return bool(m[0, 0] < 0 and (m[:2, :2] >= 0).any())


def crosses(a: Geometry, b: Geometry) -> bool:
    if not _boxes_meet(a, b):
        return False
    m, da, db = relate(a, b), a.dimension, b.dimension
    if da < db:
        return bool(m[0, 0] >= 0 and m[0, 2] >= 0)
    if da > db:
        return bool(m[0, 0] >= 0 and m[2, 0] >= 0)
    return bool(da == 1 and m[0, 0] == 0)


def overlaps(a: Geometry, b: Geometry) -> bool:
    if a.dimension != b.dimension or not _boxes_meet(a, b):
        return False
    m = relate(a, b)
    return bool(m[0, 0] == (1 if a.dimension == 1 else m[0, 0]) and m[0, 0] >= 0 and m[0, 2] >= 0 and m[2, 0] >= 0)


PREDICATES = {f.__name__: f for f in (intersects, contains, covers, crosses, disjoint, overlaps, touches, within)}


def area(g: Geometry) -> float:
    def ring(r: tuple[Pt, ...]) -> float:
        return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:]))) / 2

    return sum(ring(x[0]) - sum(map(ring, x[1:])) for x in g.polygons)


def length(g: Geometry) -> float:
    return sum(float(np.hypot(b[0] - a[0], b[1] - a[1])) for a, b in _segments(g))


def centroid(g: Geometry) -> Geometry:
    """Of the parts of the highest dimension, weighted by area, length or number."""
    total, x, y = 0.0, 0.0, 0.0
    if g.polygons and area(g) > 0:
        for rings in g.polygons:
            for k, r in enumerate(rings):
                signed = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(r, r[1:])) / 2
                w = (abs(signed) if k == 0 else -abs(signed)) / (6 * signed) if signed else 0.0
                x += w * sum((a[0] + b[0]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(r, r[1:]))
                y += w * sum((a[1] + b[1]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(r, r[1:]))
        total = area(g)
    elif g.lines:
        for a, b in _segments(g):
            w = float(np.hypot(b[0] - a[0], b[1] - a[1]))
            total, x, y = total + w, x + w * (a[0] + b[0]) / 2, y + w * (a[1] + b[1]) / 2
    if not total:
        c = g.coordinates()
        return point(sum(p[0] for p in c) / len(c), sum(p[1] for p in c) / len(c))
    return point(x / total, y / total)


def distance(a: Geometry, b: Geometry) -> float:
    if intersects(a, b):
        return 0.0

    def to_segment(p: Pt, s: tuple[Pt, Pt]) -> float:
        (ax, ay), (bx, by) = s
        d = (bx - ax) ** 2 + (by - ay) ** 2
        t = max(0.0, min(1.0, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / d)) if d else 0.0
        return float(np.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay)))

    ca, cb = a.coordinates(), b.coordinates()
    return min([*(float(np.hypot(p[0] - q[0], p[1] - q[1])) for p in ca for q in cb), *(to_segment(p, s) for p in ca for s in _segments(b)), *(to_segment(q, s) for q in cb for s in _segments(a))])


# -- columns -------------------------------------------------------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def geom_lit(g: Geometry) -> Column:
    return F.lit(bytearray(g.wkb()))


def polygon_of_box(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """WKB of a box from four columns."""

    @F.arrow_udf(T.BinaryType())
    def run(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        x0, y0, x1, y1 = (v.to_numpy(zero_copy_only=False).astype("<f8") for v in (a, b, c, d))
        n = len(x0)
        head = np.frombuffer(struct.pack("<BIII", 1, 3, 1, 5), np.uint8)
        ring = np.column_stack([x0, y0, x0, y1, x1, y1, x1, y0, x0, y0]).view(np.uint8).reshape(n, -1)
        body = np.hstack([np.tile(head, (n, 1)), ring])
        missing = np.isnan(x0)
        return pa.array([None if m else r.tobytes() for m, r in zip(missing, body)], pa.binary())

    return run(xmin, ymin, xmax, ymax)


_BOX_TYPE = T.StructType([T.StructField(n, T.DoubleType()) for n in ("minX", "maxX", "minY", "maxY")])

#: Kinds of geometry that need no parsing: a point, and a polygon that is a rectangle along the axes; of little-endian WKB.
_POINT, _RECTANGLE, _OTHER = 0, 1, 2


def _records(wkb: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Indexes of the values of so many bytes, and their bytes as a matrix."""
    wide = pa.types.is_large_binary(wkb.type)
    offsets = np.frombuffer(wkb.buffers()[1], np.int64 if wide else np.int32)[wkb.offset : wkb.offset + len(wkb) + 1].astype(np.int64)
    at = np.flatnonzero((np.diff(offsets) == size) & wkb.is_valid().to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.empty((0, size), np.uint8)
    return at, np.frombuffer(wkb.buffers()[2], np.uint8)[offsets[at][:, None] + np.arange(size)]


def _shapes(wkb: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Kind of each geometry, and the box (minX, maxX, minY, maxY) of those that are no others; NaN else."""
    kind, box = np.full(len(wkb), _OTHER), np.full((len(wkb), 4), np.nan)
    at, raw = _records(wkb, 21)
    own = (raw[:, :5] == np.frombuffer(struct.pack("<BI", 1, 1), np.uint8)).all(axis=1)
    xy = np.ascontiguousarray(raw[:, 5:]).view("<f8").reshape(-1, 2)
    own &= np.isfinite(xy).all(axis=1)
    kind[at[own]], box[at[own]] = _POINT, xy[own][:, [0, 0, 1, 1]]
    at, raw = _records(wkb, 93)
    own = (raw[:, :13] == np.frombuffer(struct.pack("<BIII", 1, 3, 1, 5), np.uint8)).all(axis=1)
    x, y = np.moveaxis(np.ascontiguousarray(raw[:, 13:]).view("<f8").reshape(-1, 5, 2), 2, 0)
    flat = (x[:, 0] == x[:, 1]) & (y[:, 1] == y[:, 2]) & (x[:, 2] == x[:, 3]) & (y[:, 3] == y[:, 0])
    steep = (y[:, 0] == y[:, 1]) & (x[:, 1] == x[:, 2]) & (y[:, 2] == y[:, 3]) & (x[:, 3] == x[:, 0])
    own &= (flat | steep) & (x[:, 0] == x[:, 4]) & (y[:, 0] == y[:, 4]) & (x[:, 0] != x[:, 2]) & (y[:, 0] != y[:, 2])
    own &= np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
    kind[at[own]] = _RECTANGLE
    box[at[own]] = np.column_stack([x.min(axis=1), x.max(axis=1), y.min(axis=1), y.max(axis=1)])[own]
    return kind, box


@F.arrow_udf(_BOX_TYPE)
def UDF_BOX(g: pa.Array) -> pa.Array:
    """Box of each geometry; null for null and empty ones, and for coordinates that are no numbers."""
    kind, box = _shapes(g)
    for i in np.flatnonzero((kind == _OTHER) & g.is_valid().to_numpy(zero_copy_only=False)).tolist():
        one = from_wkb(g[i].as_py())
        if one.dimension >= 0:
            box[i] = one.box()
    missing = np.isnan(box).any(axis=1)
    return pa.StructArray.from_arrays([pa.array(box[:, k].copy()) for k in range(4)], ["minX", "maxX", "minY", "maxY"], mask=pa.array(missing))


def box2d(g: Column | str) -> Column:
    name = g if isinstance(g, str) else "geometry"
    return UDF_BOX(_col(g)).alias(f"box2d({name})")


def _of_point(name: str, a: Geometry, b: Geometry) -> bool:
    """A predicate of which one side is a single point: where the point is says it all."""
    p, g = (b, a) if b.kind == "Point" and b.points else (a, b)
    asked = {"contains": "within", "covers": "coveredBy", "within": "contains"}.get(name, name) if p is a else name
    if asked not in ("intersects", "disjoint", "contains", "covers", "touches"):
        return PREDICATES[name](a, b)
    where = locate(p.points[0], g)
    return {"intersects": where != EXTERIOR, "covers": where != EXTERIOR, "disjoint": where == EXTERIOR, "contains": where == INTERIOR, "touches": where == BOUNDARY}[asked]


def _simple(name: str, a: np.ndarray, b: np.ndarray, flat_a: np.ndarray, flat_b: np.ndarray) -> np.ndarray:
    """A predicate of points and rectangles, given by their boxes; ``flat``: a point."""
    low, high = np.maximum(a[:, [0, 2]], b[:, [0, 2]]), np.minimum(a[:, [1, 3]], b[:, [1, 3]])
    meet = (low <= high).all(axis=1)
    strictly = lambda p, q: ((q[:, [0, 2]] < p[:, [0, 2]]) & (p[:, [1, 3]] < q[:, [1, 3]])).all(axis=1)  # noqa: E731  a point inside a rectangle
    inside = np.where(flat_a & flat_b, meet, np.where(flat_a, strictly(a, b), np.where(flat_b, strictly(b, a), (low < high).all(axis=1))))
    covered = lambda p, q: ((p[:, [0, 2]] <= q[:, [0, 2]]) & (q[:, [1, 3]] <= p[:, [1, 3]])).all(axis=1)  # noqa: E731  q by p
    return {
        "intersects": lambda: meet,
        "disjoint": lambda: ~meet,
        "covers": lambda: covered(a, b),
        "contains": lambda: covered(a, b) & inside,
        "within": lambda: covered(b, a) & inside,
        "touches": lambda: meet & ~inside,
        "crosses": lambda: np.zeros(len(a), bool),
        "overlaps": lambda: inside & ~covered(a, b) & ~covered(b, a),
    }[name]()


def _predicate_udf(f):
    """Points and rectangles, as the bounds of layers are, are compared as arrays; other pairs one by one."""

    @F.arrow_udf(T.BooleanType())
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        (kind_a, box_a), (kind_b, box_b) = _shapes(a), _shapes(b)
        easy = (kind_a != _OTHER) & (kind_b != _OTHER)
        out = np.zeros(len(a), bool)
        out[easy] = _simple(f.__name__, box_a[easy], box_b[easy], kind_a[easy] == _POINT, kind_b[easy] == _POINT)
        there = a.is_valid().to_numpy(zero_copy_only=False) & b.is_valid().to_numpy(zero_copy_only=False)
        known: dict[tuple[bytes, bytes], bool] = {}  # few pairs are many rows where keys repeat
        for i in np.flatnonzero(there & ~easy).tolist():
            pair = a[i].as_py(), b[i].as_py()
            if pair not in known:
                known[pair] = _of_point(f.__name__, *map(from_wkb, pair)) if _POINT in (kind_a[i], kind_b[i]) else f(*map(from_wkb, pair))
            out[i] = known[pair]
        return pa.array(out, pa.bool_(), mask=~there)

    return run


UDF_PREDICATES = {n: _predicate_udf(f) for n, f in PREDICATES.items()}


def _st(name: str):
    def st(a: Column | str, b: Column | str) -> Column:
        return UDF_PREDICATES[name](_col(a), _col(b))

    st.__name__ = f"st_{name}"
    return st


st_intersects, st_contains, st_covers, st_crosses = map(_st, ("intersects", "contains", "covers", "crosses"))
st_disjoint, st_overlaps, st_touches, st_within = map(_st, ("disjoint", "overlaps", "touches", "within"))


def column_intersects(c: Column | str, g: Geometry) -> Column:
    return st_intersects(c, geom_lit(g))


def column_contains(c: Column | str, g: Geometry) -> Column:
    return st_contains(c, geom_lit(g))


def _measure(f, kind: T.DataType, arrow: pa.DataType):
    @F.arrow_udf(kind)
    def run(g: pa.Array) -> pa.Array:
        return pa.array([None if x is None else f(from_wkb(x)) for x in g.to_pylist()], arrow)

    return run


UDF_MEASURES = {
    "st_x": _measure(lambda g: g.points[0][0] if g.kind == "Point" and g.points else None, T.DoubleType(), pa.float64()),
    "st_y": _measure(lambda g: g.points[0][1] if g.kind == "Point" and g.points else None, T.DoubleType(), pa.float64()),
    "st_area": _measure(area, T.DoubleType(), pa.float64()),
    "st_length": _measure(length, T.DoubleType(), pa.float64()),
    "st_centroid": _measure(lambda g: centroid(g).wkb(), T.BinaryType(), pa.binary()),
    "st_envelope": _measure(lambda g: (lambda b: box(b[0], b[2], b[1], b[3]))(g.box()).wkb(), T.BinaryType(), pa.binary()),
    "st_asText": _measure(to_wkt, T.StringType(), pa.string()),
    "st_geometryType": _measure(lambda g: g.kind, T.StringType(), pa.string()),
    "st_numPoints": _measure(lambda g: len(g.coordinates()), T.IntegerType(), pa.int32()),
}


@F.arrow_udf(T.BinaryType())
def UDF_FROM_WKT(t: pa.Array) -> pa.Array:
    return pa.array([None if x is None else from_wkt(x).wkb() for x in t.to_pylist()], pa.binary())


@F.arrow_udf(T.BinaryType())
def UDF_POINT(x: pa.Array, y: pa.Array) -> pa.Array:
    head = np.frombuffer(struct.pack("<BI", 1, 1), np.uint8)
    xy = np.column_stack([v.to_numpy(zero_copy_only=False).astype("<f8") for v in (x, y)])
    raw = np.ascontiguousarray(np.hstack([np.tile(head, (len(x), 1)), xy.view(np.uint8).reshape(len(x), 16)]))
    made = pa.FixedSizeBinaryArray.from_buffers(pa.binary(21), len(x), [None, pa.py_buffer(raw)]).cast(pa.binary())
    return pc.if_else(pc.and_(x.is_valid(), y.is_valid()), made, pa.scalar(None, pa.binary()))


@F.arrow_udf(T.DoubleType())
def UDF_DISTANCE(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([None if x is None or y is None else distance(from_wkb(x), from_wkb(y)) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.float64())


def st_measure(name: str, g: Column | str) -> Column:
    """One of st_x, st_y, st_area, st_length, st_centroid, st_envelope, st_asText, st_geometryType, st_numPoints."""
    return UDF_MEASURES[name](_col(g))


def st_geom_from_wkt(text: Column | str) -> Column:
    return UDF_FROM_WKT(_col(text))


def st_point(x: Column | str, y: Column | str) -> Column:
    return UDF_POINT(_col(x).cast("double"), _col(y).cast("double"))


def st_make_bbox(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    return polygon_of_box(xmin, ymin, xmax, ymax)


def st_distance(a: Column | str, b: Column | str) -> Column:
    return UDF_DISTANCE(_col(a), _col(b))
