"""Scan conversion: which cells of a grid a geometry covers, by whole arrays of edges and rows."""

from __future__ import annotations

import numpy as np

from rasterloom.geometry import Geometry
from rasterloom.operators.metadata import Extent

#: How near to a cell's middle, in cells, a border counts as on it.
NEAR = 1e-9


def covered(g: Geometry, extent: Extent, cols: int, rows: int) -> np.ndarray:
    """(rows, cols): whether a polygon holds the middle of a cell, border included, or a line or point passes the cell.

    Cells' upper and left edges belong to them, as for points. Nothing is covered by an empty geometry.
    """
    w, h = extent.width / cols, extent.height / rows
    out = np.zeros((rows, cols), bool)
    if g.points:
        _mark(out, (np.array(g.points) - [extent.xmin, extent.ymax]) / [w, -h])
    for line in g.lines:
        _pass(out, (np.array(line) - [extent.xmin, extent.ymax]) / [w, -h])
    for rings in g.polygons:
        out |= _filled([(np.array(r) - [extent.xmin, extent.ymax]) / [w, -h] for r in rings], cols, rows)
    return out


def _mark(out: np.ndarray, at: np.ndarray) -> None:
    """Cells that hold points in cell coordinates."""
    c, r = np.floor(at).astype(np.int64).T
    inside = (c >= 0) & (c < out.shape[1]) & (r >= 0) & (r < out.shape[0])
    out[r[inside], c[inside]] = True


def _pass(out: np.ndarray, line: np.ndarray) -> None:
    """Cells that a line passes: between all its crossings with the grid, the middles tell them."""
    for a, b in zip(line, line[1:]):
        d = b - a
        cuts = [0.0, 1.0]
        for k, size in ((0, out.shape[1]), (1, out.shape[0])):
            if d[k]:
                lo, hi = np.clip(np.sort([a[k], b[k]]), 0, size)
                cuts.extend(((np.arange(np.ceil(lo), np.floor(hi) + 1) - a[k]) / d[k]).tolist())
        t = np.unique(np.clip(cuts, 0, 1))
        _mark(out, a + np.concatenate([(t[1:] + t[:-1]) / 2, [0.0, 1.0]])[:, None] * d)


def _filled(rings: list[np.ndarray], cols: int, rows: int) -> np.ndarray:
    """Even-odd filling: a crossing turns all middles to its right over; middles on a border are added."""
    a, b = (np.concatenate([r[k:][: len(r) - 1] for r in rings]) for k in (0, 1))
    ys = np.arange(rows) + 0.5
    (ax, ay), (bx, by) = a.T, b.T
    turn = np.zeros((rows, cols + 1), np.int64)
    edge = np.zeros((rows, cols), bool)
    step = max(1, (1 << 20) // max(1, rows))  # edges at a time
    for k in range(0, len(a), step):
        e = slice(k, k + step)
        spans = (ay[e][None] <= ys[:, None]) != (by[e][None] <= ys[:, None])
        touches = (np.minimum(ay[e], by[e])[None] <= ys[:, None] + NEAR) & (np.maximum(ay[e], by[e])[None] >= ys[:, None] - NEAR)
        r, n = np.nonzero(spans)
        n += k
        x = ax[n] + (ys[r] - ay[n]) * (bx[n] - ax[n]) / (by[n] - ay[n])
        np.add.at(turn, (r, np.clip(np.ceil(x - 0.5), 0, cols).astype(np.int64)), 1)
        r, n = np.nonzero(touches)
        n += k
        flat = np.abs(by[n] - ay[n]) <= NEAR
        for i, m in zip(r[flat], n[flat]):  # along a row of middles
            c0, c1 = np.ceil(min(ax[m], bx[m]) - 0.5 - NEAR), np.floor(max(ax[m], bx[m]) - 0.5 + NEAR)
            edge[i, int(np.clip(c0, 0, cols)) : int(np.clip(c1 + 1, 0, cols))] = True
        r, n = r[~flat], n[~flat]
        x = ax[n] + (ys[r] - ay[n]) * (bx[n] - ax[n]) / (by[n] - ay[n]) - 0.5
        c = np.rint(x).astype(np.int64)
        on = (np.abs(x - c) <= NEAR) & (c >= 0) & (c < cols)
        edge[r[on], c[on]] = True
    return (np.cumsum(turn, axis=1)[:, :cols] % 2 == 1) | edge
