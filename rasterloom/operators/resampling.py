"""Resampling of cells."""

from __future__ import annotations

import numpy as np

NEAREST, BILINEAR = "nearest", "bilinear"


def sample(cells: np.ndarray, x: np.ndarray, y: np.ndarray, method: str = NEAREST) -> np.ndarray:
    """Values of doubles (rows, cols) at cell coordinates (0.5 is the middle of the first cell); NaN outside.

    Bilinear weights leave NoData neighbours out.
    """
    rows, cols = cells.shape
    outside = (x < 0) | (y < 0) | (x >= cols) | (y >= rows)
    if method == NEAREST:
        out = cells[np.clip(np.floor(y).astype(int), 0, rows - 1), np.clip(np.floor(x).astype(int), 0, cols - 1)]
        return np.where(outside, np.nan, out)
    fx, fy = x - 0.5, y - 0.5
    x0, y0 = np.floor(fx).astype(int), np.floor(fy).astype(int)
    total, weight = np.zeros(x.shape), np.zeros(x.shape)
    for dx in (0, 1):
        for dy in (0, 1):
            v = cells[np.clip(y0 + dy, 0, rows - 1), np.clip(x0 + dx, 0, cols - 1)]
            w = np.abs(1 - dx - (fx - x0)) * np.abs(1 - dy - (fy - y0)) * ~np.isnan(v)
            total += np.where(np.isnan(v), 0, v) * w
            weight += w
    with np.errstate(all="ignore"):
        return np.where(outside | (weight == 0), np.nan, total / weight)


def resample(cells: np.ndarray, cols: int, rows: int, method: str = NEAREST) -> np.ndarray:
    """Doubles at another size."""
    x = (np.arange(cols) + 0.5) * cells.shape[1] / cols
    y = (np.arange(rows) + 0.5) * cells.shape[0] / rows
    return sample(cells, *np.meshgrid(x, y), method)
