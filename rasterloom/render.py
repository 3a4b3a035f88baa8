"""Colour composites, ramps and PNG files."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from rasterloom.tile import Tile


@dataclass(frozen=True)
class Profile:
    """How three bands become colours: which ones, how their range is compressed, and corrections.

    The contrast factor is a whole number, as published for these profiles, so small contrasts change nothing.
    """

    brightness: int = 0
    contrast: int = 0
    gamma: float = 1.0
    bands: tuple[int, int, int] = (0, 1, 2)
    clamp: tuple[float, float] | None = None
    rescale: bool = False

    def compress(self, x: np.ndarray) -> np.ndarray:
        """Values in the range 0 to 255 (NaN stays)."""
        if self.clamp is not None:
            low, high = self.clamp
            return (np.clip(x, low, high) - low) / (high - low) * 255
        if self.rescale and not np.isnan(x).all():
            low, high = np.nanmin(x), np.nanmax(x)
            return (x - low) / (high - low) * 255 if high > low else np.zeros_like(x)
        return x

    def adjust(self, x: np.ndarray) -> np.ndarray:
        """Whole numbers from 0 to 255 after all corrections; NaN stays."""
        data = ~np.isnan(x)
        v = np.trunc(np.where(data, x, 0))
        v = np.clip(np.where(v > 0, v + self.brightness, v), 0, 255)
        v = np.clip(np.trunc(255 * (v / 255) ** (1 / self.gamma)), 0, 255)
        factor = int(259 * (self.contrast + 255) / (255 * (259 - self.contrast)))
        v = np.clip(factor * (v - 128) + 128, 0, 255)
        return np.where(data, v, np.nan)

    def apply(self, t: Tile) -> np.ndarray:
        return self.adjust(self.compress(t.doubles()))


# Corrections of the published profiles.
DEFAULT = Profile()
LANDSAT8_NATURAL_COLOR = Profile(brightness=15, contrast=30, gamma=0.8, clamp=(4000, 15176))
NAIP_NATURAL_COLOR = Profile(gamma=1.4, rescale=True)


def png(rgba: np.ndarray) -> bytes:
    """A PNG file of (rows, cols, 3 or 4) bytes."""
    rows, cols, channels = rgba.shape
    lines = np.hstack([np.zeros((rows, 1), np.uint8), rgba.astype(np.uint8).reshape(rows, -1)])

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", cols, rows, 8, 6 if channels == 4 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), 6)) + chunk(b"IEND", b"")


def pixels(file: bytes) -> np.ndarray:
    """(rows, cols, channels) of a file that :func:`png` wrote."""
    at, parts = 8, {}
    while at < len(file):
        size, name = struct.unpack(">I4s", file[at : at + 8])
        parts[name] = file[at + 8 : at + 8 + size]
        at += size + 12
    cols, rows, _, kind, *_ = struct.unpack(">IIBBBBB", parts[b"IHDR"])
    channels = 4 if kind == 6 else 3
    return np.frombuffer(zlib.decompress(parts[b"IDAT"]), np.uint8).reshape(rows, cols * channels + 1)[:, 1:].reshape(rows, cols, channels)


def _with_alpha(channels: list[np.ndarray]) -> np.ndarray:
    missing = np.any([np.isnan(c) for c in channels], axis=0)
    colours = [np.where(np.isnan(c), 0, c) for c in channels]
    return np.dstack([*colours, np.where(missing, 0, 255)]).astype(np.uint8)


def rgb_composite(tiles: list[Tile], profile: Profile = DEFAULT) -> bytes:
    """PNG of three bands; cells without data in any of them are transparent."""
    return png(_with_alpha([profile.apply(tiles[b]) for b in profile.bands]))


#: Dark blue over green to yellow, by position.
RAMP = np.array([(68, 1, 84), (59, 82, 139), (33, 145, 140), (94, 201, 98), (253, 231, 37)], float)


def ramp_png(x: np.ndarray, low: float, high: float) -> bytes:
    """PNG of doubles on a colour ramp between two values."""
    t = np.clip((x - low) / (high - low) if high > low else np.zeros_like(x), 0, 1) * (len(RAMP) - 1)
    at = np.clip(np.nan_to_num(t).astype(int), 0, len(RAMP) - 2)
    f = (t - at)[..., None]
    colours = RAMP[at] * (1 - f) + RAMP[at + 1] * f
    return png(_with_alpha([np.where(np.isnan(x), np.nan, colours[..., k]) for k in range(3)]))
