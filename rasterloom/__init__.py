"""Raster tiles as ordinary Spark columns: statistics, map algebra, layers, sources and export."""

__version__ = "0.1.0"
