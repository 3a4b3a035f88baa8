"""Tiles to cells: one row for each cell, with its column, its row and one double for each tile."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterloom.functions.scalar import UDF_TO_ARRAY, _col


def _zipped(tiles: list[Column], names: list[str]) -> tuple[Column, Column]:
    """An array of structs of the tiles' cells, and the number of columns; null where all tiles are null."""
    width = F.coalesce(*[t["cols"] for t in tiles]).cast("int")
    height = F.coalesce(*[t["rows"] for t in tiles]).cast("int")
    if len(tiles) == 1:
        cells = F.transform(UDF_TO_ARRAY["double"](tiles[0]), lambda x: F.struct(x.alias(names[0])))
        return cells, width
    same = F.lit(True)
    for t in tiles:
        same = same & F.coalesce((t["cols"] == width) & (t["rows"] == height), F.lit(True))
    missing = F.array_repeat(F.lit(float("nan")), width * height)
    arrays = [F.coalesce(UDF_TO_ARRAY["double"](t), missing).alias(n) for t, n in zip(tiles, names)]
    wrong = F.raise_error(F.lit("tiles of a row have different sizes"))
    zipped = F.arrays_zip(*arrays)
    fields = F.transform(zipped, lambda x: F.struct(*[x[n].alias(n) for n in names]))
    return F.when(width.isNotNull(), F.when(same, fields).otherwise(wrong)), width


def explode_tiles(df: DataFrame, *tiles: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` (all other columns by default), ``column_index, row_index`` and a double column for each tile.

    NoData cells are NaN, as are the cells of a null tile next to others; a row without any tile gives none.
    """
    rest = [c for c in df.columns if c not in tiles] if keep is None else keep
    if len(tiles) == 1:
        # one array of doubles is exploded as it is
        held = df.select(*rest, F.col(tiles[0])["cols"].cast("int").alias("_width"), UDF_TO_ARRAY["double"](_col(tiles[0])).alias("_cells"))
        rows = held.select(*rest, "_width", F.posexplode("_cells").alias("_at", tiles[0]))
        return rows.select(*rest, (F.col("_at") % F.col("_width")).alias("column_index"), F.expr("cast(_at div _width as int)").alias("row_index"), tiles[0])
    cells, width = _zipped([_col(t) for t in tiles], list(tiles))
    held = df.select(*rest, width.alias("_width"), cells.alias("_cells"))
    rows = held.select(*rest, "_width", F.posexplode("_cells").alias("_at", "_cell"))
    return rows.select(*rest, (F.col("_at") % F.col("_width")).alias("column_index"), F.expr("cast(_at div _width as int)").alias("row_index"), *[F.col("_cell")[t].alias(t) for t in tiles])


def explode_tile_sample(df: DataFrame, fraction: float, *tiles: str, keep: list[str] | None = None, seed: int | None = None) -> DataFrame:
    """As :func:`explode_tiles`, with a share of ``fraction`` of each row's cells (rounded up), drawn jointly for all tiles."""
    if not 0 < fraction <= 1:
        raise ValueError("the fraction of cells is over 0 and at most 1")
    rest = [c for c in df.columns if c not in tiles] if keep is None else keep
    cells, width = _zipped([_col(t) for t in tiles], list(tiles))
    placed = F.transform(cells, lambda x, i: F.struct(i.alias("_at"), x.alias("_cell")))
    held = df.select(*rest, width.alias("_width"), (F.shuffle(placed) if seed is None else F.shuffle(placed, seed)).alias("_cells"))
    drawn = F.slice("_cells", 1, F.ceil(F.size("_cells") * F.lit(fraction)).cast("int"))
    rows = held.where(F.col("_cells").isNotNull()).select(*rest, "_width", F.inline(drawn))
    return rows.select(*rest, (F.col("_at") % F.col("_width")).alias("column_index"), F.expr("cast(_at div _width as int)").alias("row_index"), *[F.col("_cell")[t].alias(t) for t in tiles])


def explode_in_sql(*tiles: Column) -> Column:
    """For the SQL function: an array of (column_index, row_index, cell...) to be given to ``inline``."""
    names = ["cell"] if len(tiles) == 1 else [f"cell_{i}" for i in range(len(tiles))]
    cells, width = _zipped(list(tiles), names)
    return F.transform(cells, lambda x, i: F.struct((i % width).alias("column_index"), (i / width).cast("int").alias("row_index"), *[x[n].alias(n) for n in names]))
