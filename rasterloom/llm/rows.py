"""Telling rows apart where ids may repeat or be null, without touching the columns that a table has."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Rows whose texts a worker holds as Python objects at once.
ROWS = 512


def pieces(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, so that no worker holds more than these as Python objects; memory of the last ones goes back."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)
            pa.default_memory_pool().release_unused()


def unused(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that the table does not have, in whatever case."""
    own = {c.lower() for c in df.columns}
    while name.lower() in own:
        name += "_"
    return name


KEY_TYPE = "struct<a:bigint,b:bigint>"


def row_key(df: DataFrame, *columns: str) -> Column:
    """128 bits of hashes over some columns and over which of them are null; rows that agree in them are the same row to whatever uses the key."""
    parts = [x for c in columns for x in (df[c], df[c].isNull())]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def without(docs: DataFrame, bad: DataFrame, *columns: str) -> DataFrame:
    """Rows of ``docs`` whose key over ``columns`` is not in ``bad`` (one column)."""
    name = unused(docs, "_key")
    other = bad.toDF("_bad")
    return docs.withColumn(name, row_key(docs, *columns)).join(other, F.col(name) == F.col("_bad"), "left_anti").select(*docs.columns)
