"""Stages for machine learning pipelines over layers."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from rasterloom.functions.explode import explode_tiles
from rasterloom.operators.layer import tile_columns


class TileExploder(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """All tile columns to cells, one row for each; other columns are carried along."""

    def _transform(self, df: DataFrame) -> DataFrame:
        return explode_tiles(df, *tile_columns(df))


class NoDataFilter(Transformer, HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Drops rows with null or NaN in any of those input columns that are there."""

    inputCols = Param(Params._dummy(), "inputCols", "columns that must have data", typeConverter=TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, inputCols: list[str] | None = None) -> None:
        super().__init__()
        self._setDefault(inputCols=["tile"])
        self._set(**self._input_kwargs)

    def setInputCols(self, value: list[str]) -> NoDataFilter:
        return self._set(inputCols=value)

    def _transform(self, df: DataFrame) -> DataFrame:
        own = [c for c in self.getInputCols() if c in df.columns]
        return df.dropna(subset=own) if own else df
