"""Session helpers shared by every part of the package."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that kernels pickled by reference import there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="rasterloom-")
    target = os.path.join(folder, "rasterloom_pkg.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def _folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints; one of our own only on one machine, and only where neither session nor context has one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="rasterloom-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder that ``spark.checkpoint.dir`` names."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it again (columnar, so later reads can prune)."""
    path = shared_folder(df.sparkSession, "staged")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """Path of a new folder, that all executors reach, under the one that ``spark.checkpoint.dir`` names."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
