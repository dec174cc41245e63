"""Where intermediate tables go, and how the package reaches the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
_PACKAGE = os.path.basename(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share (``spark.checkpoint.dir``).

    Only a local session, whose executors are threads of one machine, may do without that
    setting; it gets a temporary folder. Elsewhere an unset folder is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{uuid.uuid4().hex}/{name}"
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return os.path.join(tempfile.mkdtemp(prefix=f"{_PACKAGE}-"), name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package even where the driver's path is not theirs."""
    visible = [os.path.abspath(p or ".") for p in os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if _ROOT in [*visible, os.getcwd()] or getattr(spark.sparkContext, "_shipped_package", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix=f"{_PACKAGE}-"), f"{_PACKAGE}.zip")
    with zipfile.ZipFile(archive, "w") as target:
        for folder, _, files in os.walk(os.path.join(_ROOT, _PACKAGE)):
            for file in files:
                if file.endswith(".py"):
                    full = os.path.join(folder, file)
                    target.write(full, os.path.relpath(full, _ROOT))
    spark.sparkContext.addPyFile(archive)
    spark.sparkContext._shipped_package = True
