"""Session settings and the shared folder for checkpoints and written stages."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "trustloom", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here is tested under.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster both
    come from the submit command and AQE coalesces the shuffle partitions.
    """
    builder = (SparkSession.builder.appName(app)
               .config("spark.sql.session.timeZone", "UTC")
               .config("spark.sql.adaptive.enabled", "true")
               .config("spark.sql.adaptive.skewJoin.enabled", "true")
               .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        builder = (builder.master(master)
                   .config("spark.ui.enabled", "false")
                   .config("spark.driver.memory", "8g"))
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_shipped_to: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, for functions that are pickled by name."""
    context = spark.sparkContext
    if context.applicationId in _shipped_to:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, files in os.walk(root):
            for name in sorted(files):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(root)))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="trustloom-"))  # the driver serves the file from there
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "trustloom.zip")
    with open(path, "wb") as out:
        out.write(packed.getvalue())
    context.addPyFile(path)
    _shipped_to.add(context.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a local session may leave it unset; then a temporary one is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="trustloom-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below the cluster's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder below the shared folder that nothing reads any more."""
    if not path.startswith(ensure_checkpoint_dir(spark).rstrip("/") + "/"):
        raise ValueError(f"not below the shared folder: {path}")
    remove_folder(spark, path)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder of any store that Spark reads; none if it does not exist."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in files.listStatus(place) if s.isDirectory()] if files.exists(place) else []


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that the caller wrote."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether a path of any store that Spark reads is a folder."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place).isDirectory()


_recorders: list[list[str]] = []


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The folders of the tables that are staged meanwhile, oldest first."""
    tables: list[str] = []
    _recorders.append(tables)
    try:
        yield tables
    finally:
        _recorders[:] = [x for x in _recorders if x is not tables]


def staged(df: DataFrame, purpose: str, *partition_by: str) -> DataFrame:
    """The rows written once to the shared folder and read back: cuts lineage and survives
    the loss of executors. Partition columns are pruned when filtered."""
    path = shared_dir(df.sparkSession, purpose)
    for tables in _recorders:
        tables.append(path)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
