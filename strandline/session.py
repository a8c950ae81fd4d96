"""Session, table access and lineage cuts."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Collection, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the bench use."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.driver.memory": os.environ.get("SPARK_DRIVER_MEMORY", "8g"),
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.master(f"local[{cores}]").appName("strandline")
    spark = builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_PACKAGE = os.path.dirname(os.path.abspath(__file__))
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application; wherever it lies or is installed, they import the same code."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    path = os.path.join(tempfile.gettempdir(), f"strandline-{uuid.uuid4().hex}.zip")  # the driver serves it to the workers
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(_PACKAGE):
            for name in (n for n in names if n.endswith(".py")):
                file = os.path.join(folder, name)
                archive.write(file, os.path.join("strandline", os.path.relpath(file, _PACKAGE)))
    context.addPyFile(path)
    atexit.register(lambda: os.path.exists(path) and os.remove(path))
    _SHIPPED.add(context.applicationId)


def arrow_map(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand on the workers."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


_WRITTEN: dict[str, SparkSession] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else the context's checkpoint folder.

    A local session, whose one process is driver and executor, may go without and gets a folder of
    its own; anywhere else a missing setting is an error, as no other folder is known to be shared.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = os.path.join(tempfile.gettempdir(), f"strandline-{uuid.uuid4().hex}")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession) -> str:
    """A new path in the shared folder, removed like the tables of ``cut``."""
    path = f"{shared_folder(spark)}/strandline-{uuid.uuid4().hex}"
    _WRITTEN[path] = spark
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and go on from there. Runs at once.

    A written table is compressed, its columns are read as needed and its size is known to the
    planner; ``release``, the end of a ``scratch`` block or of the process removes it.
    """
    spark = df.sparkSession
    path = scratch_path(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(keep: Collection[str] = ()) -> None:
    """Remove the tables written by ``cut`` but for ``keep``; results that still read them must not be used any more."""
    for path in [p for p in _WRITTEN if p not in keep]:
        spark = _WRITTEN.pop(path)
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session has ended: the folder's owner cleans up
            continue


atexit.register(release)


@contextmanager
def scratch() -> Iterator[None]:
    """A block at whose end the tables written inside it go, so that a long session doesn't fill the shared folder."""
    before = set(_WRITTEN)
    try:
        yield
    finally:
        release(before)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions of the session: what the cluster's owner thinks fits its cores and data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
