"""Reading given tables, and scratch tables in the shared folder."""

from __future__ import annotations

import contextlib
import uuid
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the run that is under way, if any.
_FOLDER: ContextVar[str | None] = ContextVar("folder", default=None)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = _path(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames a folder; false where there is none."""
    fs, p = _path(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    if not fs.exists(p):
        return False
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}")
    return True


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; where it is unset, below the warehouse, which on a cluster must not be a local folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and base.startswith(("file:", "/")):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return base + "/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path: in the folder of the run under way, else in the session's, which is removed when the session's JVM ends."""
    folder = _FOLDER.get()
    if folder is None:
        folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}"
        fs, p = _path(spark, folder)
        fs.mkdirs(p)
        fs.deleteOnExit(p)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession, name: str):
    """What is written to scratch paths within is removed at the end, also after a failure; so nothing lazy may leave it."""
    folder = scratch(spark, name)
    token = _FOLDER.set(folder)
    try:
        yield folder
    finally:
        _FOLDER.reset(token)
        remove(spark, folder)


def materialise(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write once, read back: cuts the lineage and survives the loss of an executor."""
    spark = df.sparkSession
    path = path or scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Removes tables that materialise wrote and that nothing reads any more."""
    for df in tables:
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            remove(df.sparkSession, folder)
