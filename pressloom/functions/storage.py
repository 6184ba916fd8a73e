"""Tables written to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Unset, it is set here where all tasks run in this process; anything else raises."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    path = f"{root}/{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def staged(df: DataFrame, compression: str = "snappy", path: str | None = None) -> DataFrame:
    """df, written once to the shared folder (or to a path in it) and read back: cuts lineage and survives lost executors."""
    path = path or shared_dir(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept(spark: SparkSession, name: str, build: Callable[[str], None]) -> dict[str, DataFrame]:
    """Tables that are built once and kept in the shared folder under a name that says what they were built from.

    build(folder) writes each table to a folder of its own there. That is done beside the name, and moved there whole.
    clear_staged() leaves what is kept.
    """
    beside = shared_dir(spark)
    hadoop = spark._jvm.org.apache.hadoop.fs
    place = hadoop.Path(f"{beside.rsplit('/', 1)[0]}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        build(beside)
        if not files.rename(hadoop.Path(beside), place):
            raise OSError(f"cannot move {beside} to {place}")
    return {part.getPath().getName(): spark.read.parquet(part.getPath().toString()) for part in files.listStatus(place)}


def clear_staged(spark: SparkSession) -> int:
    """Removes the folders that this session has written so far; call it when their results have been saved. Number of folders."""
    paths, hadoop = list(_MADE), spark._jvm.org.apache.hadoop.fs
    for path in paths:
        place = hadoop.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
        _MADE.remove(path)
    return len(paths)
