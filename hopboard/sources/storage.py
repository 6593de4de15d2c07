"""Small calls to the file system behind a path, through the Hadoop API Spark itself uses."""

from __future__ import annotations

import tempfile
import time
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession


def matching_paths(spark: SparkSession, pattern: str) -> list[str]:
    path, file_system = _resolve(spark, pattern)
    return sorted(status.getPath().toString() for status in file_system.globStatus(path) or [])


def delete_tree(spark: SparkSession, location: str) -> None:
    path, file_system = _resolve(spark, location)
    file_system.delete(path, True)


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame written to a new place in the shared folder and read back, so that it is worked out once.

    The files are inputs of what the caller makes of it and stay until the shared folder is cleared.
    """
    return written_at(frame, name)[1]


def written_at(frame: DataFrame, name: str) -> tuple[str, DataFrame]:
    """The same with the path, for a caller who deletes the files when done with the frame."""
    path = f"{shared_folder(frame.sparkSession)}/{name}-{uuid4().hex}"
    frame.write.parquet(path)
    return path, frame.sparkSession.read.schema(frame.schema).parquet(path)


def create_marker(spark: SparkSession, location: str) -> None:
    """An empty file; fails where there is one."""
    path, file_system = _resolve(spark, location)
    file_system.create(path, False).close()


def age_seconds(spark: SparkSession, location: str) -> float:
    path, file_system = _resolve(spark, location)
    return time.time() - file_system.getFileStatus(path).getModificationTime() / 1000


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; a temporary one only where Spark runs in one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    return tempfile.mkdtemp(prefix="hopboard-")


def _resolve(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())
