"""Where jobs keep what later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all run on this
    machine (tests). On a cluster each machine would write to its own disk, so an unset folder is an error there."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="scorespark-"))
    return _own[0]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df written as Parquet into the shared folder and read back, so that all later readers see the same rows in the same
    places, whatever is planned anew or lost meanwhile."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, system = _file_system(spark, path)
    return system.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, system = _file_system(spark, path)
    system.delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    p, system = _file_system(spark, old)
    if not system.rename(p, _file_system(spark, new)[0]):
        raise OSError(f"{old} cannot be moved to {new}")


def numbered_folders(spark: SparkSession, path: str, name: str) -> list[int]:
    """The numbers n of the folders name=n in path, in order."""
    p, system = _file_system(spark, path)
    found = [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []
    return sorted(int(f.removeprefix(f"{name}=")) for f in found if f.startswith(f"{name}="))
