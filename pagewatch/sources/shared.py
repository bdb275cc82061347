"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def new_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir. Only where none is set, and only on a local master, a temporary one takes its place."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/pagewatch-{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="spark-pagewatch-")


def _system(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, system = _system(spark, path)
    return system.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders right under path, in order; none where it isn't there."""
    at, system = _system(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(at) if x.isDirectory()) if system.exists(at) else []


def delete(spark: SparkSession, path: str) -> None:
    at, system = _system(spark, path)
    system.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, there in whole or not at all: written beside, then renamed over."""
    at, system = _system(spark, path)
    beside = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(at):
        system.delete(at, False)
    if not system.rename(beside, at):
        raise OSError(f"{path} couldn't be written")


def read_text(spark: SparkSession, path: str) -> str | None:
    """What write_text has written there, or None."""
    at, system = _system(spark, path)
    if not system.exists(at):
        return None
    stream = system.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()
