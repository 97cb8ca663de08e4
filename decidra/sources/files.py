"""Small files and folders on any filesystem that Spark knows, and a shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _at(spark: SparkSession, path: str):
    """The Hadoop path and its filesystem."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _at(spark, path)
    return bool(fs.exists(where))


def listed(spark: SparkSession, path: str) -> list[str]:
    """Paths of the files and folders below a folder, sorted; the path itself if it is a file."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return []
    if fs.getFileStatus(where).isFile():
        return [path]
    return sorted(str(s.getPath().toString()) for s in fs.listStatus(where))


def size(spark: SparkSession, path: str) -> int:
    where, fs = _at(spark, path)
    return int(fs.getContentSummary(where).getLength()) if fs.exists(where) else 0


def free(spark: SparkSession, path: str) -> int:
    where, fs = _at(spark, path)
    while not fs.exists(where) and where.getParent() is not None:
        where = where.getParent()
    return int(fs.getStatus(where).getRemaining())


def read_text(spark: SparkSession, path: str) -> str | None:
    """The text of a small file; null if there is none."""
    where, fs = _at(spark, path)
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file that appears whole: written beside its place, then renamed."""
    part = f"{path}.{uuid.uuid4().hex}.part"
    where, fs = _at(spark, part)
    stream = fs.create(where, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    move(spark, part, path)


def move(spark: SparkSession, old: str, new: str) -> None:
    """Rename, in place of what lies at new."""
    where, fs = _at(spark, old)
    target, _ = _at(spark, new)
    if fs.exists(target):
        fs.delete(target, True)
    if not fs.rename(where, target):
        raise OSError(f"{old} could not be renamed to {new}")


def drop(spark: SparkSession, path: str) -> None:
    where, fs = _at(spark, path)
    fs.delete(where, True)


def work_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the checkpoint folder that all executors share. Only a local session without one
    gets a folder of its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="decidra-"))
    return f"{sc.getCheckpointDir()}/{what}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame) -> DataFrame:
    """The rows of df, kept in the shared folder: used twice they are computed once, and a lost executor can't take them."""
    work_dir(df.sparkSession, "x")
    return df.checkpoint(eager=True)
