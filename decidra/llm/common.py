"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, what: str) -> str:
    """A new folder name below the session's checkpoint folder, which all executors share.

    Only a local session without ``spark.checkpoint.dir`` (tests) gets a folder of its own; on a cluster a
    session without one is an error, since executors could not see each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        given = spark.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="decidra-"))
    return f"{sc.getCheckpointDir()}/{what}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, written to the shared folder: lineage ends there and lost executors can't take it."""
    shared_dir(df.sparkSession, "x")
    return df.checkpoint(eager=True)


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character kept (``lower`` would fold other scripts too)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ASCII_UPPER, ASCII_UPPER.lower()))


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def packed(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, and all columns of docs inside a struct _row, where no name can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *columns)


def free_name(docs: DataFrame, name: str) -> str:
    """name, with underscores behind it while docs has a column of that name."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("_row.*")


def release_memory() -> None:
    """Hand freed memory back to the system: a worker that is used again for another stage keeps it otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        return  # another C library
