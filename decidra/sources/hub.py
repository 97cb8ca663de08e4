"""Datasets laid out as on a hub: ``root/dataset[/revision]/[config/]split`` with Parquet, JSON lines or CSV files."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.sources import files

READERS = {"parquet": "parquet", "json": "json", "jsonl": "json", "csv": "csv"}


def load_rows(spark: SparkSession, root: str, dataset: str, split: str, config: str | None = None, revision: str | None = None, schema: str | None = None) -> DataFrame:
    """The rows of one split. A split is a folder of that name, or files named ``split`` or ``split-...``; all its
    files have one format. Without a schema Parquet's own is used, and text formats are inferred."""
    folder = "/".join(x for x in (root.rstrip("/"), dataset, revision, config) if x)
    found = files.listed(spark, folder)
    inside = [p for p in found if posixpath.basename(p) == split]
    if len(inside) == 1 and not posixpath.splitext(inside[0])[1]:
        found = files.listed(spark, inside[0])
    else:
        found = [p for p in found if re.match(rf"{re.escape(split)}([-.].*)?$", posixpath.basename(p))]
    kinds = {p: posixpath.splitext(p.removesuffix(".gz"))[1][1:] for p in found}
    data = sorted(p for p, k in kinds.items() if k in READERS)
    if not data:
        raise FileNotFoundError(f"no split {split!r} in {folder}")
    used = {READERS[kinds[p]] for p in data}
    if len(used) > 1:
        raise ValueError(f"split {split!r} mixes formats: {sorted(used)}")
    reader = spark.read.format(used.pop())
    if reader and data[0].removesuffix(".gz").endswith("csv"):
        reader = reader.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).load(data)


def load_configs(spark: SparkSession, root: str, dataset: str, split: str, revision: str | None = None, schema: str | None = None) -> DataFrame:
    """The Parquet rows of one split of every config of a dataset, with a column config, by one read of all their
    folders. Folders may be named by their value alone or as partitions are (config=value). Configs without the split are left
    out; none with it is an error."""
    folder = "/".join(x for x in (root.rstrip("/"), dataset, revision) if x)
    value = lambda path: posixpath.basename(path).rpartition("=")[2]
    found = [inside for config in files.listed(spark, folder) for inside in files.listed(spark, config) if value(inside) == split and inside != config]
    if not found:
        raise FileNotFoundError(f"no split {split!r} below {folder}")
    reader = spark.read.schema(schema) if schema else spark.read
    config = F.substring_index(F.element_at(F.split("_metadata.file_path", "/"), -3), "=", -1)
    return reader.parquet(*found).withColumn("config", F.url_decode(config))
