"""Staged runs: every stage writes a table, and a stage whose table is complete is not run again."""

from __future__ import annotations

import json
import posixpath
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from decidra.sources import files

CONFIG = "_CONFIG"


@dataclass(frozen=True)
class Stage:
    """make gets the tables of the stages before it by name. config is part of the stage's identity."""

    name: str
    make: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]
    config: dict[str, Any] = field(default_factory=dict)

    def identity(self) -> str:
        return json.dumps(self.config, sort_keys=True)


class Tables:
    """Stage outputs below a folder of any filesystem that Spark knows."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def done(self, stage: Stage) -> bool:
        """Whether the stage's table is complete and was made with this config."""
        at = self.path(stage.name)
        return files.exists(self.spark, f"{at}/_SUCCESS") and files.read_text(self.spark, f"{at}/{CONFIG}") == stage.identity()

    def put(self, stage: Stage, df: DataFrame) -> None:
        """The config is written last: a table without it counts as not made."""
        at = self.path(stage.name)
        df.write.mode("overwrite").parquet(at)
        files.write_text(self.spark, f"{at}/{CONFIG}", stage.identity())


def run(spark: SparkSession, stages: list[Stage], root: str, again: bool = False) -> dict[str, DataFrame]:
    """Run the stages in order; a stage that is done with the same config is read instead, unless again is set or a
    stage before it was made anew."""
    names = [s.name for s in stages]
    if len(set(names)) < len(names):
        raise ValueError("two stages have the same name")
    tables, at = Tables(spark, root), {}
    for stage in stages:
        if again or not tables.done(stage):
            tables.put(stage, stage.make(spark, dict(at)))
            again = True
        at[stage.name] = spark.read.parquet(tables.path(stage.name))
    return at


def manifest(spark: SparkSession, stages: list[Stage], root: str) -> DataFrame:
    """stage, place, done and rows of every stage."""
    tables = Tables(spark, root)
    rows = []
    for i, s in enumerate(stages):
        done = tables.done(s)
        rows.append((s.name, i, done, spark.read.parquet(tables.path(s.name)).count() if done else None, s.identity()))
    return spark.createDataFrame(rows, "stage string, place int, done boolean, rows long, config string")


def release(spark: SparkSession, folder: str, tables: dict[str, DataFrame], card: str, metadata: dict[str, Any]) -> list[str]:
    """A release folder: each table split by config and split, a card and a metadata file. All is written beside its
    place, on any filesystem that Spark knows, and the folder appears whole by a rename."""
    staging = f"{folder.rstrip('/')}.staging"
    files.drop(spark, staging)
    for name, df in tables.items():
        parts = [c for c in ("config", "split") if c in df.columns]
        writer = df.write.partitionBy(*parts) if parts else df.write
        writer.parquet(f"{staging}/{name}")
    files.write_text(spark, f"{staging}/README.md", card)
    files.write_text(spark, f"{staging}/metadata.json", json.dumps(metadata, indent=2, sort_keys=True))
    files.move(spark, staging, folder)
    return sorted(posixpath.basename(p) for p in files.listed(spark, folder) if not p.endswith(".crc"))


class NoRoom(OSError):
    """The filesystem has not enough room for a checkpoint."""


def save_checkpoint(df: DataFrame, path: str, room: float = 1.2, least: float = 0.5) -> None:
    """df at path, in place of an older checkpoint there: written beside it and renamed. It is refused if less room is
    free than room times the older one's size, or if it comes out smaller than least times that size."""
    spark, part = df.sparkSession, f"{path.rstrip('/')}.part"
    before = files.size(spark, path)
    if files.free(spark, path) < room * before:
        raise NoRoom(f"{path}: less than {room} times the last checkpoint's size is free")
    files.drop(spark, part)
    df.write.parquet(part)
    if files.size(spark, part) < least * before:
        files.drop(spark, part)
        raise ValueError(f"{path}: the new checkpoint has less than {least} times the size of the last one")
    files.move(spark, part, path)


def cell(value: float | None, digits: int = 3) -> str:
    return "-" if value is None or value != value else f"{value:.{digits}f}"


def markdown(rows: list[dict[str, Any]], columns: list[str]) -> str:
    """A Markdown table; missing values and NaN are shown as a dash."""
    shown = lambda v: cell(v) if isinstance(v, float) or v is None else str(v)
    out = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(out + ["| " + " | ".join(shown(r.get(c)) for c in columns) + " |" for r in rows])
