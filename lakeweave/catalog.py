"""Names to tables: registered frames, then Spark's catalog; and CREATE TABLE AS by a staged swap."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .errors import QueryError


class Catalog:
    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.spark, self.frames, self.files, self.folder = spark, {}, {}, None
        if folder:
            self.add_folder(folder)

    def add(self, name: str, frame: DataFrame) -> None:
        self.frames[name] = frame

    def add_folder(self, folder: str) -> None:
        """Every <name>.parquet in a folder is a table, read when a query names it."""
        self.folder = folder.rstrip("/")
        if os.path.isdir(folder):  # other stores are asked for a name when it is used
            self.files |= {x.removesuffix(".parquet"): f"{self.folder}/{x}" for x in os.listdir(folder) if x.endswith(".parquet")}

    def find(self, parts: tuple[str, ...]) -> DataFrame:
        if len(parts) == 1 and parts[0] in self.files and parts[0] not in self.frames:
            self.frames[parts[0]] = self.spark.read.parquet(self.files[parts[0]])
        if len(parts) == 1 and parts[0] in self.frames:
            return self.frames[parts[0]]
        name = ".".join(f"`{p}`" for p in parts[-2:])
        if self.spark.catalog.tableExists(name.replace("`", "")):
            return self.spark.table(name)
        if len(parts) > 1 and parts[-1] in self.frames:
            return self.frames[parts[-1]]
        if len(parts) == 1 and self.folder and not self.files:
            try:
                return self.spark.read.parquet(f"{self.folder}/{parts[0]}.parquet")
            except AnalysisException:  # no such path
                pass
        raise QueryError(f"Table `{'.'.join(parts)}` does not exist")

    def create(self, parts: tuple[str, ...], frame: DataFrame) -> None:
        """Write beside the old table and swap, so that a query may read the table it replaces."""
        if len(parts) == 1:  # the new table takes the name
            self.frames.pop(parts[0], None)
            self.files.pop(parts[0], None)
        where = f"`{parts[-2]}`." if len(parts) > 1 else ""
        if where:
            self.spark.sql(f"create database if not exists `{parts[-2]}`")
        staging = f"{where}`{parts[-1]}__{uuid.uuid4().hex}`"
        frame.write.saveAsTable(staging)
        name, old = f"{where}`{parts[-1]}`", f"{where}`{parts[-1]}__{uuid.uuid4().hex}`"
        there = self.spark.catalog.tableExists(name.replace("`", ""))
        if there:  # set aside, and dropped only when the new table has the name
            self.spark.sql(f"alter table {name} rename to {old}")
        try:
            self.spark.sql(f"alter table {staging} rename to {name}")
        except Exception:
            if there:
                self.spark.sql(f"alter table {old} rename to {name}")
            raise
        if there:
            self.spark.sql(f"drop table {old}")
