"""Named datasets: where they are, and how they are read and written."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class DatasetSpec:
    """A table of files in ``format``, or with format ``tracking`` a JSON document.

    ``schema`` spares the pass that infers one.  ``partition_by`` lays the table
    out in folders, and with mode overwrite only the folders that a write has are
    replaced.
    """

    format: str
    path: str
    read_options: Mapping[str, Any] = field(default_factory=dict)
    mode: str = "overwrite"
    partition_by: tuple[str, ...] = ()
    write_options: Mapping[str, Any] = field(default_factory=dict)
    schema: StructType | str | None = None

    @classmethod
    def from_dict(cls, given: Mapping[str, Any]) -> DatasetSpec:
        """From its fields, or from an entry with filepath, type, file_format, load_args and save_args."""
        if "filepath" in given:
            save = dict(given.get("save_args") or {})
            by = save.pop("partitionBy", None) or save.pop("partition_by", None) or ()
            kind = given.get("file_format") or given["type"].rpartition(".")[2].lower().removesuffix("dataset")
            tracking = given["type"].startswith("tracking.")
            return cls("tracking" if tracking else kind, given["filepath"], given.get("load_args") or {}, save.pop("mode", "overwrite"), (by,) if isinstance(by, str) else tuple(by), {} if tracking else save)
        by = given.get("partition_by") or ()
        return cls(given["format"], given["path"], given.get("read_options") or {}, given.get("mode", "overwrite"), (by,) if isinstance(by, str) else tuple(by), given.get("write_options") or {}, given.get("schema"))

    def read(self, spark: SparkSession) -> DataFrame:
        reader = spark.read.format(self.format).options(**self.read_options)
        return (reader.schema(self.schema) if self.schema else reader).load(self.path)

    def write(self, df: DataFrame) -> None:
        if self.partition_by:
            # One writer for each folder, not one in each task; a folder too large for one is split by the adaptive planner.
            df = df.hint("rebalance", *self.partition_by)
        writer = df.write.format(self.format).mode(self.mode).options(**self.write_options)
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by).option("partitionOverwriteMode", "dynamic")
        writer.save(self.path)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, by the file system that Spark has for ``path``."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())


class Catalog:
    """Datasets by name.  A name without an entry is held in memory as it is: a lazy plan stays one."""

    def __init__(self, spark: SparkSession, entries: Mapping[str, DatasetSpec | Mapping[str, Any]] | None = None, root: str = ""):
        self.spark, self.root = spark, root.rstrip("/")
        self.entries = {name: x if isinstance(x, DatasetSpec) else DatasetSpec.from_dict(x) for name, x in (entries or {}).items()}
        self.memory: dict[str, Any] = {}

    def _at(self, name: str) -> DatasetSpec:
        spec = self.entries[name]
        rooted = self.root and not spec.path.startswith("/") and "://" not in spec.path
        return replace(spec, path=f"{self.root}/{spec.path}") if rooted else spec

    def list(self) -> list[str]:
        return sorted({*self.entries, *self.memory})

    def add(self, name: str, spec: DatasetSpec) -> None:
        self.entries[name] = spec

    def load(self, name: str) -> Any:
        if name in self.memory:
            return self.memory[name]
        if name not in self.entries:
            raise KeyError(f"no dataset {name!r}; there are {self.list()}")
        spec = self._at(name)
        return json.loads(read_text(self.spark, spec.path)) if spec.format == "tracking" else spec.read(self.spark)

    def schema(self, name: str) -> StructType:
        """Of a table."""
        return self.load(name).schema

    def show(self, name: str, n: int = 20) -> None:
        """The first rows of a table, or a tracked document, on the console."""
        data = self.load(name)
        data.show(n, truncate=False) if isinstance(data, DataFrame) else print(json.dumps(data, indent=2))

    def save(self, name: str, data: Any) -> None:
        if name not in self.entries:
            self.memory[name] = data
            return
        spec = self._at(name)
        if spec.format == "tracking":
            write_text(self.spark, spec.path, json.dumps(data, indent=2))
        else:
            spec.write(data)
