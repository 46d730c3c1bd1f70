"""Collections by name."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from pathlib import PurePosixPath
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..context import SpecError
from ..runtime import ship

#: Formats that a path's suffix names.
FORMATS = {"parquet", "orc", "json", "csv"}


class Catalog:
    """Names to DataFrames: own entries first, then files under a folder, then the session's tables. Nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, folder: str | None = None, entries: dict[str, Any] | None = None, format: str = "parquet"):
        self.spark, self.folder, self.format, self.entries = spark, folder, format, dict(entries or {})

    def __call__(self, name: str) -> DataFrame:
        found = self.entries.get(name)
        if found is not None:
            return found() if callable(found) else found
        if self.folder is not None:
            return self.spark.read.format(self.format).load(f"{self.folder}/{name}.{self.format}")
        return self.spark.table(name)


def resolve(spark: SparkSession, collections: Any, name: Any) -> DataFrame:
    """A DataFrame as it is; a name through the collections (a mapping or function), or a table of the session."""
    if isinstance(name, DataFrame):
        return name
    if callable(collections):
        return collections(name)
    if collections is not None and name in collections:
        return collections[name]
    if collections is None:
        return spark.table(name)
    raise SpecError(f"no such collection: {name}")


def read(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """A file or folder, its format by suffix (parquet without one); a schema spares the pass that infers one."""
    suffix = PurePosixPath(path).suffix.lstrip(".")
    reader = spark.read.format(suffix if suffix in FORMATS else "parquet").options(**options)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def documents(spark: SparkSession, docs: list[dict], schema=None) -> DataFrame:
    """Python documents as a DataFrame; missing fields are null."""
    if schema is not None:
        return spark.createDataFrame(docs, schema)
    names = list(dict.fromkeys(k for d in docs for k in d))
    return spark.createDataFrame([{n: d.get(n) for n in names} for d in docs]).select(*[f"`{n}`" for n in names])


def generated(spark: SparkSession, function: Callable[[int], Iterable[dict]], schema, partitions: int = 1) -> DataFrame:
    """The documents that function(0), function(1), ... yield, each call on an executor in a partition of its own; missing fields are null."""
    to = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    names = to.fieldNames()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = to_arrow_schema(to)
        for b in batches:
            for i in b.column(0).to_pylist():
                held: list[dict] = []
                for d in function(i):
                    held.append({n: d.get(n) for n in names})
                    if len(held) == 1000:
                        yield pa.RecordBatch.from_pylist(held, types)
                        held = []
                yield pa.RecordBatch.from_pylist(held, types)

    ship(spark)
    return spark.range(0, partitions, 1, partitions).mapInArrow(run, to)


def concatenated(*parts: DataFrame) -> DataFrame:
    """All documents of all parts; fields that a part lacks are null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
