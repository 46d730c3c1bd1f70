"""Where $out and $merge write."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..context import SpecError


def append(df: DataFrame, to: Any) -> None:
    """Append to a sink with append(df), a path ({"path": ..., "format": ...}), or a table by name."""
    if hasattr(to, "append") and not isinstance(to, list):
        to.append(df)
    elif isinstance(to, dict):
        df.write.format(to.get("format", "parquet")).mode("append").save(to["path"])
    else:
        df.write.mode("append").saveAsTable(to)


class FileTarget:
    """A folder of files that $merge reads and replaces: the new state goes beside the old one, and `current` follows it."""

    def __init__(self, spark: SparkSession, path: str, format: str = "parquet"):
        self.spark, self.path, self.format, self.version = spark, path.rstrip("/"), format, 0

    @property
    def current(self) -> str:
        return self.path if not self.version else f"{self.path}-{self.version}"

    def read(self) -> DataFrame:
        return self.spark.read.format(self.format).load(self.current)

    def write(self, df: DataFrame) -> None:
        df.write.format(self.format).save(f"{self.path}-{self.version + 1}")
        self.version += 1


class FrameTarget:
    """A DataFrame in the caller's hands: after $merge, `df` is its new state, which nothing has computed yet."""

    def __init__(self, df: DataFrame):
        self.df = df

    def read(self) -> DataFrame:
        return self.df

    def write(self, df: DataFrame) -> None:
        self.df = df


def target_of(spark: SparkSession, collections: Any, into: Any) -> Any:
    if hasattr(into, "read") and hasattr(into, "write") and not isinstance(into, DataFrame):
        return into
    found = None
    if isinstance(into, str) and collections is not None:  # by name, through the same mapping or function that names collections
        found = collections(into) if callable(collections) else collections.get(into)
    if found is not None and hasattr(found, "write") and not isinstance(found, DataFrame):
        return found
    raise SpecError("$merge goes into a target with read() and write(): FrameTarget or FileTarget, or a name that the collections give such a target for")
