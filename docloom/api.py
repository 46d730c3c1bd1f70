"""find, aggregate, remove and update, over DataFrames, collection names and Python documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from .context import KINDS, Context, Options, SpecError, operators, register
from .functions import collections as _collections  # noqa: F401  (the imports register operators)
from .functions import dates as _dates  # noqa: F401
from .functions import scalar as _scalar  # noqa: F401
from .operators import accumulators as _accumulators  # noqa: F401
from .operators import windows as _windows  # noqa: F401
from .operators.projection import project
from .operators.query import compile_query
from .operators.stages import Flow, run
from .operators.update import update
from .plans.rewrite import rewrite
from .plans.scope import Scope
from .sources.catalog import Catalog, documents, read, resolve

__all__ = ["KINDS", "Aggregator", "Catalog", "Context", "Cursor", "Options", "Query", "SpecError", "aggregate", "documents", "find", "operators", "read", "register", "remove", "update"]


def _frame(source: Any, options: Options) -> DataFrame:
    if isinstance(source, DataFrame):
        return source
    spark = SparkSession.active()
    return documents(spark, source) if isinstance(source, list) else resolve(spark, options.collections, source)


class Aggregator:
    """A pipeline, compiled anew for each DataFrame."""

    def __init__(self, pipeline: list[dict], options: Options | None = None):
        self.pipeline, self.options = list(pipeline), options or Options()

    def stream(self, source: Any) -> DataFrame:
        """The plan; nothing runs."""
        return run(Flow(_frame(source, self.options), self.options), rewrite(self.pipeline)).df

    def run(self, source: Any) -> list[dict]:
        """The documents, on the driver."""
        return [r.asDict(recursive=True) for r in self.stream(source).collect()]


class Cursor:
    """A query's results: stages in the order of calls, the projection last. Nothing runs before all(), count(), next() or iteration."""

    def __init__(self, source: Any, criteria: dict, projection: dict | None = None, options: Options | None = None):
        self.source, self.criteria, self.projection, self.options = source, criteria, projection or {}, options or Options()
        self.stages: list[dict] = []
        self._rows: Iterator[Row] | None = None
        self._ahead: list[dict] = []

    def _add(self, name: str, arg: Any) -> Cursor:
        self.stages.append({name: arg})
        return self

    def sort(self, spec: dict) -> Cursor:
        return self._add("$sort", spec)

    def skip(self, n: int) -> Cursor:
        return self._add("$skip", n)

    def limit(self, n: int) -> Cursor:
        return self._add("$limit", n)

    def collation(self, spec: str | dict) -> Cursor:
        from dataclasses import replace

        self.options = replace(self.options, collation=spec)
        return self

    def frame(self) -> DataFrame:
        flow = run(Flow(_frame(self.source, self.options), self.options), rewrite([{"$match": self.criteria}, *self.stages]))
        return project(flow.df, self.projection, flow.scope()) if self.projection else flow.df

    def all(self) -> list[dict]:
        return [r.asDict(recursive=True) for r in self.frame().collect()]

    def count(self) -> int:
        return self.frame().count()

    def _pull(self) -> bool:
        if self._rows is None:
            self._rows = iter(self.frame().toLocalIterator())
        if not self._ahead and (row := next(self._rows, None)) is not None:
            self._ahead.append(row.asDict(recursive=True))
        return bool(self._ahead)

    def has_next(self) -> bool:
        return self._pull()

    def next(self) -> dict | None:
        return self._ahead.pop() if self._pull() else None

    def map(self, f: Callable[[dict], Any]) -> list:
        return [f(d) for d in self]

    def for_each(self, f: Callable[[dict], Any]) -> None:
        for d in self:
            f(d)

    def __iter__(self) -> Iterator[dict]:
        while self._pull():
            yield self._ahead.pop()


class Query:
    """Criteria, to be tested on documents, searched for or removed."""

    def __init__(self, criteria: dict, options: Options | None = None):
        self.criteria, self.options = criteria, options or Options()

    def column(self, df: DataFrame):
        return compile_query(Scope(df, self.options), self.criteria)

    def test(self, document: dict) -> bool:
        df = documents(SparkSession.active(), [document])
        return bool(df.select(self.column(df).alias("x")).first()[0])

    def find(self, source: Any, projection: dict | None = None) -> Cursor:
        return Cursor(source, self.criteria, projection, self.options)

    def remove(self, source: Any) -> DataFrame:
        df = _frame(source, self.options)
        return df.filter(~F.coalesce(self.column(df), F.lit(False)))


def find(source: Any, criteria: dict, projection: dict | None = None, options: Options | None = None) -> Cursor:
    return Query(criteria, options).find(source, projection)


def remove(source: Any, criteria: dict, options: Options | None = None) -> DataFrame:
    """The documents that don't match."""
    return Query(criteria, options).remove(source)


def aggregate(source: Any, pipeline: list[dict], options: Options | None = None) -> DataFrame:
    return Aggregator(pipeline, options).stream(source)
