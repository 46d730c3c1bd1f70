"""Pipelines over streams."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..api import Options, SpecError, aggregate

#: Stages that see one document at a time, or a stream beside a static collection, and run on a stream as they are.
ROW_STAGES = {"$match", "$project", "$addFields", "$set", "$unset", "$unwind", "$replaceRoot", "$replaceWith", "$redact", "$unionWith", "$lookup"}


def read_stream(spark: SparkSession, path: str, format: str = "parquet", schema=None, **options: Any) -> DataFrame:
    """A folder's files as they come; the schema is that of what is there unless it is given."""
    schema = schema or spark.read.format(format).load(path).schema
    return spark.readStream.format(format).schema(schema).options(**options).load(path)


def stream(source: DataFrame, pipeline: list[dict], options: Options | None = None) -> DataFrame:
    """The pipeline over a stream: the stages of ROW_STAGES in any order."""
    if bad := [k for s in pipeline for k in s if k not in ROW_STAGES]:
        raise SpecError(f"not on a stream: {', '.join(bad)}; windowed_group() aggregates one")
    return aggregate(source, pipeline, options)


def windowed_group(source: DataFrame, time: str, every: str, late: str, by: list[str], fields: dict, slide: str | None = None) -> DataFrame:
    """fields (accumulators without order) by time window and columns; documents later than `late` behind the newest are left out."""
    from ..operators.accumulators import ORDERED, Group, accumulate
    from ..plans.scope import Scope

    if any(set(v) & ORDERED for v in fields.values()):
        raise SpecError("a stream's groups have no order")
    s = Scope(source)
    aggs = [accumulate(s, v, Group([])).alias(k) for k, v in fields.items()]
    return source.withWatermark(time, late).groupBy(F.window(time, every, slide), *by).agg(*aggs)
