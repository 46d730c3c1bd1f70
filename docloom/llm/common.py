"""What the operators share: word rules, column checks, the shared folder and checkpoints."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import ship

#: ASCII white space: what separates words everywhere in this subpackage.
SPACE = r"[ \t-\r]"
#: The same characters, for translate().
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The runs of anything but ASCII white space; null gives an empty array."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), lambda v: use(v))[0]


#: Items of an array that scan() folds at a time.
_BLOCK = 64


def scan(items: Column, zero: Column, step: Callable[[Column, Column], tuple[Column, Column]], combine: Callable[[Column, Column], Column], element: str) -> Column:
    """What step puts out for each item of an array, in order; step: from the state before and the item to the state after and the output.

    aggregate() copies its state at every item, so a fold that gathers n outputs costs n squared. Here blocks of items are folded by
    themselves: first each block's state from zero, then the state before each block, out of these by combine (the state after a
    block that starts from s is combine(s, its state from zero)), then the outputs. element: the type of an output, as DDL.
    """
    none = lambda t: F.expr(f"cast(array() as array<{t}>)")

    def fold(block: Column, start: Column) -> Column:
        def one(acc: Column, item: Column) -> Column:
            now, out = step(acc["state"], item)
            return F.struct(now.alias("state"), F.array_append(acc["out"], out).alias("out"))

        return F.aggregate(block, F.struct(start.alias("state"), none(element).alias("out")), one, lambda acc: acc["out"])

    def before(ends: Column) -> Column:
        first = F.struct(zero.alias("state"), F.slice(F.array(zero), F.lit(1), F.lit(0)).alias("out"))
        return F.aggregate(ends, first, lambda acc, e: F.struct(combine(acc["state"], e).alias("state"), F.array_append(acc["out"], acc["state"]).alias("out")), lambda acc: acc["out"])

    def blocks(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / _BLOCK).cast("int")), lambda b: F.slice(x, b * _BLOCK + 1, F.lit(_BLOCK)))

    def whole(x: Column) -> Column:
        ends = lambda b: F.transform(b, lambda block: F.aggregate(block, zero, lambda state, item: step(state, item)[0]))
        return F.when(F.size(x) > 0, once(blocks(x), lambda b: F.flatten(F.zip_with(b, before(ends(b)), fold)))).otherwise(none(element))

    return once(items, whole)


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset and the master is this machine (tests), a temporary one, which is then set."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local($|\[)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="docloom-")
        atexit.register(shutil.rmtree, found, ignore_errors=True)
        sc.setCheckpointDir(found)
    elif not sc.getCheckpointDir():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder for the application, which can go when that has ended."""
    return f"{checkpoint_dir(spark)}/docloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once to the shared folder and read back: later uses start from files that survive a lost executor."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete what stored() wrote, when nothing will read it again."""
    delete(df.sparkSession, df.stored_at)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mapped(df: DataFrame, function: Callable, schema) -> DataFrame:
    """df.mapInArrow(), with this package sent to the workers first."""
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)
