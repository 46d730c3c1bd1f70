"""Token ids in ORC: integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import mapped
from .tokens import encoder, rows

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
#: ids of 16 to 17 bits take that many bits each in ORC's second run-length encoding; a general compressor gains little on top of it.
OPTIONS = {"orc.compress": "NONE", "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true"}


#: Ranges up to which their bounds become one expression.
RANGES = 2048
#: Bytes of the input, as it is stored, for one range.
RANGE_BYTES = 128 << 20


def _count_of_ranges(docs: DataFrame) -> int:
    """By the size of the input, but as many as the session has shuffle partitions at least."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return least if size >= 1 << 60 else max(least, -(-size // RANGE_BYTES))  # beyond: the size isn't known


def _range(id_col: Column, spread: Column, bounds: list[int], nulls: int) -> Column:
    """The range of an id: null ids first, over `nulls` ranges by spread, then the ids up to each bound.

    A bound that is there several times belongs to an id so frequent that it fills several ranges: it has that many by itself, over
    which spread deals its rows.
    """
    heavy = {b: n for b in set(bounds) if (n := bounds.count(b)) > 1}
    edges: list[tuple[int, int]] = []  # last id, and how many ranges
    for b in sorted(set(bounds)):
        if b in heavy:
            edges += [(b - 1, 1), (b, heavy[b])]
        else:
            edges.append((b, 1))
    starts = [nulls]
    for _, n in edges:
        starts.append(starts[-1] + n)

    def dealt(first: int, n: int) -> Column:
        return F.lit(first) if n == 1 else F.lit(first) + F.pmod(spread, F.lit(n)).cast("int")

    def within(a: int, z: int) -> Column:
        if a == z:
            return dealt(starts[a], edges[a][1] if a < len(edges) else 1)
        m = (a + z) // 2
        return F.when(id_col > edges[m][0], within(m + 1, z)).otherwise(within(a, m))

    return F.when(id_col.isNull(), dealt(0, max(nulls, 1))).otherwise(within(0, len(edges)))


def _in_ranges(source: DataFrame, n: int) -> DataFrame:
    """source dealt by n ranges of doc_id, or some more where ids are null or repeat very often.

    The bounds are approximate quantiles, for which the ids alone are read: repartitionByRange() would read all texts once more for
    its sample. It does the dealing where there are more ranges than one expression should hold.
    """
    if n > RANGES:
        return source.repartitionByRange(n, F.col("doc_id"), F.xxhash64("text"))
    found, none, rows_ = source.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000) if n > 1 else F.lit(None), F.count_if(F.col("doc_id").isNull()), F.count(F.lit(1))).first()
    nulls = -(-none * n // max(rows_, 1))
    bounds = sorted(found or [])
    return source.repartitionById(nulls + n + len(bounds), _range(F.col("doc_id"), F.xxhash64("text"), bounds, nulls))


def _arrays(data: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in data)], dtype="<i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(data))]))


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, stripe_bytes: int = 16 << 20) -> None:
    """Write the token ids of every document (with end_id after each) to ORC files at path, in ascending id order over the files.

    Texts are dealt by ranges of the id and sorted, then encoded, so what is shuffled is text and not ids. A row also holds its
    file's number (part, ascending with the id) and its first position there (part_start): global positions follow from one total
    per file. Null texts are empty (the end id alone); null ids come first; rows with equal ids stay, side by side; where so many
    ids are null or equal that they fill several ranges, they are spread over these. Other columns are ignored.
    """

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, encode_text, end = TaskContext.get().partitionId(), 0, encoder(tokenizer).encode, np.asarray([end_id], "<u4").tobytes()
        for b in rows(batches, text=1):
            data = [ids + end for ids in encode_text(t.as_py() for t in b.column(1))]
            n = np.asarray([len(x) // 4 for x in data], np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            yield pa.record_batch([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(starts), pa.array(n), _arrays(data)], names=SCHEMA.names)

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    mapped(_in_ranges(source, _count_of_ranges(docs)).sortWithinPartitions("doc_id", "text"), encode, SCHEMA).write.options(**OPTIONS).option("orc.stripe.size", stripe_bytes).orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """The rows as written. Filters on doc_id skip stripes and row groups by statistics and Bloom filters; stripes are read in parallel."""
    return spark.read.schema(SCHEMA).orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document in the files at path.

    One total per file is summed over the files before it: as many rows as files, whatever the number of documents.
    """

    def checksum(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, k = b.column("ids"), b.schema.get_field_index("ids")
            ends, values = np.asarray(ids.offsets), np.asarray(ids.values).view("<u4")
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
            kept = [b.column(i) for i in range(b.num_columns) if i != k]
            yield pa.record_batch([*kept, pa.array(crc, pa.int64())], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])

    data = read_token_files(spark, path)
    totals = data.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    checked = mapped(data, checksum, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    return checked.join(F.broadcast(before), "part").select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")
