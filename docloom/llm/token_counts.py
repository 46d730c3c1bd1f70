"""Token counts: pieces counted once per distinct pre-token, joined to per-document pre-token frequencies and summed."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored
from .tokens import counter, rows

#: The most frequent pre-tokens, whose part of the join happens where a document is read: so many, and so many bytes, at most.
HEAD, HEAD_BYTES = 400_000, 8 << 20
#: Pre-tokens that are longer are never among them.
HEAD_WORD = 4096
#: Distinct pre-tokens, and bytes of them, that a task holds before it passes them on.
FLUSH, FLUSH_BYTES = 200_000, 32 << 20


def _pre_tokens(texts: DataFrame, tokenizer: str) -> DataFrame:
    """word, n (occurrences in all texts) and pieces of every distinct pre-token; a task adds up what it meets before anything is shuffled."""

    def distinct(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        size = 0

        def out() -> pa.RecordBatch:
            return pa.record_batch([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

        for b in rows(batches, text=0):
            for t in b.column(0):
                data = t.as_py() or b""
                before = len(seen)
                seen.update(data.split())
                if len(seen) > before:
                    size += len(data) if len(data) < 1 << 16 else len(data) * (len(seen) - before) // len(seen) + 1
                if len(seen) > FLUSH or size > FLUSH_BYTES:
                    yield out()
                    seen, size = Counter(), 0
        yield out()

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = counter(tokenizer)
        for b in rows(batches, 20_000, text=0):
            yield pa.record_batch([b.column(0), b.column(1), pa.array(pieces.count(b.column(0).to_pylist()), pa.int64())], names=["word", "n", "pieces"])

    words = mapped(texts, distinct, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return stored(mapped(words, count, "word binary, n long, pieces long"), "pre-tokens")


def _head(table: DataFrame, head: int) -> tuple[bytes, np.ndarray]:
    """The words, joined by blanks, and pieces of the most frequent pre-tokens, within the bounds."""
    short = table.filter(F.octet_length("word") <= HEAD_WORD)
    step = F.floor(8 * F.log2("n")).cast("int")
    by = sorted(short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words"), F.sum(F.octet_length("word")).alias("size")).collect(), reverse=True)  # some hundred rows
    words = size = 0
    least = None
    for r in by:
        words, size = words + r.words, size + r.size
        if words > head or size > HEAD_BYTES:
            break
        least = r.step
    if least is None:
        return b"", np.zeros(0, np.int64)
    got = short.filter(step >= least).select("word", "pieces").toArrow()
    return b" ".join(got.column("word").to_pylist()), got.column("pieces").to_numpy()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", limit: int = 2048, head: int = HEAD) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every row; repeated rows stay.

    The distinct pre-tokens of all texts are gathered and the pieces of each counted once. Each document's pre-tokens and their
    frequencies are then joined to these counts: the `head` most frequent ones where the document is read, as their table is small
    (so a frequent word is no hot key, and most frequencies are never shuffled), the others by a join on the pre-token. Only counts
    are summed; ids are never kept.

    tokenizer: a file whose pre-tokenizer drops white space, so that no token spans it (a path, or a name among the public
    vocabularies). Null and empty texts have 0 bytes and 0 tokens; a null id stays null; other columns are ignored; an empty table
    gives an empty result.
    """
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    table = _pre_tokens(source.select("text"), tokenizer)
    frequent, pieces = _head(table, head)

    def frequencies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(zip(frequent.split(), pieces.tolist(), strict=True))
        for b in rows(batches, text=2):
            sizes, sums, ends, words, counts = [], [], [0], [], []
            for t in b.column(2):
                data = t.as_py() or b""
                sizes.append(len(data))
                total = 0
                for w, n in Counter(data.split()).items():
                    p = known.get(w)
                    if p is None:
                        words.append(w)
                        counts.append(n)
                    else:
                        total += n * p
                sums.append(total)
                ends.append(len(words))
            rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(words, pa.binary()), pa.array(counts, pa.int32())], ["word", "n"]))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), rest], names=["row", "doc_id", "n_bytes", "n_tokens", "rest"])

    every = stored(mapped(source, frequencies, "row long, doc_id long, n_bytes long, n_tokens long, rest array<struct<word: binary, n: int>>"), "frequencies")
    rest = every.filter(F.size("rest") > 0).select("row", F.explode("rest").alias("r")).select("row", "r.*").join(table.select("word", "pieces"), "word")
    rest = rest.groupBy("row").agg(F.sum(F.col("n") * F.col("pieces")).alias("more"))
    every = every.select("row", "doc_id", "n_bytes", "n_tokens").join(rest, "row", "left").withColumn("n_tokens", F.col("n_tokens") + F.coalesce("more", F.lit(0)))
    return every.select("doc_id", "n_bytes", "n_tokens").withColumn("over_limit", F.col("n_tokens") > limit)
