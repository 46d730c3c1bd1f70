"""SimHash near-dedup by anchor-point covering: fingerprints are copied to the code words near them and compared per code word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, stored
from .components import components
from .tokens import rows

#: Columns of the parity check of the Hamming code of 7 bits: every word is a code word or one bit from exactly one.
PARITY = np.array([1, 2, 3, 4, 5, 6, 7])


def _home() -> np.ndarray:
    """The number (0-15) of the code word nearest to each 7-bit word."""
    word = np.arange(128)
    syndrome = np.bitwise_xor.reduce(np.where(word[:, None] >> np.arange(7) & 1, PARITY, 0), axis=1)
    code = np.where(syndrome > 0, word ^ (1 << (syndrome - 1)) * (syndrome > 0), word)
    return np.searchsorted(np.unique(code), code)


def code_words(x: np.ndarray, blocks: int, home: np.ndarray) -> np.ndarray:
    """The nearest anchor of each word: its lowest `blocks` blocks of 7 bits become the numbers of their code words, the bits above stay."""
    at = x >> np.uint64(7 * blocks)
    for k in range(blocks):
        at = at << np.uint64(4) | home[x >> np.uint64(7 * k) & np.uint64(127)]
    return at


def _fingerprint(data: bytes, size: int) -> int:
    from xxhash import xxh64_intdigest

    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= size:
        return xxh64_intdigest(b" ".join(words), 42)
    text = b" ".join(words)
    edge = np.cumsum([0, *(len(w) + 1 for w in words)])
    begin, end = edge[: len(words) - size + 1].tolist(), (edge[size:] - 1).tolist()
    ones, n = np.zeros(64, np.int64), len(begin)
    for at in range(0, n, 1 << 16):
        h = np.array([xxh64_intdigest(text[a:z], 42) for a, z in zip(begin[at : at + (1 << 16)], end[at : at + (1 << 16)], strict=True)], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """doc_id, row (a hash of the text) and fp (64 bits as a long): each bit is what over half the XXH64 (seed 42) of the text's shingles of `size` words have.

    A-Z are lower-cased; a text of fewer words is one shingle; null and empty texts have fingerprint 0.
    """

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text=2):
            fp = np.array([_fingerprint(t.as_py() or b"", size) for t in b.column(2)], np.uint64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(fp.view(np.int64))], names=["doc_id", "row", "fp"])

    text = F.col(text_col)
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text")), compute, "doc_id long, row long, fp long")


def hamming_blocks(n: int) -> int:
    """How many blocks of a half to make coarse for n fingerprints, so that an anchor has some dozens at most unless they are near copies; any number gives the same links."""
    return 4 if n <= 1 << 22 else 2 if n <= 1 << 28 else 1


def _anchors(distinct: DataFrame, blocks: int) -> DataFrame:
    """anchor and fp: each fingerprint at every anchor where it can meet one that differs in up to 4 bits.

    Of two such fingerprints one half of 32 bits differs in at most 2, so some word lies within 1 bit of both halves. The anchors are
    the code words of `blocks` Hamming blocks of 7 bits and of plain bits for the rest: the covering radius is `blocks`, and each
    word has one nearest anchor. A half is copied to the nearest anchor of each word within 1 bit of it (all of these lie within the
    covering radius plus half the threshold), so the two meet at the anchor of the word between them. With 4 blocks a half has 2^20
    anchors and is copied to at most 17, with one 2^29 and at most 29.
    """

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = _home().astype(np.uint64)
        flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
        for b in rows(batches, 8192):
            fp = np.asarray(b.column(0)).view(np.uint64)
            for half in (0, 1):
                x = ((fp >> np.uint64(32 * half)) & np.uint64(0xFFFFFFFF))[:, None] ^ flips
                at = np.sort(code_words(x, blocks, home), axis=1)
                new = np.concatenate([np.ones((len(at), 1), bool), at[:, 1:] != at[:, :-1]], axis=1)
                yield pa.record_batch([pa.array((at[new] | np.uint64(half << 32)).view(np.int64)), pa.array(np.repeat(fp, new.sum(axis=1)).view(np.int64))], names=["anchor", "fp"])

    return mapped(distinct.select("fp"), cover, "anchor long, fp long")


class Groups:
    """Union-find over 0..n-1 by arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            np.minimum.at(root, high, low)
            while (again := root[root]).tobytes() != root.tobytes():
                root[:] = again
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]


def first_reached(fp: np.ndarray, group: np.ndarray, bits: int) -> np.ndarray:
    """The place of the first row each row reaches over every two fingerprints of one group that differ in up to `bits` bits; rows sorted by group, fp: words of fingerprints by rows."""
    n = len(group)
    starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    sizes = np.diff(np.append(starts, n))
    sets = Groups(n)
    small = np.repeat(sizes <= 64, sizes)
    for lag in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero((group[lag:] == group[:-lag]) & small[lag:])
        near = i[sum(np.bitwise_count(x[i] ^ x[i + lag]) for x in fp) <= bits]
        sets.join(near, near + lag)
    for a, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        step = max(1, (1 << 21) // int(m))
        for k in range(0, m, step):
            i, j = np.nonzero(sum(np.bitwise_count(x[a + k : a + min(m, k + step), None] ^ x[None, a + k : a + m]) for x in fp) <= bits)
            more = j > i
            sets.join(a + k + i[more], a + k + j[more])
    return sets.root


def _links(fp: np.ndarray, group: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (member, first member reached) over every two fingerprints of one group that differ in up to `bits` bits; rows sorted by group."""
    root = first_reached(fp[None], group, bits)
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of whole groups of rows, sorted by the first column; a group is in memory at a time, with what else its batch holds."""
    held: list[list[np.ndarray]] = []
    for b in batches:
        if not b.num_rows:
            continue
        columns = [np.asarray(c) for c in b.columns]
        key = columns[0]
        last = int(np.searchsorted(key == key[-1], True))  # where the last group of this batch starts
        if last == 0 and held and held[0][0][0] == key[0]:
            held.append(columns)
            continue
        held.append([c[:last] for c in columns])
        if sum(len(part[0]) for part in held):
            yield [np.concatenate(x) for x in zip(*held, strict=True)]
        held = [[c[last:] for c in columns]]
    if held:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def crowded_blocks(at: DataFrame, crowded: DataFrame, bound: int, values: list[str]) -> DataFrame:
    """key and values: the rows at crowded anchors (anchor, n) cut into blocks, each two of which are together under one key with at most about `bound` rows."""
    blocks = F.ceil(F.col("n") * 2 / bound).cast("long")
    hot = at.join(crowded, "anchor").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64(*values), "blocks"))
    hot = hot.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return hot.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *values)


def _compared(at: DataFrame, bits: int) -> DataFrame:
    """a and b: links that join the same fingerprints as all pairs of near ones with equal key; a group is in memory at a time, and its size is bounded by the caller."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, fp in whole_groups(batches):
            a, b = _links(fp.view(np.uint64), key, bits)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    return mapped(at.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp"), compare, "a long, b long")


def fingerprint_links(distinct: DataFrame, bits: int = 4, bound: int = 20_000, blocks: int | None = None) -> DataFrame:
    """a and b: enough links between the (distinct, non-null) fp to connect all that differ in up to `bits` bits (at most 4).

    An anchor with more than `bound` fingerprints is cut into blocks that are compared two by two, so no task holds more than
    `bound` of them, and every pair is compared all the same. blocks: see _anchors(); by default it follows the number of fingerprints.
    """
    if not 0 <= bits <= 4:
        raise ValueError("anchors cover differences of 0 to 4 bits")
    at = _anchors(distinct, hamming_blocks(distinct.count()) if blocks is None else blocks)
    crowded = stored(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound), "crowded")
    if crowded.isEmpty():
        return _compared(at.withColumnRenamed("anchor", "key"), bits)
    hot = crowded_blocks(at, crowded, bound, ["fp"])
    return _compared(at.join(crowded, "anchor", "left_anti").withColumnRenamed("anchor", "key"), bits).unionByName(_compared(hot, bits))


def _with_components(fps: DataFrame, bits: int, bound: int) -> DataFrame:
    """fps with root, the same for all fingerprints of a component, and component_id."""
    one = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    found = components(fingerprint_links(one, bits, bound))
    parts = one.join(found, one["fp"] == found["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lows = parts.groupBy("root").agg(F.min("low").alias("component_id"))
    return fps.join(parts.join(lows, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4, bound: int = 20_000) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (the smallest id that links reach) of every row.

    Equal fingerprints are one before they are compared. Null and empty texts have fingerprint 0 and are linked like any other;
    repeated rows and ids stay; a null id is the smallest only where a component has no other (component_id is then null); other
    columns are ignored; an empty table gives an empty result.
    """
    fps = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    return _with_components(fps, bits, bound).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bits: int = 4, bound: int = 20_000) -> DataFrame:
    """docs with one row of each component, columns as they are: that of the smallest id (null last).

    Of rows that share this id, and of repeated rows, one stays, chosen by a hash of the text.
    """
    fps = stored(fingerprints(docs, id_col, text_col, size), "fingerprints")
    found = stored(_with_components(fps, bits, bound), "components")
    return first_of_components(docs, found, id_col, text_col)


def first_of_components(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with one row of each component as in simhash_dedup(); found, stored: doc_id, row (a hash of the text) and root of every row."""
    first = stored(found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")), "first")  # apart from the join, which can then split a large component
    others = found.join(first, "root").filter(~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("row") == F.col("first.row"))))
    others = others.select(F.col("doc_id").alias("other"), F.col("row").alias("other_of")).distinct()
    given = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("given"), F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(text_col)).alias("of"))
    kept = given.join(others, F.col("id").eqNullSafe(F.col("other")) & (F.col("of") == F.col("other_of")), "left_anti")
    total, distinct = found.agg(F.count(F.lit(1)), F.countDistinct(F.struct("doc_id", "row"))).first()
    if total != distinct:
        kept = kept.dropDuplicates(["id", "of"])
    return kept.select(*[F.col("given")[c].alias(c) for c in docs.columns])
