"""SimHash near-dedup at a Jaccard similarity of word shingles: anchor-point covering of long fingerprints gives candidates, whose shingles are then compared exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped, stored
from .components import components
from .shingles import gram_hashes, mix, word_hashes
from .simhash import Groups, _home, code_words, crowded_blocks, first_of_components, first_reached, whole_groups
from .tokens import rows

#: Bits of a part of a fingerprint and parts of a word of it. A part meets others at its nearest code word, as in simhash.py.
PART, PARTS = 21, 3
#: Words of 64 bits in a fingerprint, by the number of Hamming blocks in a part. Two sets of similarity 0.8 differ in 0.1515 of the bits
#: (the angle between them over pi) and share the anchor of a part with a chance of 0.0695 (two blocks) or 0.0470 (one), of some part with 0.9996.
WORDS = {2: 37, 1: 55}
#: Bits of the first two words that may differ between candidates: at similarity 0.8 more do with a chance of 1.3e-6, of two unrelated sets fewer with 1.3e-5.
BITS = 40
#: Cells of a membership table in work at a time.
CELLS = 1 << 22
_SEEDS = np.random.Generator(np.random.PCG64(7)).integers(0, 2**64, max(WORDS.values()), np.uint64, endpoint=False)
_LANES = np.uint64(0x0101010101010101)


def _shingles(data: bytes, size: int) -> np.ndarray:
    """The different shingles of a text, sorted; a text of fewer words is one, and so is one of none."""
    w = word_hashes(data.lower())
    return np.unique(gram_hashes(w, min(size, len(w)))) if len(w) else np.zeros(1, np.uint64)


def near_blocks(n: int) -> int:
    """How many Hamming blocks a part of a fingerprint has for n texts, so that an anchor has some hundreds at most unless they are near copies; either gives the recall of WORDS."""
    return 2 if n <= 1 << 24 else 1


def _fingerprint(shingles: np.ndarray, words: int) -> np.ndarray:
    """words of 64 bits, each the majority of the shingles' hashes under a seed of its own; a bit is 1 if set in over half of them."""
    ones = np.zeros((words, 8, 8), np.int64)
    for at in range(0, len(shingles), 255):  # so that eight counts fit the bytes of a word
        h = mix(shingles[at : at + 255] ^ _SEEDS[:words, None])
        for bit in range(8):
            ones[:, bit] += (h >> np.uint64(bit) & _LANES).sum(axis=1, dtype=np.uint64).view(np.uint8).reshape(words, 8)
    return np.packbits((2 * ones > len(shingles)).reshape(words, 64), axis=1, bitorder="little").view("<u8")[:, 0]


def _signatures(docs: DataFrame, id_col: str, text_col: str, size: int, words: int) -> DataFrame:
    """doc_id, row (a hash of the text), s (a hash of the set of shingles), n (how many these are) and fp (words of the fingerprint) of every row."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh64_intdigest

        for b in rows(batches, text=2):
            sets = [_shingles(t.as_py() or b"", size) for t in b.column(2)]
            s = np.array([xxh64_intdigest(x.tobytes(), 42) for x in sets], np.uint64).view(np.int64)
            fp = pa.array([_fingerprint(x, words).view(np.int64) for x in sets], pa.list_(pa.int64()))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(s), pa.array([len(x) for x in sets], pa.int64()), fp], names=["doc_id", "row", "s", "n", "fp"])

    text = F.col(text_col)
    return mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), text.cast("binary").alias("text")), compute, "doc_id long, row long, s long, n long, fp array<long>")


def _anchors(one: DataFrame, blocks: int) -> DataFrame:
    """anchor, x and y (the first two words): each fingerprint at the anchor of each of its parts.

    A part of 21 bits has `blocks` Hamming blocks of 7 bits and plain bits for the rest; the code is perfect, so one anchor lies
    within the covering radius. Of two fingerprints that differ in fewer bits than there are parts some part is equal, so they
    always meet; those of similar sets differ in more and meet with the chance given at WORDS.
    """

    def cover(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home = _home().astype(np.uint64)
        for b in rows(batches, 1024):
            fp = np.asarray(b.column(0).flatten()).view(np.uint64).reshape(b.num_rows, -1)
            part = fp[:, :, None] >> (PART * np.arange(PARTS)).astype(np.uint64) & np.uint64((1 << PART) - 1)
            number = np.arange(part[0].size, dtype=np.uint64).reshape(part[0].shape) << np.uint64(PART)
            at = (code_words(part, blocks, home) | number).reshape(b.num_rows, -1)
            columns = [at.ravel(), *(np.repeat(fp[:, k], at.shape[1]) for k in (0, 1))]
            yield pa.record_batch([pa.array(c.view(np.int64)) for c in columns], names=["anchor", "x", "y"])

    return mapped(one.select("fp"), cover, "anchor long, x long, y long")


def _id(x: str | Column, y: str | Column) -> Column:
    """One number for the first two words of a fingerprint. Two that have the same are candidates wherever one is, which adds pairs to compare and loses none."""
    return F.xxhash64(x, y)


def _groups(at: DataFrame) -> DataFrame:
    """key, hub and id: the groups that differences of up to BITS bits connect among the fingerprints of one anchor.

    key is a hash of the group, equal where it is found again; hub is the id of one member, by an order that is the same at all
    anchors, so that groups of much the same members mostly have the same.
    """

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, *fp in whole_groups(batches):
            x, y = (c.view(np.uint64) for c in fp)
            root = first_reached(np.stack([x, y]), key, BITS)
            use = np.bincount(root, minlength=len(root))[root] > 1
            x, y, root = x[use], y[use], root[use]
            new = np.concatenate([np.ones(min(1, len(x)), bool), (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (root[1:] != root[:-1])])
            x, y, root = x[new], y[new], root[new]
            name, hashed = np.zeros(len(key), np.uint64), mix(mix(x) ^ y)
            np.add.at(name, root, hashed)
            first = np.zeros(len(key), np.int64)
            order = np.argsort(hashed)[::-1]
            first[root[order]] = order  # the last that is written stays: that of the smallest hash
            hub = first[root]
            yield pa.record_batch([pa.array(c.view(np.int64)) for c in (name[root], x[hub], y[hub], x, y)], names=["key", "hx", "hy", "x", "y"])

    found = mapped(at.select("key", "x", "y").repartition("key").sortWithinPartitions("key", "x", "y"), compare, "key long, hx long, hy long, x long, y long")
    return found.select("key", _id("hx", "hy").alias("hub"), _id("x", "y").alias("id")).distinct()


def _candidates(one: DataFrame, blocks: int, bound: int = 20_000) -> DataFrame:
    """key, hub and id (see _groups): groups that together hold every two fingerprints that share an anchor and differ in up to BITS bits; one: s, n and fp of every different set.

    An anchor with more than `bound` fingerprints is cut into blocks that are compared two by two, and no pair is left out.
    """
    at = _anchors(one, blocks)
    crowded = None
    if one.count() > bound:
        crowded = stored(at.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bound), "crowded")
    if crowded is None or crowded.isEmpty():
        return _groups(at.withColumnRenamed("anchor", "key"))
    found = _groups(at.join(crowded, "anchor", "left_anti").withColumnRenamed("anchor", "key"))
    return found.unionByName(_groups(crowded_blocks(at, crowded, bound, ["x", "y"]))).distinct()


def _named(one: DataFrame) -> DataFrame:
    """id, s, n and row, where there is one, of every different set."""
    return one.select(_id(F.col("fp")[0], F.col("fp")[1]).alias("id"), *[c for c in one.columns if c != "fp"])


def near_candidates(one: DataFrame, blocks: int, bound: int = 20_000) -> DataFrame:
    """key, s and n: the sets in the groups of _candidates()."""
    return _candidates(one, blocks, bound).join(_named(one), "id").select("key", "s", "n")


def _sets(texts: DataFrame, size: int) -> DataFrame:
    """s and shingles; texts: s and text."""

    def compute(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text=1):
            yield pa.record_batch([b.column(0), pa.array([_shingles(t.as_py() or b"", size).view(np.int64) for t in b.column(1)], pa.list_(pa.int64()))], names=["s", "shingles"])

    return mapped(texts.select("s", F.col("text").cast("binary").alias("text")), compute, "s long, shingles array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""
    both = pairs.join(sets.select(F.col("s").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("s").alias("b"), F.col("shingles").alias("y")), "b")
    both = both.select("a", "b", (F.size("x") + F.size("y")).alias("all"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return both.filter(F.col("shared") / (F.col("all") - F.col("shared")) >= similarity).select("a", "b")


def _pairs_of(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """The places of all pairs of sets that are similar enough, compared exactly: shared members are counted by products of membership tables."""
    m, size = len(sets), np.array([len(x) for x in sets])
    if m == 2:
        shared = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, several = np.repeat(np.arange(m), size), times > 1
        number = np.cumsum(several) - 1
        use = several[column]
        owner, column = owner[use], number[column[use]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        shared, step = np.zeros((m, m), np.float32), max(1, CELLS // m)
        for first in range(0, int(several.sum()), step):
            a, z = np.searchsorted(column, [first, first + step])
            table = np.zeros((m, step), np.float32)
            table[owner[a:z], column[a:z] - first] = 1
            shared += table @ table.T
    both = size[:, None] + size[None, :] - shared
    i, j = np.nonzero(shared >= similarity * both)
    return i[i < j], j[i < j]


def _compared(members: DataFrame, similarity: float) -> DataFrame:
    """a and b: links that connect the same sets as all pairs of similar ones with equal keys; members: key, s and shingles. One group is in memory at a time; its size is bounded by the caller."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, names, sets = None, [], []

        def out() -> Iterator[pa.RecordBatch]:
            if len(sets) > 1:
                groups = Groups(len(sets))
                groups.join(*_pairs_of(sets, similarity))
                linked = np.flatnonzero(groups.root != np.arange(len(sets)))
                if len(linked):
                    s = np.array(names, np.int64)
                    yield pa.record_batch([pa.array(s[groups.root[linked]]), pa.array(s[linked])], names=["a", "b"])

        for b in batches:
            for k, s, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                if k != key:
                    yield from out()
                    key, names, sets = k, [], []
                names.append(s)
                sets.append(np.asarray(x.values).view(np.uint64))
        yield from out()

    return mapped(members.select("key", "s", "shingles").repartition("key").sortWithinPartitions("key", "s"), compare, "a long, b long")


def _fits(a: Column, b: Column, similarity: float) -> Column:
    """Whether sets of a and b members can be similar enough."""
    return F.least(a, b) / F.greatest(a, b) >= similarity


def _blocks(bound: int, members: int) -> Column:
    """How many blocks a group of `sets` sets and `size` shingles is cut into, for up to `bound` shingles and `members` sets in two of them."""
    b = F.greatest(F.lit(1), F.ceil(2 * F.col("size") / bound), F.ceil(2 * F.col("sets") / members)).cast("long")
    return F.when(b > 2, b).otherwise(1)


def _dealt(groups: DataFrame, sets: DataFrame) -> DataFrame:
    """key, s and shingles: the members of each group (key, s, blocks), cut into blocks, every two of which are together under one key."""
    rest = groups.withColumn("own", F.pmod(F.xxhash64("s"), "blocks"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return rest.select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), "s").join(sets, "s")


def _group_links(at: DataFrame, sets: DataFrame, similarity: float, bound: int, members: int) -> DataFrame:
    """a and b: links that connect the same sets as all pairs that share a group and are similar enough; at: see near_candidates().

    For groups that near_links() doesn't compare together. The members of a group are first compared to one of them, which joins most
    of a dense group. Groups whose members are then still apart are compared all with all, inside a task that puts out no pairs but
    the links of a tree. A group of more than `bound` shingles or `members` sets is cut into blocks that are compared two by two, so
    no task holds more than that, and no pair is left out. Of the groups that are still apart those that overlap are compared as one
    where this takes fewer copies of sets.
    """
    hubs = at.groupBy("key").agg(F.min(F.struct("s", "n")).alias("hub"))
    at = stored(at.join(hubs, "key"), "groups")
    stars = at.filter((F.col("s") != F.col("hub.s")) & _fits(F.col("n"), F.col("hub.n"), similarity)).select(F.col("hub.s").alias("a"), F.col("s").alias("b")).distinct()
    links = stored(_similar(stars, sets, similarity), "star-links")
    found = components(links)
    at = stored(at.join(found, at["s"] == found["node"], "left").select("key", "s", "n", F.coalesce("root", "s").alias("root")), "rooted-groups")
    apart = at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("s").alias("least"), F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size")).filter("low < high")
    apart = stored(apart.drop("low", "high"), "groups-apart")
    whole = stored(components(at.join(apart.select("key", "least"), "key").select(F.col("least").alias("a"), F.col("s").alias("b"))).select(F.col("node").alias("s"), F.col("root").alias("whole")), "groups-joined")
    apart = apart.join(whole, apart["least"] == whole["s"]).select("key", "whole", "sets", _blocks(bound, members).alias("blocks"))
    each = apart.groupBy("whole").agg(F.sum(F.col("sets") * F.col("blocks")).alias("copies"))
    joined = whole.join(at.select("s", "n").distinct(), "s").groupBy("whole").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"))
    joined = joined.withColumn("blocks", _blocks(bound, members)).join(each, "whole").filter(F.col("sets") * F.col("blocks") <= F.col("copies")).select("whole", "blocks")
    joined = stored(joined, "groups-together")
    rest = whole.join(joined, "whole").select(F.col("whole").alias("key"), "s", "blocks")
    rest = rest.unionByName(at.join(apart.join(joined, "whole", "left_anti"), "key").select("key", "s", "blocks"))
    return links.unionByName(_compared(_dealt(rest, sets), similarity))


def near_links(at: DataFrame, named: DataFrame, sets: DataFrame, similarity: float, bound: int = 2_000_000, members: int = 2000) -> DataFrame:
    """a and b: links that connect the same sets as all pairs that share a group and are similar enough, or more that are; at: see _candidates(), named: id, s and n.

    The same texts meet at up to all parts of their fingerprints, each time in other company, and their memberships are many times
    the texts. Groups that overlap are therefore compared as one, a row for each text, where this takes no more copies of sets than
    group by group. What connects them is counted once for a hub and a member, and tied are only a member and the lowest of its hubs, and
    this and its other hubs, of which there are few different pairs. The members of such a whole are first compared to
    the one of most memberships, which joins most of a dense one; if some are then still apart they are compared all with all, in
    blocks as _group_links() has them. The groups of the other wholes go there.
    """
    met = at.groupBy("hub", "id").agg(F.count(F.lit(1)).alias("times"))
    met = stored(met.withColumn("low", F.min("hub").over(Window.partitionBy("id"))), "met")
    ties = met.select(F.col("low").alias("a"), F.col("id").alias("b")).unionByName(met.select(F.col("low").alias("a"), F.col("hub").alias("b"))).distinct()
    whole = stored(components(ties).select(F.col("node").alias("id"), F.col("root").alias("whole")), "wholes")
    alone = met.select("id").distinct().join(whole, "id", "left_anti").select("id", F.col("id").alias("whole"))  # sets with equal first words and no other company
    whole = whole.unionByName(alone)
    times = met.groupBy("id").agg(F.sum("times").alias("times"))
    every = stored(whole.join(times, "id").join(named.select("id", "s", "n"), "id").select("id", "whole", "times", "s", "n"), "whole-sets")

    each = at.groupBy("hub", "key").agg(F.count(F.lit(1)).alias("sets")).withColumn("size", F.lit(0))
    each = each.groupBy("hub").agg(F.sum(F.col("sets") * _blocks(bound, members)).alias("copies"))
    each = each.join(whole, each["hub"] == whole["id"]).groupBy("whole").agg(F.sum("copies").alias("copies"))
    wholes = every.groupBy("whole").agg(F.count(F.lit(1)).alias("sets"), F.sum("n").alias("size"), F.max(F.struct("times", "s", "n")).alias("hub")).withColumn("blocks", _blocks(bound, members))
    wholes = stored(wholes.join(each, "whole").select("whole", "hub", "blocks", (F.col("sets") * F.col("blocks") <= F.greatest("copies", "sets")).alias("together")), "wholes-counted")

    stars = every.join(wholes.filter("together"), "whole").filter((F.col("s") != F.col("hub.s")) & _fits(F.col("n"), F.col("hub.n"), similarity))
    links = stored(_similar(stars.select(F.col("hub.s").alias("a"), F.col("s").alias("b")), sets, similarity), "star-links")
    found = components(links)
    rooted = every.join(wholes.filter("together").select("whole", "blocks"), "whole").join(found, every["s"] == found["node"], "left").select("whole", "blocks", "s", F.coalesce("root", "s").alias("root"))
    rooted = stored(rooted, "rooted-wholes")
    apart = rooted.groupBy("whole").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("whole")
    links = links.unionByName(_compared(_dealt(rooted.join(apart, "whole").select(F.col("whole").alias("key"), "s", "blocks"), sets), similarity))
    others = wholes.filter("NOT together").select("whole")
    if others.isEmpty():
        return links
    others = every.join(others, "whole").select("id", "s", "n")
    return links.unionByName(_group_links(at.join(others, "id").select("key", "s", "n"), sets, similarity, bound, members))


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, bound: int = 2_000_000, members: int = 2000) -> DataFrame:
    """doc_id, row (a hash of the text) and root (the same for all rows that links connect) of every row.

    Linked are texts whose sets of shingles of `size` words have a Jaccard similarity of at least `similarity` (0.8 or more, for
    which WORDS and BITS are made), compared exactly among the candidates that fingerprints give.
    A-Z are lower-cased; a text of fewer words is one shingle; null and empty texts are equal to each other.
    """
    blocks = near_blocks(docs.count())
    every = stored(_signatures(docs, id_col, text_col, size, WORDS[blocks]), "signatures")
    one = stored(every.groupBy("s").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp")), "distinct")
    at = stored(_candidates(one, blocks), "candidates")
    named = _named(one)
    wanted = named.join(at.select("id").distinct(), "id").select("s", F.col("row").alias("__row"))
    texts = docs.select(F.xxhash64(text_col).alias("__row"), F.col(text_col).alias("text")).join(wanted, "__row").dropDuplicates(["s"])
    sets = stored(_sets(texts, size), "shingle-sets")
    found = components(near_links(at, named, sets, similarity, bound, members))
    return every.join(found, every["s"] == found["node"], "left").select("doc_id", "row", F.coalesce("root", "s").alias("root"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """docs with one row of each group of near copies, columns as they are: that of the smallest id (null last).

    Of rows that share this id, and of repeated rows, one stays, chosen by a hash of the text.
    """
    return first_of_components(docs, stored(near_components(docs, id_col, text_col, size, similarity), "components"), id_col, text_col)
