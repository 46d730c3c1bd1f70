"""Substring dedup: suffix automata of reference shards, along which documents stream for matching statistics.

A window is `length` consecutive words. Every window has an anchor, its smallest run of length / 5 words by hash, so equal windows
have equal anchors and meet in the shard of that anchor. Consecutive windows of one document with one anchor are a context. Equal
contexts are joined into one before any words are shuffled; the words of the rest, once each, go to the shard of their anchor. A
word is its XXH64, a context two independent hashes of its words (its anchor's and XXH3), so what is taken for equal is equal but
for a chance of 2^-64 a pair of words and 2^-128 a pair of contexts. A
shard walks its contexts in the order of their first document: each streams along the automaton of what came before, which gives
the longest match that ends at each word; matches of `length` words or more are what an earlier document holds; then the context is
added.

An automaton of the whole corpus, broadcast, would grow with the corpus. A shard's is bounded: an anchor with more than `bound`
different contexts is not made one shard. The windows of its contexts are dealt out by their own hash instead and each is held
against its first document, so that nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, release, stored
from .shingles import gram_hashes, minimizers, run_hashes, word_hashes
from .tokens import rows

CONTEXT = "row long, doc_id long, h long, c long, start int, n int"


class SuffixAutomaton:
    """Of the sequences added so far: each state is a class of substrings that end at the same places."""

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link: list[int] = [-1]
        self.len: list[int] = [0]

    def add(self, sequence: list) -> None:
        nxt, link, length = self.next, self.link, self.len
        last = 0
        for x in sequence:
            q = nxt[last].get(x)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            p = last
            if q is None:
                new = len(length)
                nxt.append({})
                link.append(0)
                length.append(length[last] + 1)
                while p != -1 and x not in nxt[p]:
                    nxt[p][x] = new
                    p = link[p]
                if p == -1:
                    last = new
                    continue
                q = nxt[p][x]
                if length[q] == length[p] + 1:
                    link[new] = q
                    last = new
                    continue
            else:
                new = -1
            copy = len(length)
            nxt.append(nxt[q].copy())
            link.append(link[q])
            length.append(length[p] + 1)
            while p != -1 and nxt[p].get(x) == q:
                nxt[p][x] = copy
                p = link[p]
            link[q] = copy
            if new >= 0:
                link[new] = copy
            last = new if new >= 0 else copy

    def matches(self, sequence: list) -> list[int]:
        """Matching statistics: for each place the length of the longest substring known that ends there."""
        nxt, link, length = self.next, self.link, self.len
        state, n, out = 0, 0, []
        for x in sequence:
            while state and x not in nxt[state]:
                state = link[state]
                n = length[state]
            q = nxt[state].get(x)
            if q is None:
                n = 0
            else:
                state, n = q, n + 1
            out.append(n)
        return out


def _anchor(length: int) -> int:
    """Words in an anchor: few make fewer and longer contexts, many make anchors rarer."""
    return max(1, length // 5)


def _cut(words: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """h, c, start and n (windows) of the contexts of a document."""
    k = _anchor(length)
    grams = gram_hashes(words, k)
    place = minimizers(grams, length - k + 1)
    a = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    z = np.append(a[1:], len(place))
    return grams[place[a]], run_hashes(words, a, z + length - 1), a.astype(np.int32), (z - a).astype(np.int32)


def _contexts(base: DataFrame, length: int) -> DataFrame:
    """CONTEXT rows; base: row, doc_id and text."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text=2):
            out: list[list] = [[], [], [], [], [], []]
            for r, d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                words = word_hashes(t.as_py() or b"")
                if len(words) < length:
                    continue
                h, c, a, n = _cut(words, length)
                for column, x in zip(out, (np.full(len(a), r), np.full(len(a), d), h.view(np.int64), c.view(np.int64), a, n), strict=True):
                    column.append(x)
            if out[0]:
                yield pa.record_batch([pa.array(np.concatenate(x)) for x in out], names=["row", "doc_id", "h", "c", "start", "n"])

    return mapped(base.select("row", "doc_id", F.col("text").cast("binary").alias("text")), cut, CONTEXT)


def _content(base: DataFrame, length: int) -> DataFrame:
    """h, c, lo and words (hashes) of the contexts wanted of each document; base: row, doc_id, text, wanted."""

    def fetch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 32):
            for t, wanted in zip(b.column(0), b.column(1), strict=True):
                words, w = word_hashes(t.as_py()), wanted.values
                start, n = np.asarray(w.field("start")), np.asarray(w.field("n"))
                pieces = [words[a : a + m + length - 1].tobytes() for a, m in zip(start.tolist(), n.tolist(), strict=True)]
                yield pa.record_batch([*(w.field(k) for k in ("h", "c", "lo")), pa.array(pieces, pa.binary())], names=["h", "c", "lo", "words"])

    return mapped(base.select(F.col("text").cast("binary").alias("text"), "wanted", "doc_id"), fetch, "h long, c long, lo long, words binary")  # doc_id: so that all joins with the texts share one shuffle of them


def _matched(content: DataFrame, length: int) -> DataFrame:
    """h, c, from and n of the runs of windows of a context that contexts of earlier documents hold; one automaton per anchor."""

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, automaton, waiting, first = None, SuffixAutomaton(), [], None
        for b in batches:
            out: list[tuple] = []
            for h, c, lo, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                if h != at:
                    at, automaton, waiting, first = h, SuffixAutomaton(), [], None
                if lo != first:  # the contexts of one document don't see each other
                    for s in waiting:
                        automaton.add(s)
                    waiting, first = [], lo
                s = np.frombuffer(words.as_py(), np.uint64).tolist()
                hit = np.asarray(automaton.matches(s)[length - 1 :]) >= length
                if not hit.all():
                    waiting.append(s)
                if hit.any():
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                    out += [(h, c, int(a), int(z - a)) for a, z in zip(edge[::2], edge[1::2], strict=True)]
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "c", "from", "n"), x, strict=True)) for x in out], pa.schema([("h", pa.int64()), ("c", pa.int64()), ("from", pa.int32()), ("n", pa.int32())]))

    return mapped(content.repartition("h").sortWithinPartitions("h", "lo"), stream, "h long, c long, `from` int, n int")


def _windows(content: DataFrame, length: int) -> DataFrame:
    """h, c, from and n (1) of the windows of a context that contexts of earlier documents hold, by the windows' own hashes."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches):
            for h, c, lo, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), strict=True):
                w = gram_hashes(np.frombuffer(words.as_py(), np.uint64), length)
                yield pa.record_batch([pa.array(np.full(len(w), h)), pa.array(np.full(len(w), c)), pa.array(np.full(len(w), lo)), pa.array(np.arange(len(w), dtype=np.int32)), pa.array(w.view(np.int64))], names=["h", "c", "lo", "from", "w"])

    one = mapped(content, cut, "h long, c long, lo long, `from` int, w long")
    first = one.groupBy("w").agg(F.min("lo").alias("first"))
    return one.join(first, "w").filter("lo > first").select("h", "c", "from", F.lit(1).alias("n"))


def _runs(base: DataFrame, length: int, bound: int) -> DataFrame:
    """row, start and n of the runs of windows that a document with a smaller id holds too."""
    every = stored(_contexts(base.filter(F.col("doc_id").isNotNull()), length), "contexts")
    # stored, here and below: a join that has nothing but the join to do can split the rows of a frequent anchor among tasks
    shared = stored(every.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h"), "shared-anchors")
    t = stored(every.join(shared, "h"), "shared-contexts")
    release(every)
    context = t.groupBy("h", "c").agg(F.min(F.struct("doc_id", "row", "start", "n")).alias("first"), F.max("doc_id").alias("hi"))
    context = context.select("h", "c", F.col("first.doc_id").alias("lo"), "hi", F.col("first.row").alias("row"), F.col("first.start").alias("start"), F.col("first.n").alias("n"))
    context = stored(context, "distinct-contexts")
    several = stored(context.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1"), "several-contexts")
    context = stored(context.join(several, "h", "left").withColumn("contexts", F.coalesce("contexts", F.lit(1))), "counted-contexts")

    def content(which: str) -> DataFrame:
        these = context.filter(which).groupBy("row").agg(F.collect_list(F.struct("h", "c", "lo", "start", "n")).alias("wanted"))
        return _content(base.join(these, "row"), length)

    found = _matched(content(f"contexts > 1 AND contexts <= {bound}"), length)
    if not context.filter(f"contexts > {bound}").isEmpty():
        found = found.unionByName(_windows(content(f"contexts > {bound}"), length))
    # a document later than a context's first loses all of it; the first itself what an automaton or a window's hash found
    placed = t.join(context.filter("contexts > 1 OR lo < hi").select("h", "c", "lo"), ["h", "c"])
    own = placed.filter("doc_id = lo").select("row", "h", "c", "start")
    parts = own.join(found, ["h", "c"]).select("row", (F.col("start") + F.col("from")).alias("start"), found["n"])
    return placed.filter("doc_id > lo").select("row", "start", t["n"]).unionByName(parts)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, bound: int = 2000) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the kept words, one space between) of every row.

    Removed is each word in a window of `length` words whose sequence also starts in a row with a smaller id; windows are judged on
    the input. Null and empty texts have no words and keep the empty string; rows with a null id neither lose words nor cost others
    theirs; rows with equal ids don't cost each other words; other columns are ignored; an empty table gives an empty result.
    """
    base = docs.select(F.xxhash64(F.col(id_col), F.col(text_col)).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    runs = _runs(base, length, bound).groupBy("row").agg(F.collect_list(F.struct("start", "n")).alias("runs"))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, text=1):
            total, removed, kept = [], [], []
            for i, t in enumerate(b.column(1)):
                data = t.as_py() or b""
                runs = b.column(2)[i].values
                words = data.split()
                total.append(len(words))
                if runs is not None:
                    gone = np.zeros(len(words) + 1, np.int64)
                    start, n = np.asarray(runs.field("start")), np.asarray(runs.field("n"))
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n + length - 1, -1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
                removed.append(total[-1] - len(words))
                kept.append(b" ".join(words))
            yield pa.record_batch([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    joined = base.join(runs, "row", "left").select("doc_id", F.col("text").cast("binary").alias("text"), "runs")
    return mapped(joined, keep, "doc_id long, n_words long, n_removed long, kept string")


def substring_report(docs: DataFrame, length: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return substring_dedup(docs, length=length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


SUBSTRING_SQL = r"""
WITH d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(w) - 48)) AS p, w FROM d),
g AS (SELECT doc_id, p, md5(array_to_string(w[p : p + 49], ' ')) AS h FROM i),
m AS (SELECT h, min(doc_id) AS lo FROM g GROUP BY h),
x AS (SELECT DISTINCT doc_id, p + j AS p FROM (SELECT g.doc_id, g.p FROM g JOIN m ON m.h = g.h WHERE m.lo < g.doc_id), (SELECT unnest(range(0, 50)) AS j)),
k AS (SELECT doc_id, list(p) AS gone FROM x GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda z: NOT list_contains(gone, z[2])), lambda z: z[1]) END, ' ')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
