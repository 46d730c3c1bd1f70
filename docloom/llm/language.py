"""Language identification by segmentation-marginalised unigrams over a fixed public vocabulary."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..runtime import ship
from .common import mapped
from .tokens import rows, vocabulary

#: Cells (words times bytes) of a lattice in work at a time.
CELLS = 1 << 16
#: Steps after which sums are scaled: a step takes a probability down by a factor of 1e-9 at most, so they stay within a double's range.
SCALE = 16
#: In the fit, a run of letters of more bytes is taken as several of this length; scores take every run whole.
FIT_RUN = 2048
_WORDS = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


class Pieces:
    """The vocabulary's pieces of letters in lower case, a leading blank for a word's start, and every single byte, so that any word has a segmentation.

    next: the trie as a table, from state and byte class to state (0: none, 1: the start); number: the piece that ends in a state,
    or n; widest: the bytes of the longest piece.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path if "/" in path else vocabulary(path))
        found = {bytes([i]) for i in range(1, 256)}
        for i in range(model.get_piece_size()):
            p = model.id_to_piece(i).lower().replace("▁", " ")
            if regex.fullmatch(r" ?\p{L}[\p{L}\p{M}]*", p):
                found.add(p.encode())
        every = sorted(found)
        self.n, self.widest = len(every), max(map(len, every))
        used = sorted(set().union(*(p for p in every if len(p) > 1)))
        self.classes = np.zeros(256, np.int32)  # 0: in no longer piece
        self.classes[used] = np.arange(1, len(used) + 1)
        edges: list[dict[int, int]] = [{}, {}]
        ends = [self.n, self.n]
        for i, p in enumerate(every):
            if len(p) == 1:
                continue
            at = 1
            for c in self.classes[list(p)].tolist():
                if c not in edges[at]:
                    edges[at][c] = len(edges)
                    edges.append({})
                    ends.append(self.n)
                at = edges[at][c]
            ends[at] = i
        self.number = np.array(ends, np.int32)
        self.next = np.zeros((len(edges), len(used) + 1), np.int32)
        for state, out in enumerate(edges):
            for c, to in out.items():
                self.next[state, c] = to
        self.single = np.full(256, self.n, np.int32)
        for i, p in enumerate(every):
            if len(p) == 1:
                self.single[p[0]] = i
        self.every = every


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def lattice(words: list[bytes], path: str) -> np.ndarray:
    """[end, length - 1, word]: the number of the piece of that length that ends there, or the number of pieces if there is none."""
    known = pieces(path)
    wide = max(map(len, words))
    text = np.frombuffer(b"".join(w.ljust(wide, b"\0") for w in words), np.uint8).reshape(len(words), wide).T
    classes = known.classes[text]
    out = np.full((wide + 1, min(known.widest, wide), len(words)), known.n, np.int32)
    out[1:, 0] = np.where(text > 0, known.single[text], known.n)
    state = known.next[1, classes]
    for size in range(2, out.shape[1] + 1):
        state = known.next[state[:-1], classes[size - 1 :]]
        if not state.any():
            return out[:, : size - 1]
        out[size:, size - 1] = known.number[state]
    return out


def word_scores(words: list[bytes], p: np.ndarray, path: str) -> np.ndarray:
    """[word, language]: the log probability of each word, all of its segmentations summed; p: [piece, language].

    The forward algorithm over words of like length at a time, in plain numbers that are scaled every SCALE steps, so that a word
    of any length is scored whole.
    """
    table = np.vstack([p, np.zeros((1, p.shape[1]))])
    size = np.array([len(w) for w in words])
    out = np.empty((len(words), p.shape[1]))
    order = np.argsort(size, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, CELLS // int(size[order[at]]))
        # of like length: up to an eighth longer than the first, four bytes at least
        n = min(n, int(np.searchsorted(size[order], size[order[at]] + max(4, size[order[at]] // 8), "right")) - at)
        some = order[at : at + n]
        out[some] = _forward([words[i] for i in some], size[some], table, path)
        at += n
    return out


def _forward(words: list[bytes], size: np.ndarray, table: np.ndarray, path: str) -> np.ndarray:
    wide, out = int(size.max()), np.empty((len(words), table.shape[1]))
    widest = min(pieces(path).widest, wide)
    recent = [np.ones((len(words), table.shape[1]))]  # sums up to the last places, all on one scale
    total = np.zeros((len(words), table.shape[1]))
    base = 0
    for first in range(0, wide, CELLS):  # a very long word's lattice comes in parts that overlap by the longest piece
        base = max(0, first - widest)
        found = lattice([w[base : first + CELLS] for w in words], path)
        has = (found < len(table) - 1).any(axis=2)
        for t in range(first + 1, min(wide, first + CELLS) + 1):
            here = found[t - base]
            now = np.zeros_like(total)
            for s in np.flatnonzero(has[t - base]).tolist():
                if s < t:
                    now += recent[-1 - s] * table[here[s]]
            recent.append(now)
            del recent[:-widest]
            done = np.flatnonzero(size == t)
            if len(done):
                out[done] = np.log(np.maximum(now[done], 1e-300)) + total[done]
            if t % SCALE == 0:
                scale = np.maximum(now, 1e-280)
                total += np.log(scale)
                recent = [x / scale for x in recent]
    return out


def fit(counts: dict[bytes, int], path: str, rounds: int = 3, smoothing: float = 0.05) -> np.ndarray:
    """Piece probabilities of a language by expectation maximisation over its word frequencies, in logarithms."""
    n = pieces(path).n
    by: Counter = Counter()
    for w, k in counts.items():
        for at in range(0, len(w), FIT_RUN):
            by[w[at : at + FIT_RUN]] += k
    words = sorted(by, key=lambda w: (len(w), w))
    sizes_of = np.array([len(w) for w in words])
    p = np.full(n, 1 / n)
    for _ in range(rounds if words else 0):
        expected = np.zeros(n + 1)
        with np.errstate(divide="ignore"):
            log_p = np.log(np.append(p, 0.0))
        at = 0
        while at < len(words):
            ahead_of = sizes_of[at : at + CELLS]
            some = words[at : at + max(1, int(np.searchsorted(ahead_of * np.arange(1, len(ahead_of) + 1), CELLS, "right")))]
            at += len(some)
            size, found = np.array([len(w) for w in some]), lattice(some, path)
            ends, widest, here = found.shape[0], found.shape[1], np.arange(len(some))
            gain = log_p[found]
            ahead = np.full((ends, len(some)), -np.inf)
            ahead[0] = 0
            behind = ahead.copy()
            behind[0] = -np.inf
            behind[size, here] = 0
            for t in range(1, ends):
                sizes = range(1, min(widest, t) + 1)
                ahead[t] = np.logaddexp.reduce([ahead[t - s] + gain[t, s - 1] for s in sizes])
            whole = ahead[size, here]
            weight = np.array([by[w] for w in some])
            for t in range(ends - 1, 0, -1):
                for s in range(1, min(widest, t) + 1):
                    through = gain[t, s - 1] + behind[t]
                    use = np.isfinite(through)
                    if not use.any():
                        continue
                    behind[t - s] = np.logaddexp(behind[t - s], through)
                    expected += np.bincount(found[t, s - 1][use], weight[use] * np.exp(ahead[t - s][use] + through[use] - whole[use]), n + 1)
        p = (expected[:n] + smoothing) / (expected[:n].sum() + smoothing * n)
    return p


def _words(text: str | None) -> list[str]:
    """Runs of letters, and of the marks among and after them, in lower case."""
    return _WORDS(text.lower()) if text else []


def learn(docs: DataFrame, id_col: str, text_col: str, lang_col: str, tokenizer: str, per_language: int, bytes_per_language: int, languages: int) -> tuple[list[str], np.ndarray]:
    """The languages found and their piece probabilities, each fitted in a task of its own from its sample.

    The sample takes documents in the order of a hash of the id. A first count gives the share of the hash range that is sure to
    hold enough of them, so that only about twice the sample is ranked, whatever the number of documents of a language.
    """
    train = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    train = train.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    counted = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).limit(languages + 1).collect()
    if len(counted) > languages:
        raise ValueError(f"{lang_col} has more than {languages} values: the model is {languages} columns at most")
    if not counted:
        return [], np.empty((pieces(tokenizer).n, 0))
    steps = 1 << 20
    share = F.create_map(*[x for r in counted for x in (F.lit(r.lang), F.lit(min(steps, steps * (2 * per_language + 100) // r.n + 1)))])
    near = train.withColumn("h", F.xxhash64(F.lit("sample"), "doc_id")).filter(F.pmod("h", F.lit(steps)) < F.element_at(share, F.col("lang"))).dropDuplicates(["lang", "doc_id"])
    order = Window.partitionBy("lang").orderBy(F.pmod("h", F.lit(steps)), "h", "doc_id")
    ranked = near.select("lang", "doc_id", "h", "text", F.octet_length("text").cast("long").alias("bytes")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_language)
    ranked = ranked.withColumn("so_far", F.sum("bytes").over(Window.partitionBy("lang").orderBy("rank")))
    sample = ranked.filter((F.col("rank") == 1) | (F.col("so_far") <= bytes_per_language)).select("lang", "text")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        counts: Counter = Counter()
        for t in pdf["text"]:
            counts.update(_words(t))
        p = fit({b" " + w.encode(): n for w, n in counts.items()}, tokenizer)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "words": [len(counts)], "p": [p.astype("<f4").tobytes()]})

    ship(docs.sparkSession)
    got = sorted((r for r in sample.groupBy("lang").applyInPandas(one, "lang string, words long, p binary").collect() if r.words), key=lambda r: r.lang)
    return [r.lang for r in got], np.array([np.frombuffer(r.p, "<f4") for r in got]).reshape(len(got), pieces(tokenizer).n).T.astype(float)


def identify_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", tokenizer: str = "piece_bpe_32k.model", per_language: int = 400, bytes_per_language: int = 8 << 20, languages: int = 500) -> DataFrame:
    """doc_id, held_out, lang_pred and score (its posterior probability, all languages alike beforehand) of every row.

    A word is a run of letters and marks in lower case; its probability in a language is the sum over all its segmentations into
    pieces, by the forward algorithm, and a text's is the product over its words. What is learned are piece probabilities of the
    languages in lang_col, from the documents whose crc32(id as text) mod 5 isn't 0: whole documents, up to per_language of each
    language and up to bytes_per_language together (one at least): the documented bounds of the sample. More than `languages`
    values of lang_col are refused, as the model goes to every task.

    Null texts and texts without a letter, and all texts where there is nothing to learn from, are `und` with score 0; a null id is
    neither held out nor learned from; repeated rows stay; other columns are ignored; equal scores go to the first language by name.
    """
    langs, p = learn(docs, id_col, text_col, lang_col, tokenizer, per_language, bytes_per_language, languages)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in rows(batches, 2048, text=1):
            index: dict[str, int] = {}
            ids: list[int] = []
            ends = [0]
            for t in b.column(1):
                ids += [index.setdefault(w, len(index)) for w in _words(t.as_py())]
                ends.append(len(ids))
            best, score = np.full(b.num_rows, "und", object), np.zeros(b.num_rows)
            if index and langs:
                scores = word_scores([b" " + w.encode() for w in index], p, tokenizer)
                at = np.array(ids)
                for i, (a, z) in enumerate(zip(ends, ends[1:], strict=False)):
                    if z > a:
                        total = scores[at[a:z]].sum(axis=0)
                        k = int(total.argmax())
                        best[i], score[i] = langs[k], 1 / np.exp(np.maximum(total - total[k], -700)).sum()
            yield pa.record_batch([b.column(0), pa.array(best, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    out = mapped(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), predict, "doc_id long, lang_pred string, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
