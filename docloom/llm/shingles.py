"""Words of whole texts as numpy arrays: 64-bit hashes of words, of runs of words, and minimizers over windows."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from xxhash import xxh3_64_intdigest, xxh64_intdigest

_BLANK = re.compile(rb"[ \t-\r]")
#: Bytes of a text that are split into words at a time.
_STEP = 1 << 20
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _parts(data: bytes) -> Iterator[bytes]:
    """data cut at white space into parts of about _STEP bytes."""
    at = 0
    while len(data) - at > _STEP:
        cut = _BLANK.search(data, at + _STEP)
        if cut is None:
            break
        yield data[at : cut.start()]
        at = cut.end()
    yield data[at:] if at else data


def word_hashes(data: bytes) -> np.ndarray:
    """XXH64 of each word's bytes; words are the runs of anything but ASCII white space."""
    out = []
    for part in _parts(data):
        words = part.split()
        out.append(np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words)))
    return out[0] if len(out) == 1 else np.concatenate(out)


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of k words, joined out of the hashes of shorter runs; every step is mixed, so no arrangement of words cancels out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)

    def joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix(mix(a + np.uint64(n)) * _FACTOR + b)

    out, size, power, width = None, 0, mix(words), 1
    while True:
        if k & width:
            n = len(words) - size - width + 1
            out = power[:n].copy() if out is None else joined(out[:n], power[size : size + n], width)
            size += width
        if size == k:
            return out
        power = joined(power[:-width], power[width:], 2 * width)
        width *= 2


def run_hashes(words: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH3 of each run of words from begin to end, which is exclusive; independent of gram_hashes()."""
    data = memoryview(np.ascontiguousarray(words)).cast("B")
    return np.fromiter((xxh3_64_intdigest(data[a:z]) for a, z in zip((8 * begin).tolist(), (8 * end).tolist(), strict=True)), np.uint64, len(begin))


def minimizers(grams: np.ndarray, w: int) -> np.ndarray:
    """For each window of w consecutive grams the place of its smallest, the first among equals."""
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    order = np.argsort(grams, kind="stable")
    rank = np.empty(len(grams), np.int64)
    rank[order] = np.arange(len(grams))  # by value, equal ones by place
    # prefix and suffix minima over blocks of w: each window is the end of one block and the start of the next
    blocks = -(-len(grams) // w)
    pad = np.full(blocks * w, len(grams), np.int64)
    pad[: len(grams)] = rank
    pad = pad.reshape(blocks, w)
    ahead = np.minimum.accumulate(pad, axis=1).ravel()
    back = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
    return order[np.minimum(back[:n], ahead[w - 1 : w - 1 + n])]
