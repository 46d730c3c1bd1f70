"""Tokenizer work on whole texts with the tokenizers library; each distinct pre-token is encoded once per task."""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters, digits and white space among the characters PLAIN allows, for the cut of the byte-level format below.
LETTER, DIGIT, BLANK = "A-Za-zªµºÀ-ÖØ-öø-ˁ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"
#: How the byte-level vocabulary's own pre-tokenizer cuts texts (a fixed rule of that public format), for PLAIN texts; what is most frequent is tried first.
BYTE_LEVEL = rf" ?[{LETTER}]+|'(?:[stmd]|re|ve|ll)| ?[{DIGIT}]+| ?[^{LETTER}{DIGIT}{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]+"
#: Texts of Latin letters, digits and common signs, for which the cut is known to the character; others go through the library whole.
PLAIN = "[\x00-\x1b\x20-ˁ‐-‧€]*"
#: Entries a worker keeps; beyond, the later half goes, so memory is bounded and results are the same.
CACHE = 1_000_000
#: Bytes of text in work at a time.
STEP = 8 << 20
#: Longer pre-tokens are encoded where they occur and not kept.
LONG = 64


def vocabulary(name: str) -> str:
    """The file of a public tokenizer on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _open(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path if "/" in path else vocabulary(path))
    tok.no_truncation()
    tok.no_padding()
    return tok


def forget(known: dict, new: list) -> None:
    """Drop long entries; of too many keep those met first, which are the frequent ones."""
    for w in new:
        if len(w) > LONG:
            del known[w]
    if len(known) > CACHE:
        for w in list(known)[CACHE // 2 :]:
            del known[w]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Known(dict):
    """Pre-tokens and their ids; what is new is encoded when it is looked up."""

    def __init__(self, piece: Callable[[str], bytes]):
        super().__init__()
        self.piece = piece

    def __missing__(self, part: str) -> bytes:
        ids = self.piece(part)
        if len(part) <= LONG:
            self[part] = ids
        return ids


class ByteLevelEncoder:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    The byte-level pre-tokenizer cuts a text by a pattern and the merges never cross a cut, so the ids of a text are the ids of
    its pre-tokens one after the other. Texts that aren't PLAIN or hold the string of a special token go through the library whole.
    """

    def __init__(self, path: str):
        self.tok = _open(path)
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.model, self.characters = self.tok.model, byte_characters()
        self.cut, self.plain = re.compile(BYTE_LEVEL).findall, re.compile(PLAIN).fullmatch
        self.known = _Known(self._piece)

    def _whole(self, text: str) -> bytes:
        return array("I", self.tok.encode(text, add_special_tokens=False).ids).tobytes()

    def _piece(self, part: str) -> bytes:
        """The ids of one pre-token, by the library's model alone."""
        return array("I", [x.id for x in self.model.tokenize(part.encode().decode("latin1").translate(self.characters))]).tobytes()

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text, in order."""
        known = self.known
        for t in texts:
            if not t:
                yield b""
                continue
            if self.plain(t) and not any(s in t for s in self.special):
                yield b"".join(map(known.__getitem__, self.cut(t)))
            else:
                yield self._whole(t)
            forget(known, [])


class PieceCounter:
    """Number of tokens of words under a vocabulary that drops white space.

    No token spans white space there, so the count of a text is the sum over its distinct white-space-separated words of frequency
    times pieces; ids are not kept.
    """

    def __init__(self, path: str):
        self.tok = _open(path)

    def count(self, words: list[bytes]) -> list[int]:
        return [len(e) for e in self.tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]


@lru_cache(4)
def encoder(path: str) -> ByteLevelEncoder:
    """One for all tasks of a worker."""
    return ByteLevelEncoder(path)


@lru_cache(4)
def counter(path: str) -> PieceCounter:
    return PieceCounter(path)


def rows(batches: Iterable[pa.RecordBatch], step: int = 256, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of up to step rows and, if the column of texts is named, about STEP bytes: few whole texts are unpacked at a time."""
    for b in batches:
        ends = None if text is None else np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            n = step
            if ends is not None:
                n = min(step, max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP)) - at))
            yield b.slice(at, n)
            at += n
