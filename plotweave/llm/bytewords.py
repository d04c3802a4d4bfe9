"""Vectorised words over a block of texts.

Texts are joined into one UTF-8 buffer and cut into words with numpy, so that a word costs a few array
operations instead of a Python object. A word is known by a 64-bit hash of its bytes (never 0). Texts keep
their order; a null counts as an empty text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow.compute as pc

U = np.uint64
#: An odd factor, and the finishing constants of a 64-bit mixer.
_BASE, _M1, _M2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
_SPACE = 0x20


#: Keeps the first n of eight bytes.
_MASK = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
#: A-Z become a-z; nothing else changes.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_WHITE = bytes([9, 10, 11, 12, 13, 32])


def _separators(is_word) -> bytes:
    """A translation that lower-cases A-Z and makes each byte that isn't part of a word a space."""
    return bytes(c if is_word(c) else _SPACE for c in LOWER)


#: Words [^\\x20\\x09-\\x0D]+ after lower-casing.
WHITESPACE = _separators(lambda c: c not in _WHITE)
#: Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after lower-casing: digits, letters and all beyond ASCII.
ALNUM = _separators(lambda c: c >= 0x80 or 48 <= c <= 57 or 97 <= c <= 122)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finisher: each bit of the result depends on each bit of x."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


@dataclass
class Words:
    """The words of a block: hash, first and last+1 byte of each; words of text i are at[i] to at[i + 1]."""

    buffer: bytes
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def word(self, k: int) -> bytes:
        return self.buffer[self.starts[k] : self.ends[k]]


def cut(texts: Sequence[str | None], table: bytes = WHITESPACE) -> Words:
    """The words of all texts. table: WHITESPACE or ALNUM."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    raw = b" ".join(parts) + b" " * 16
    buffer = raw.translate(table)
    data = np.frombuffer(buffer, dtype=np.uint8)
    inside = data != _SPACE
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edges = np.concatenate(([0], edges))
    starts, ends = edges[0::2], edges[1::2]
    # a word's hash: its bytes, eight at a time, mixed with what came before and with its length
    lengths = ends - starts
    hashes = mix(lengths.astype(np.uint64) * _BASE)
    eights = np.ndarray((len(buffer) - 8,), dtype="<u8", buffer=buffer, strides=(1,))
    left, rows, done = lengths, np.arange(len(starts)), 0
    while len(rows):
        take = np.minimum(left, 8)
        hashes[rows] = mix((hashes[rows] ^ (eights[starts[rows] + done] & _MASK[take])) * _BASE)
        more = left > 8
        rows, left, done = rows[more], left[more] - 8, done + 8
    hashes[hashes == 0] = 1
    sizes = np.fromiter((len(p) + 1 for p in parts), dtype=np.int64, count=len(parts))
    at = np.searchsorted(starts, np.concatenate(([0], np.cumsum(sizes)))) if len(parts) else np.zeros(1, dtype=np.int64)
    return Words(buffer, hashes, starts, ends, at)


def word_hash(word: str) -> int:
    """The hash that cut() gives a word."""
    return int(cut([word]).hashes[0])


def blocks(batches: Iterator, column: str, size: int = 2_000_000) -> Iterator[tuple]:
    """Arrow batches cut into slices whose texts have about size bytes, or one text of more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        lengths = _lengths(texts)
        total = np.cumsum(lengths)
        begin = 0
        while begin < batch.num_rows:
            base = total[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(total, base + size, side="right")))
            yield batch.slice(begin, end - begin)
            begin = end


def _lengths(texts) -> np.ndarray:
    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
