"""Vectorized words and shingles.

Words are maximal runs of ASCII letters and digits and of characters beyond ASCII, after
lower-casing.  A word is hashed to 64 bits; a shingle is a hash of so many words in a row.
A text with fewer words, but at least one, has one shingle of all its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are hashed at once.
BLOCK_BYTES = 1 << 21

_U = np.uint64
_WORD_BYTE = np.zeros(256, dtype=bool)
_WORD_BYTE[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finalizer)."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([[_U(1)], np.full(max(n, 2 * len(_powers)), _BASE, dtype=_U)]), dtype=_U)
    return _powers


@dataclass
class Words:
    """Word hashes of a block of texts: ``hashes[starts[k]:starts[k + 1]]`` are those of text ``k``."""

    hashes: np.ndarray
    starts: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


def hash_words(texts: list[str]) -> Words:
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
    ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, dtype=np.int64)
    inside = _WORD_BYTE[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))  # starts and ends take turns; the last byte is no word byte
    first, last = edge[0::2], edge[1::2]
    if not len(first):
        return Words(np.zeros(0, dtype=_U), np.zeros(len(texts) + 1, dtype=np.int64))
    lengths = last - first
    at = np.flatnonzero(inside)
    powers = _power_table(int(lengths.max()))
    bounds = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(at)) - np.repeat(bounds, lengths)
    sums = np.add.reduceat((data[at].astype(_U) + _U(1)) * powers[place], bounds)
    starts = np.concatenate([[0], np.searchsorted(first, ends)])
    return Words(mix(sums ^ lengths.astype(_U)), starts)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts in order, and the number of the text of each."""
    counts = words.counts
    n = np.maximum(counts - size + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = words.starts[:-1][doc] + offset
    out = np.zeros(len(doc), dtype=_U)
    padded = np.concatenate([words.hashes, np.zeros(size, dtype=_U)])
    short = counts < size
    for k in range(size):
        term = padded[at + k]
        if short.any():
            term = np.where(k < counts[doc], term, _U(0))
        out = mix(out * _U(31) + term + _U(k + 1))
    return out, doc


def blocks(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    """Runs of texts of about ``BLOCK_BYTES`` characters with the number of their first; a longer text is a run of its own."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield at, texts[at:k]
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def binary(x: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous byte array as fixed pieces of ``width`` bytes in a binary column."""
    data = np.ascontiguousarray(x).tobytes()
    offsets = np.arange(0, len(data) + 1, width, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
