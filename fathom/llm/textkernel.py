"""Words of many UTF-8 texts at once, as numpy arrays.

A word is a run of bytes other than space and 0x09-0x0D. Texts are handled in
chunks of about a megabyte; a longer text makes a chunk of its own, and its
words are hashed block by block, so that memory stays a small multiple of the
longest single text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np

CHUNK_BYTES = 1 << 20
BLOCK_BYTES = 1 << 20

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
ASCII_LOWER = np.arange(256, dtype=np.uint8)
ASCII_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64: spreads each value over all 64 bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** i mod 2^64 for i below n at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        have = np.full(size, base, U64)
        have[0] = 1
        have = _powers[base] = np.multiply.accumulate(have)
    return have


def prefix_hash(buffer: np.ndarray) -> np.ndarray:
    """h with h[i] = sum of value(b_t) * base^t for t < i, mod 2^64; one longer than buffer."""
    out = np.zeros(len(buffer) + 1, U64)
    np.cumsum(_BYTE_VALUE[buffer] * powers(_BASE, len(buffer))[: len(buffer)], out=out[1:])
    return out


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of buffer[s:e] for each span; equal bytes give equal hashes wherever they stand.

    Spans must be in order and not overlap.
    """
    out = np.empty(len(starts), U64)
    i = 0
    while i < len(starts):
        lo = int(starts[i])
        j = max(i + 1, int(np.searchsorted(ends, lo + BLOCK_BYTES, "right")))
        h = prefix_hash(buffer[lo : int(ends[j - 1])])
        s, e = starts[i:j] - lo, ends[i:j] - lo
        out[i:j] = (h[e] - h[s]) * powers(_BASE_INVERSE, len(h))[s] + (e - s).astype(U64)
        i = j
    return mix(out)


@dataclass
class Words:
    """The words of a chunk of texts: text i has words text_ptr[i]:text_ptr[i + 1]."""

    buffer: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    text_ptr: np.ndarray
    byte_ptr: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.text_ptr)

    def hashes(self) -> np.ndarray:
        return hash_spans(self.buffer, self.starts, self.ends)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.text_ptr) - 1), self.counts)


def scan(texts: Sequence[bytes], lower: bool = False) -> Words:
    """Finds the words of texts; a space stands between texts in the buffer."""
    buffer = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        buffer = ASCII_LOWER[buffer]
    byte_ptr = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=byte_ptr[1:])
    word = ~IS_SPACE[buffer]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    if len(word) and word[0]:
        edge = np.concatenate([[0], edge])
    starts, ends = edge[0::2], edge[1::2]
    return Words(buffer, starts, ends, np.searchsorted(starts, byte_ptr), byte_ptr)


def chunks(texts: Sequence[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about limit bytes each, one text at least."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text or b"")
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of width consecutive values; width - 1 shorter than values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = values[:n].copy()
    for k in range(1, width):
        out *= U64(_BASE)
        out += values[k : k + n]
    return mix(out)


def segment_sum(values: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """Sums of values[ptr[i]:ptr[i + 1]], zero where empty; each sum depends on its own segment only."""
    out = np.zeros(len(ptr) - 1, values.dtype if values.dtype.kind == "f" else np.int64)
    full = np.flatnonzero(ptr[1:] > ptr[:-1])
    if len(full):
        ends = ptr[full + 1]
        cut = np.minimum(ptr[full], len(values) - 1)
        idx = np.ravel(np.column_stack([cut, ends]))
        pad = np.append(values, values.dtype.type(0))
        out[full] = np.add.reduceat(pad, idx, dtype=out.dtype)[0::2]
    return out
