"""Tokens of whole Arrow batches of texts as byte spans with 64-bit hashes.

A token is a run of bytes of a given set; the sets used here take whole UTF-8 characters. ASCII
letters count as lower case. All arithmetic wraps at 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from tallyhound.llm.words import BASE, BLANK, LOWER, U, mix, powers, raw_bytes

# Words: anything but ASCII blanks.
WORD_BYTES = ~BLANK
# Terms: ASCII letters and digits, and every character beyond ASCII.
TERM_BYTES = np.zeros(256, bool)
TERM_BYTES[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Tokens:
    """Tokens of several texts, in order."""
    data: np.ndarray     # all bytes, lower case
    first: np.ndarray    # where each token starts
    size: np.ndarray     # bytes of each token
    hashes: np.ndarray
    counts: np.ndarray   # tokens of each text

    @property
    def owner(self) -> np.ndarray:
        """The text of each token."""
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def spelled(self, which: np.ndarray) -> pa.Array:
        """The bytes of some tokens."""
        return spelled(self.data, self.first[which], self.size[which])


def spelled(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> pa.Array:
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))])
    return raw.cast(pa.binary())


def tokens(texts: pa.Array, kept: np.ndarray) -> Tokens:
    """Runs of `kept` bytes; a text's end ends a run."""
    raw, ends = raw_bytes(texts)
    data, inside = LOWER[raw], kept[raw]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    opens, closes = inside.copy(), inside.copy()
    if len(data):
        opens[1:] &= ~inside[:-1] | edge[1:-1]
        closes[:-1] &= ~inside[1:] | edge[1:-1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes)
    size = last - first + 1
    counts = np.bincount(np.searchsorted(ends, first, side="right") - 1, minlength=len(texts))
    if not len(first):
        return Tokens(data, first, size, np.zeros(0, U), counts)
    start = first[0]
    span = np.diff(np.append(first, len(data)))
    place = np.minimum(np.arange(start, len(data)) - np.repeat(first, span), size.max())
    value = (data[start:].astype(U) + U(1)) * inside[start:] * powers(BASE, int(size.max()) + 1)[place]
    return Tokens(data, first, size, mix(np.add.reduceat(value, first - start)), counts)


def sorted_lookup(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked value in the sorted `keys`, or -1."""
    if not len(keys):
        return np.full(len(asked), -1)
    at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[at] == asked, at, -1)
