"""Byte fingerprints and sampled suffixes of whole Arrow batches of texts.

A 200-byte string is represented by one sampled suffix (its anchor): among the K-byte strings inside
it, the start of the one with the least fingerprint. Equal strings have equal anchors at equal places, so
only anchors need to be compared to find every repeat. Arithmetic wraps at 64 bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tallyhound.llm.words import mix, raw_bytes

MATCH = 200
# Bytes of a suffix that its fingerprint covers.
KEY = 32
U = np.uint64
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_rng = np.random.default_rng(3)
BYTE = [_rng.integers(1, 2**63, 256, np.uint64) for _ in _BASES]
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse, kept for the longest batch so far."""
    have = _tables.get(which)
    if have is None or len(have[0]) < n:
        m = max(n, 1 << 16)
        base = _BASES[which]
        both = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.full(m, b, U)
            p[0] = 1
            both.append(np.multiply.accumulate(p))
        have = _tables[which] = tuple(both)
    return have[0][:n], have[1][:n]


class Fingerprints:
    """Prefix sums that give the fingerprint of any stretch of `data` at once."""

    def __init__(self, data: np.ndarray, which: int = 0):
        up, self.down = _powers(which, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(BYTE[which][data] * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def least_ahead(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of `width` values, by block-wise running minima from both sides."""
    n = len(values) - width + 1
    pad = -len(values) % width
    v = np.append(values, np.full(pad, np.iinfo(np.uint64).max, U)).reshape(-1, width)
    left = np.minimum.accumulate(v, axis=1).ravel()
    right = np.minimum.accumulate(v[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[width - 1:width - 1 + n])


def anchors(texts: pa.Array, match: int = MATCH, width: int = KEY) -> dict[str, np.ndarray]:
    """Every anchor: `text` it is in, `at`, first and last start (`lo`, `hi`) of the strings it stands
    for, all relative to the text; `key`, which orders suffixes by their first two bytes and then by a
    fingerprint of their first `width`; and `ctx`, a fingerprint of all bytes of those strings and of
    its place in them."""
    data, ends = raw_bytes(texts)
    size = np.diff(ends)
    count = np.maximum(size - match + 1, 0)
    if not count.any():
        return {n: np.zeros(0, U if n in ("key", "ctx") else np.int64) for n in ("text", "at", "lo", "hi", "key", "ctx")}
    prints = Fingerprints(data)
    place = np.arange(len(data) - width + 1)
    fp = prints.of(place, place + width)
    low = U((1 << int(len(data)).bit_length()) - 1)
    least = least_ahead((fp & ~low) | place.astype(U), match - width + 1) & low
    # Strings that lie within one text.
    first = np.repeat(ends[:-1], count)
    start = first + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    text = np.repeat(np.arange(len(size)), count)
    at = least[start].astype(np.int64)
    new = np.ones(len(start), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    opens = np.flatnonzero(new)
    closes = np.append(opens[1:], len(start)) - 1
    lo, hi, text, first, at = start[opens], start[closes], text[opens], first[opens], at[opens]
    head = (data[at].astype(U) << U(56)) | (data[at + 1].astype(U) << U(48))
    ctx = mix(prints.of(lo, hi + match) + (at - lo).astype(U) * U(_BASES[0]) + (hi - lo).astype(U))
    return {"text": text, "at": at - first, "lo": lo - first, "hi": hi - first, "key": head | (fp[at] >> U(16)), "ctx": ctx}
