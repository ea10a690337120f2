"""Word hashes of whole Arrow batches of texts, and 5-word shingles made of them.

Words are runs of anything but ASCII blanks; ASCII letters count as lower case. All arithmetic wraps
at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text worked on at a time.
CHUNK_BYTES = 1_000_000
SHINGLE = 5
U = np.uint64
BASE = U(0x9FB21C651E98DF25)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BLANK = np.zeros(256, bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads every bit over the word."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U)
    out[0] = 1
    return np.multiply.accumulate(out)


def chunks(texts: pa.Array) -> Iterator[pa.Array]:
    """Slices of about CHUNK_BYTES; a text is never split."""
    if not len(texts):
        return
    size = np.asarray(pc.binary_length(texts)).astype(np.int64)
    cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // CHUNK_BYTES)) + 1).tolist(), len(texts)]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield texts.slice(a, b - a)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, text boundaries) without a copy."""
    texts = texts.cast(pa.large_string() if pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type) else pa.large_binary())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    lo, hi = int(ends[0]), int(ends[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    return data, ends - lo


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text)."""
    data, ends = raw_bytes(texts)
    word = ~BLANK[data]
    starts = word.copy()
    if len(data):
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        starts[1:] &= ~word[:-1] | edge[1:-1]
    first = np.flatnonzero(starts)
    counts = np.bincount(np.searchsorted(ends, first, side="right") - 1, minlength=len(texts))
    if not len(first):
        return np.zeros(0, U), counts
    span = np.diff(np.append(first, len(data)))
    place = np.arange(first[0], len(data)) - np.repeat(first, span)
    value = (LOWER[data[first[0]:]].astype(U) + U(1)) * word[first[0]:]
    size = np.add.reduceat(word[first[0]:], first - first[0], dtype=np.int64)
    value *= powers(BASE, int(size.max()))[np.minimum(place, size.max() - 1)]
    return mix(np.add.reduceat(value, first - first[0])), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every window of k words, windows of each text). A text of fewer words, but at
    least one, has one shingle of all its words; repeats are kept."""
    ends = np.cumsum(counts)
    starts = ends - counts
    made = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    if not len(hashes):
        return np.zeros(0, U), made
    padded = np.append(hashes, np.zeros(k, U))
    weights = powers(U(0xD6E8FEB86659FD93), k)
    rolled = np.zeros(len(hashes), U)
    for j in range(k):
        rolled += padded[j:j + len(hashes)] * weights[j]
    at = np.repeat(starts, made) + np.arange(made.sum()) - np.repeat(np.cumsum(made) - made, made)
    out = rolled[at]
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        slot = (np.cumsum(made) - made)[short]
        for s, d in zip(slot, short):
            out[s] = (hashes[starts[d]:ends[d]] * weights[:counts[d]]).sum(dtype=U) + U(counts[d])
    return mix(out), made


def sequence_keys(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each text's word sequence; equal for equal sequences."""
    starts = np.cumsum(counts) - counts
    place = np.arange(len(hashes)) - np.repeat(starts, counts)
    full = np.flatnonzero(counts)
    out = []
    for base in (U(0xA24BAED4963EE407), U(0x9FB21C651E98DF25)):
        key = np.zeros(len(counts), U)
        if len(full):
            key[full] = np.add.reduceat(hashes * powers(base, int(counts.max()))[place], starts[full])
        out.append(mix(key + counts.astype(U)))
    return out[0], out[1]


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64), pa.int64())
