"""Line dedup by pairwise alignment.

Documents that share a line, or a run of lines of `least_block` characters, overlap. The holders of each line and of
each run (the fewest lines from a line on that reach that size) are paired with its first holder only, so there are at
most twice as many pairs as lines, however often a line occurs, and every pair counts: the result of two documents does
not depend on how many others hold the line. Overlapping documents are aligned by patience diff, stretches without
unique lines by their largest common blocks, and blocks of consecutive aligned lines are deleted from the later one; the
first holder of a line or run keeps it.

"Later" is by id, then by a fingerprint of the text. Defined cases: a null text is empty and stays so; a row
that repeats another (same id and text) is one document with it and both rows get its result; null ids
come before all others; blank lines and lines shorter than `least_line` characters pair documents only within a run,
and runs of blank lines never do; both go with a block around them; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored, whole

# Characters of a line that can pair documents, and of a block that is deleted, at least.
LEAST_LINE = 16
LEAST_BLOCK = 50


# Lines of two stretches, multiplied, up to which their common blocks are found by comparing all.
SMALL = 4_096


def ranks(x: np.ndarray) -> list[np.ndarray]:
    """Per level l a number for the 2^l lines from each position on, equal where all of them are; those that
    run over the end have numbers of their own. Ends at the level on which all differ. By the last, positions sort."""
    m = len(x)
    out = [np.unique(x, return_inverse=True)[1].astype(np.int64)]
    while out[-1].max() < m - 1:
        step = 1 << (len(out) - 1)
        # Past the end comes less than any line.
        key = out[-1] * (m + 1)
        key[:m - step] += out[-1][step:] + 1
        out.append(np.unique(key, return_inverse=True)[1].astype(np.int64))
    return out


def shared(levels: list[np.ndarray], p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Number of equal lines from the positions p and q on."""
    m = len(levels[0])
    n = np.zeros(np.broadcast(p, q).shape, np.int64)
    for l in range(len(levels) - 1, -1, -1):
        x, y = p + n, q + n
        inside = np.maximum(x, y) + (1 << l) <= m
        same = inside & (levels[l][np.minimum(x, m - 1)] == levels[l][np.minimum(y, m - 1)])
        n += same << l
    return n


def largest(a: Sequence[int], i: int, ie: int, b: Sequence[int], j: int, je: int, sizes: Sequence[int] | None) -> tuple[int, int, int]:
    """Start in `a`, start in `b` and length of the largest common block of a[i:ie] and b[j:je], by `sizes`
    of the lines of `a`, then by their number, the first one of equals. Long stretches are laid
    end to end and their positions sorted by what follows: the longest match of a position is next to it."""
    n, m = ie - i, je - j
    if n * m > SMALL:
        seen: dict[int, int] = {}
        codes = [seen.setdefault(v, len(seen)) for part in (a[i:ie], b[j:je]) for v in part]
        levels = ranks(np.array([*codes[:n], len(seen), *codes[n:]]))
        order = np.argsort(levels[-1])
        of_b = order > n
        at = np.arange(n + m + 1)
        before = np.maximum.accumulate(np.where(of_b, at, -1))
        after = np.minimum.accumulate(np.where(of_b, at, n + m + 1)[::-1])[::-1]
        length = np.zeros(n + m + 1, np.int64)
        for near in (before, after):
            ok = ~of_b & (near >= 0) & (near <= n + m)
            length[order[ok]] = np.maximum(length[order[ok]], shared(levels, order[ok], order[near[ok]]))
        length = length[:n]
        if not length.any():
            return i, j, 0
        filled = np.concatenate([[0], np.cumsum(sizes[i:ie])]) if sizes else np.arange(n + 1)
        size = filled[np.arange(n) + length] - filled[:n]
        x = int(np.lexsort((np.arange(n), -length, -size))[0])
        k = int(length[x])
        y = int(np.argmax(shared(levels, np.full(m, x), np.arange(n + 1, n + m + 1)) >= k))
        return i + x, j + y, k
    where: dict[int, list[int]] = {}
    for y in range(j, je):
        where.setdefault(b[y], []).append(y)
    top, best, ends = (0, 0), (i, j, 0), {}
    for x in range(i, ie):
        now = {}
        for y in where.get(a[x], ()):
            size, k = ends.get(y - 1, (0, 0))
            now[y] = size, k = size + (sizes[x] if sizes else 1), k + 1
            if (size, k) > top:
                top, best = (size, k), (x - k + 1, y - k + 1, k)
        ends = now
    return best


def patience(a: Sequence[int], b: Sequence[int], sizes: Sequence[int] | None = None, least: int = 0) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, rising in both. Lines that occur once on either side anchor
    the alignment (longest rising chain); the stretches between are done likewise, and equal lines at
    either end of a stretch are aligned first. A stretch without such lines is parted by its largest
    common block, by `sizes` of the lines of `a` (else their number), unless that is below `least`: equal lines at
    the ends are aligned already, so no block of that stretch could grow beyond it."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, ie, j, je = todo.pop()
        while i < ie and j < je and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < ie and j < je and a[ie - 1] == b[je - 1]:
            ie, je = ie - 1, je - 1
            out.append((ie, je))
        if i == ie or j == je:
            continue
        na, nb = Counter(a[i:ie]), Counter(b[j:je])
        where = {h: k for k, h in enumerate(b[j:je], j) if nb[h] == 1 and na[h] == 1}
        once = [(k, where[h]) for k, h in enumerate(a[i:ie], i) if h in where]
        if not once:
            x, y, k = largest(a, i, ie, b, j, je, sizes)
            if k and (sum(sizes[x:x + k]) if sizes else k) >= least:
                out += [(x + m, y + m) for m in range(k)]
                todo += [(i, x, j, y), (x + k, ie, y + k, je)]
            continue
        tops: list[int] = []
        piles: list[int] = []
        back: list[int] = []
        for k, (_, y) in enumerate(once):
            p = bisect_left(tops, y)
            back.append(piles[p - 1] if p else -1)
            if p == len(tops):
                tops.append(y)
                piles.append(k)
            else:
                tops[p], piles[p] = y, k
        k, chain = piles[-1], []
        while k >= 0:
            chain.append(once[k])
            k = back[k]
        for x, y in reversed(chain):
            out.append((x, y))
            todo.append((i, x, j, y))
            i, j = x + 1, y + 1
        todo.append((i, ie, j, je))
    return sorted(out)


def blocks(aligned: list[tuple[int, int]], sizes: Sequence[int], least: int = LEAST_BLOCK) -> list[int]:
    """Lines of the later document in blocks of aligned lines with at least `least` characters."""
    out, run, total = [], [], 0
    for k, (i, j) in enumerate(aligned):
        if run and (i, j) != (aligned[k - 1][0] + 1, aligned[k - 1][1] + 1):
            out += run if total >= least else []
            run, total = [], 0
        run.append(i)
        total += sizes[i]
    return out + (run if total >= least else [])


# Odd, so it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15


def runs(h: pa.ListArray, n: pa.ListArray, ok: pa.ListArray, least_line: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, fingerprint) of each run: from every line on the fewest lines that have `least` characters together
    and one that is not blank. Every common block of that size begins with a common run. Left out are runs of one
    line that pairs documents by itself."""
    if not len(h.flatten()):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lens = np.asarray(h.value_lengths())
    line, size, full = (np.asarray(c.flatten().to_numpy(zero_copy_only=False)) for c in (h, n, ok))
    m = len(line)
    row = np.repeat(np.arange(len(lens)), lens)
    at = np.arange(m)
    filled = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    # Past the line at which the size is reached, and past the next line that is not blank.
    stop = np.searchsorted(filled, filled[:-1] + least, "left")
    solid = np.append(np.flatnonzero(full), m)
    stop = np.maximum(stop, solid[np.searchsorted(solid, at, "left")] + 1)
    inside = (stop <= np.cumsum(lens)[row]) & ((stop > at + 1) | (size < least_line))
    # Differences of running sums over powers, brought back to the first power.
    with np.errstate(over="ignore"):
        up, down = np.full((2, m), [[BASE], [pow(BASE, -1, 1 << 64)]], np.uint64)
        up[0] = down[0] = 1
        up, down = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(line.astype(np.int64).view(np.uint64) * up, dtype=np.uint64)])
        key = (total[np.minimum(stop, m)] - total[:-1]) * down + (stop - at).astype(np.uint64)
    return row[inside], key[inside].view(np.int64)


def decide(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
           least_line: int = LEAST_LINE, least_block: int = LEAST_BLOCK) -> DataFrame:
    """`d` (fingerprint of id and text) and `gone` (positions of its deleted lines), only for documents that lose any."""
    t = whole(docs, id_col, text_col).select("_id", F.xxhash64("_id", "_text").alias("d"), F.split("_text", "\n").alias("ls"))
    lines = stored(t.select("_id", "d", F.transform("ls", lambda s: F.xxhash64(s)).alias("h"), F.transform("ls", lambda s: F.length(s)).alias("n"),
                            F.transform("ls", lambda s: s.rlike(r"[^\x20\x09-\x0D]")).alias("ok")), "lines")
    reach_workers(docs.sparkSession)

    def keys(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            row, key = runs(*(b.column(c) for c in (2, 3, 4)), least_line, least_block)
            row = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), pa.array(key)], ["_id", "d", "h"])

    single = lines.select("_id", "d", F.explode(F.expr(f"transform(filter(arrays_zip(h, n, ok), x -> x.ok AND x.n >= {least_line}), x -> x.h)")).alias("h"))
    held = single.unionByName(lines.mapInArrow(keys, single.schema)).distinct()
    # The distinct above is over (id, d, line): a row that repeats another counts once.
    # Written first: adaptive execution splits a hot line only between two plain shuffles.
    holders = stored(held.groupBy("h").agg(F.min(F.struct("_id", "d")).alias("first"), F.count(F.lit(1)).alias("df")).where("df > 1").select(
        F.col("h").alias("fh"), F.col("first.d").alias("f")), "first-holders")
    pairs = stored(held.join(holders, F.col("h") == F.col("fh")).where("d <> f").select(F.col("d").alias("pd"), "f").distinct(), "pairs")
    one = lines.groupBy("d").agg(F.first("h").alias("h"), F.first("n").alias("n"))
    one = stored(one, "line-arrays")
    later = stored(pairs.join(one, F.col("pd") == F.col("d")).select("d", "f", "h", "n"), "later-lines")
    both = (later.join(one.select(F.col("d").alias("fd"), F.col("h").alias("fhs")), F.col("f") == F.col("fd")).select("d", "h", "n", "fhs"))

    def align(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            gone = [blocks(patience(h, f, n, least_block), n, least_block) for h, n, f in zip(*(b.column(c).to_pylist() for c in (1, 2, 3)))]
            some = [k for k, g in enumerate(gone) if g]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(some, pa.int64())), pa.array([gone[k] for k in some], pa.list_(pa.int32()))], ["d", "gone"])

    cuts = both.mapInArrow(align, "d long, gone array<int>")
    return cuts.groupBy("d").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("gone"))


def kept_text():
    """Column function (text, deleted lines) -> remaining text."""
    @F.pandas_udf("string")
    def rest(text: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for t, g in zip(text, gone):
            if g is None or t is None:
                out.append(t)
            else:
                drop = set(g.tolist())
                out.append("\n".join([s for i, s in enumerate(t.split("\n")) if i not in drop]))
        return pd.Series(out, dtype=object)
    return rest


def remove(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **limits: int) -> DataFrame:
    """One row per input row: `row` (all its columns), `gone` (null where nothing was deleted) and `kept` (the remaining text)."""
    # The cuts grow with the corpus: a shuffle join at every size.
    cuts = stored(decide(docs, id_col, text_col, **limits), "line-cuts").select(F.col("d").alias("cd"), "gone").hint("merge")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), F.xxhash64(F.col(id_col).alias("_id"), text).alias("d"))
    rows = rows.join(cuts, F.col("d") == F.col("cd"), "left")
    return rows.select("row", "gone", kept_text()(F.coalesce(F.col("row")[text_col].cast("string"), F.lit("")), F.col("gone")).alias("kept"))
