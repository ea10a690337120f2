"""Best-fit packing by fitted length patterns.

Texts are tokenised into pieces of at most `limit` tokens. Patterns (few pieces whose lengths fill a
sequence) are enumerated from the histogram of piece lengths, repeat counts are fitted to the
histogram by non-negative least squares and rounded down, and what is left is packed best-fit by
falling length into the gaps and into new sequences. All of that is arithmetic on at most `limit`
histogram rows, so its cost does not depend on the corpus; pieces are then numbered within their
length by a salted rank and look their place up.

Defined cases: a null or empty text is the single id 0; repeated rows are packed each; a null doc_id
is packed like any other; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored, whole

LIMIT = 2048
END = b"\0\0\0\0"
# Words a worker remembers for good, and in each of two stores that end with the task.
KNOWN = 250_000
RECENT = 120_000
# Texts tokenised together.
TOGETHER = 500
# Punctuation that may close a word and is cut off it as one part.
CLOSING = "!.,|#$%&*:;"
# Rows of one numbering group.
GROUP_ROWS = 20_000
# Blanks that the tokenizer does not count as white space, while str.split() does.
ODD_BLANKS = ("\x1c", "\x1d", "\x1e", "\x1f")
# Byte-level vocabularies write each byte as a printable letter: printable bytes as themselves, the
# others, in order, as the letters from 256 on.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in PRINTABLE)}
PIECES = "doc_id {}, piece int, start long, length long, ids_crc32 long, order_key long"


class WordTokenizer:
    """Token ids of texts as little-endian bytes.

    The tokenizer never joins characters across white space, so ids of a text are the ids of its
    blank-separated words, which are remembered: the first words for good, later ones until their
    store is full or the task ends. Words made of letters and closing punctuation are looked up by their letters.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.recent: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def part_ids(self, part: str) -> bytes:
        """Ids of lower-case Latin letters only, or of closing punctuation only. The tokenizer's
        normaliser leaves these as they are and cuts them nowhere, so its merges apply at once."""
        ids = self.parts.get(part)
        if ids is None:
            raw = part if part.isascii() else part.encode().decode("latin-1").translate(BYTE_LETTERS)
            ids = self.parts[part] = np.array([t.id for t in self.merge(raw)], "<u4").tobytes()
        return ids

    def look_up(self, words: set[str]) -> dict[str, bytes]:
        """Ids of these words, none of which is in `known`."""
        found, plain, recent = {}, [], self.recent
        for w in words:
            ids = recent.get(w)
            if ids is None:
                core = w.rstrip(CLOSING)
                if not core.isalpha() or not (core.isascii() or max(core) < "\u0100"):
                    plain.append(w)
                    continue
                ids = self.part_ids(core.lower())
                if len(core) < len(w):
                    ids += self.part_ids(w[len(core):])
            found[w] = ids
        if plain:
            found.update(zip(plain, self.encode(plain)))
        if len(self.parts) > RECENT:
            self.parts.clear()
        if len(self.known) < KNOWN:
            self.known.update(found)
        else:
            if len(recent) > RECENT:
                recent.clear()
            recent.update(found)
        return found

    def forget(self) -> None:
        self.recent.clear()
        self.parts.clear()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [None if any(c in t for c in ODD_BLANKS) else t.split() for t in texts]
        seen: set[str] = set()
        for words in split:
            if words:
                seen.update(words)
        new = self.look_up(seen.difference(self.known))
        known = self.known
        out = []
        for text, words in zip(texts, split):
            if words is None:
                out.append(self.encode([text])[0])
            else:
                out.append(b"".join([known[w] if w in known else new[w] for w in words]))
        return out


_tokenizers: dict[str, WordTokenizer] = {}


def _worker_tokenizer(path: str) -> WordTokenizer:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def pieces(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's pieces: number, start, length and checksum of its ids. Full texts are tokenised."""
    d = whole(docs, id_col, text_col)
    reach_workers(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _worker_tokenizer(tokenizer)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(at, TOGETHER)
                row, nth, start, length, crc, order = [], [], [], [], [], []
                for r, ids in enumerate(tok(part.column(1).to_pylist())):
                    ids += END
                    key = zlib.crc32(ids)
                    for k, s in enumerate(range(0, len(ids), 4 * limit)):
                        body = ids[s:s + 4 * limit]
                        row.append(r)
                        nth.append(k)
                        start.append(s // 4)
                        length.append(len(body) // 4)
                        crc.append(zlib.crc32(body))
                        order.append(key)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row, pa.int64())), pa.array(nth, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc, order)]],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "order_key"])
        tok.forget()

    return d.mapInArrow(cut, PIECES.format(d.schema["_id"].dataType.simpleString()))


def patterns(hist: dict[int, int], limit: int = LIMIT, middles: int = 24) -> list[tuple[int, ...]]:
    """Groups of up to four lengths of the histogram that fill a sequence or nearly so.

    The last member is the longest length that still fits, the middle ones run over
    `middles` evenly spread lengths of the histogram.
    """
    lengths = np.array(sorted(hist))
    spread = lengths[np.unique(np.linspace(0, len(lengths) - 1, middles).astype(int))] if len(lengths) else lengths
    few = spread[::3]

    def last(room: np.ndarray) -> np.ndarray:
        at = np.searchsorted(lengths, room, side="right") - 1
        return np.where(at >= 0, lengths[np.maximum(at, 0)], 0)

    out: set[tuple[int, ...]] = set()
    for first in lengths.tolist():
        out.add((first,))
        heads = [(first,)] + [(first, int(b)) for b in spread] + [(first, int(b), int(c)) for b in few for c in few]
        room = np.array([limit - sum(h) for h in heads])
        for head, end in zip(heads, last(room).tolist()):
            if end > 0 and limit - sum(head) >= end:
                out.add(tuple(sorted((*head, end), reverse=True)))
    need = {p: Counter(p) for p in out}
    return sorted(p for p in out if all(hist[x] >= c for x, c in need[p].items()) and 0.98 * limit <= sum(p) <= limit)


def fit_repeats(hist: dict[int, int], pats: list[tuple[int, ...]], rounds: int = 400) -> np.ndarray:
    """Non-negative least squares: repeats x >= 0 that bring the patterns' lengths closest to the
    histogram, by accelerated projected gradient steps on the sparse incidence."""
    if not pats:
        return np.zeros(0)
    lengths = sorted(hist)
    at = {x: i for i, x in enumerate(lengths)}
    row = np.array([at[x] for p in pats for x in p])
    col = np.repeat(np.arange(len(pats)), [len(p) for p in pats])
    goal = np.array([float(hist[x]) for x in lengths])

    def made(x):
        return np.bincount(row, weights=x[col], minlength=len(lengths))

    def back(r):
        return np.bincount(col, weights=r[row], minlength=len(pats))

    probe = np.ones(len(pats))
    for _ in range(30):  # the largest eigenvalue bounds the step
        probe = back(made(probe))
        size = np.linalg.norm(probe)
        probe /= size
    step = 1.0 / (1.05 * size)
    x = y = np.zeros(len(pats))
    t = 1.0
    for _ in range(rounds):
        nxt = np.maximum(0.0, y - step * back(made(y) - goal))
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, x, t = nxt + (t - 1) / t2 * (nxt - x), nxt, t2
    return x


def plan(hist: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as (piece lengths, repeats) that use up the histogram exactly."""
    left = dict(hist)
    pats = patterns(hist, limit)
    fit = fit_repeats(hist, pats)
    gaps: dict[int, list[list]] = defaultdict(list)  # free tokens -> [lengths, repeats]
    for i in sorted(range(len(pats)), key=lambda i: (limit - sum(pats[i]), -fit[i], pats[i])):
        need = Counter(pats[i])
        n = min([int(fit[i]), *(left[x] // c for x, c in need.items())])
        if n > 0:
            for x, c in need.items():
                left[x] -= n * c
            gaps[limit - sum(pats[i])].append([pats[i], n])
    for x in sorted(left, reverse=True):
        n = left[x]
        while n:
            room = min((g for g, open_ in gaps.items() if g >= x and open_), default=None)
            if room is None:
                each = limit // x
                if n // each:
                    gaps[limit - each * x].append([(x,) * each, n // each])
                if n % each:
                    gaps[limit - (n % each) * x].append([(x,) * (n % each), 1])
                break
            group = gaps[room][-1]
            k = min(n, group[1])
            group[1] -= k
            if not group[1]:
                gaps[room].pop()
            gaps[room - x].append([(*group[0], x), k])
            n -= k
    return sorted((tuple(p), k) for groups in gaps.values() for p, k in groups)


def places(packed: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """Where the r-th piece of each length goes: per interval of ranks the length, first rank,
    pieces of that length in each sequence, first sequence and offset of the first of them.
    Sorted by (length, rank)."""
    rows, used, seq = [], Counter(), 0
    for pat, n in packed:
        offset = 0
        for x, c in sorted(Counter(pat).items(), reverse=True):
            rows.append((x, used[x], c, seq, offset))
            used[x] += n * c
            offset += x * c
        seq += n
    rows.sort()
    cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "each", "sequence", "offset"), cols))


def ranked(p: DataFrame) -> DataFrame:
    """Number the pieces of each length from 0, `rank`. Pieces are dealt into groups of bounded size by a
    salt, numbered inside and shifted by the sizes of the groups before, so no length meets in one task."""
    salts = max(1, p.count() // GROUP_ROWS)
    p = p.withColumn("salt", F.pmod(F.xxhash64("doc_id", "order_key", "piece"), F.lit(salts)))
    sizes = p.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(F.col("length").alias("_l"), F.col("salt").alias("_s"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    inside = Window.partitionBy("length", "salt").orderBy("doc_id", "order_key", "piece")
    p = p.withColumn("nth", F.row_number().over(inside))
    return p.join(shift, (p["length"] == shift["_l"]) & (p["salt"] == shift["_s"])).withColumn("rank", F.col("shift") + F.col("nth") - 1)


def pack(docs: DataFrame, tokenizer: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its sequence and offset."""
    spark: SparkSession = docs.sparkSession
    p = stored(pieces(docs, tokenizer, limit, id_col, text_col), "pieces")
    hist = {int(r["length"]): int(r["n"]) for r in p.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    at = places(plan(hist, limit))
    shared = spark.sparkContext.broadcast(at)
    out = "doc_id {}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        # Ranks stay below 2**40, lengths below 2**20: one sorted key finds the interval.
        keys = (t["length"] << 40) | t["rank"]
        for b in batches:
            length, rank = (np.asarray(b.column(c)) for c in ("length", "rank"))
            i = np.searchsorted(keys, (length << 40) | rank, side="right") - 1
            over = rank - t["rank"][i]
            seq = t["sequence"][i] + over // t["each"][i]
            off = t["offset"][i] + (over % t["each"][i]) * length
            yield pa.RecordBatch.from_arrays(
                [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")] + [pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    r = ranked(p).select("doc_id", "piece", "start", "length", "ids_crc32", "rank")
    return r.mapInArrow(place, out.format(p.schema["doc_id"].dataType.simpleString()))
