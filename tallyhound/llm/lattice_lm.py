"""Language-model scores by subword lattices.

A text is its words (runs of anything but ASCII blanks, ASCII letters in lower case) and one end. The pieces of an
existing subword vocabulary that occur in a word, piece by piece from left to right, form a lattice of all its
segmentations; the last piece of a word is one that marks word ends. The probability a vocabulary spells a word with,

    spell(word) = sum over segmentations of the product of the pieces' probabilities,

is the forward recursion over the lattice, in log space. Piece probabilities start from the vocabulary's own order (a
Zipf law over merge ranks, which is all the score that byte-pair vocabularies carry) and are re-estimated by ROUNDS of
expectation-maximisation over the lattices of all training words. As every word ends with exactly one closing piece,
spell sums to one over all words. On top of the lattice lies one arc for a whole word seen in training, with
absolute discounting:

    P(word) = (c - d) / N + d V / N * spell(word),    P(end) = (c - d) / N,

with N training tokens, V distinct ones, c the token's count (nothing in place of c - d if it was not seen) and
d = n1 / (n1 + 2 n2) from the numbers of tokens seen once and twice. A text's score is the sum of the log10
probabilities of its tokens; the segmentations of different words are independent, so that is the marginal
probability of the whole text.

Counts, distinct words and expected piece counts cover all training texts. Each distinct word is spelled once, where
its count is. The FREQUENT most frequent words are sent to every executor; the other words of a text are
joined to theirs by hash. By their rank such a word makes up less than 1/FREQUENT of all tokens, so no key of
that join is hot, however skewed the corpus.

Defined cases: a null or empty text has the end as its only token; rows that repeat id and text get the same
scores, one row each, and are learned from each; a null id is not held out; without training tokens all words
are spelled, and the end has probability 1/2; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored, whole
from tallyhound.llm.packing import BYTE_LETTERS
from tallyhound.llm.spans import WORD_BYTES, sorted_lookup, tokens
from tallyhound.llm.words import BASE, U, chunks, mix, powers, raw_bytes, signed

ROUNDS = 2
FREQUENT = 131_072
# Words above this many bytes are spelled one by one.
LONG = 64
# Words spelled together.
TOGETHER = 8_192
ZIPF_SHIFT = 100.0
# Expected occurrences added to each piece, so that none becomes impossible.
PRIOR = 0.01
WORD_END = "</w>"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces by hash: `log_p` of the pieces inside a word and of those that close one."""
    keys: np.ndarray      # hashes of the spellings, rising; closing pieces apart
    close: np.ndarray     # for each key: place in `log_p` of the closing piece, or -1
    inner: np.ndarray     # likewise of the inner piece
    log_p: np.ndarray
    longest: int

    def with_counts(self, expected: np.ndarray) -> Vocabulary:
        p = expected + PRIOR
        return Vocabulary(self.keys, self.close, self.inner, np.log(p / p.sum()), self.longest)


def read_pieces(path: str, word_end: str = WORD_END) -> list[tuple[bytes, bool]]:
    """(spelling, closes a word) of the pieces of a byte-level vocabulary, in its order."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", [])}
    byte_of = {chr(letter): b for b, letter in BYTE_LETTERS.items()} | {chr(b): b for b in range(256) if b not in BYTE_LETTERS}
    out = []
    for piece, _ in sorted(model["model"]["vocab"].items(), key=lambda x: x[1]):
        core = piece.removesuffix(word_end)
        if piece not in special and core and all(c in byte_of for c in core):
            out.append((bytes(byte_of[c] for c in core), core != piece))
    return out


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.array([int(hash_of(np.frombuffer(w, np.uint8))) for w in words], U)


def hash_of(b: np.ndarray) -> np.uint64:
    """Hash of one byte string, as `Lattice` computes those of substrings."""
    return mix(((b.astype(U) + U(1)) * powers(BASE, len(b))[::-1]).sum(dtype=U, keepdims=True))[0]


def vocabulary(pieces: list[tuple[bytes, bool]]) -> Vocabulary:
    """Every byte must be a piece, inner and closing, so that every word has a segmentation."""
    have = set(pieces)
    if any((bytes([b]), last) not in have for b in range(256) for last in (False, True)):
        raise ValueError("the vocabulary lacks pieces for single bytes")
    spelling = sorted({p for p, _ in pieces})
    h = hashes_of(spelling)
    order = np.argsort(h)
    keys, place = h[order], {spelling[k]: i for i, k in enumerate(order)}
    close, inner = np.full(len(keys), -1), np.full(len(keys), -1)
    for i, (p, last) in enumerate(pieces):
        (close if last else inner)[place[p]] = i
    zipf = -np.log(np.arange(len(pieces)) + ZIPF_SHIFT)
    return Vocabulary(keys, close, inner, zipf - np.log(np.exp(zipf).sum()), max(map(len, spelling)))


class Speller:
    """Forward and backward recursion over the lattices of many words at once."""

    def __init__(self, v: Vocabulary):
        self.v = v
        # A table of 2^20 places finds nearly every piece at once; the few that share a place are searched.
        self.bits = U(44)
        self.table = np.full(1 << 20, -1, np.int32)
        self.table[(v.keys >> self.bits).astype(np.int64)] = np.arange(len(v.keys))
        placed = self.table[(v.keys >> self.bits).astype(np.int64)] == np.arange(len(v.keys))
        self.others = np.flatnonzero(~placed)
        self.other_keys = v.keys[self.others]
        self.log_close = np.where(v.close >= 0, v.log_p[v.close], -np.inf)
        self.log_inner = np.where(v.inner >= 0, v.log_p[v.inner], -np.inf)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Place of each hash among the keys, or -1."""
        at = self.table[(h >> self.bits).astype(np.int64)]
        at = np.where((at >= 0) & (self.v.keys[at] == h), at, -1)
        if len(self.others):
            miss = np.flatnonzero(at < 0)
            more = sorted_lookup(self.other_keys, h[miss])
            at[miss] = np.where(more >= 0, self.others[more], -1)
        return at

    def lattice(self, rows: np.ndarray) -> list[np.ndarray]:
        """For words of one length: per piece length k, the piece that starts at each place, or -1."""
        n, size = rows.shape
        value = rows.astype(U) + U(1)
        out, h = [], np.zeros((n, size), U)
        for k in range(1, min(size, self.v.longest) + 1):
            h = h[:, :size - k + 1] * BASE + value[:, k - 1:]
            out.append(self.find(mix(h.ravel())).reshape(n, size - k + 1))
        return out

    def forward(self, found: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of every prefix as inner pieces, log probability of the words)."""
        n = len(found[0])
        alpha = np.full((n, size), -np.inf)
        alpha[:, 0] = 0
        for j in range(1, size):
            alpha[:, j] = _log_sum([alpha[:, j - k] + self._log(self.log_inner, found[k - 1][:, j - k]) for k in range(1, min(j, len(found)) + 1)])
        last = [alpha[:, size - k] + self._log(self.log_close, found[k - 1][:, size - k]) for k in range(1, len(found) + 1)]
        return alpha, _log_sum(last)

    @staticmethod
    def _log(log_p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at >= 0, log_p[at], -np.inf)

    def log_spell(self, rows: np.ndarray) -> np.ndarray:
        return self.forward(self.lattice(rows), rows.shape[1])[1]

    def add_expected(self, rows: np.ndarray, counts: np.ndarray) -> None:
        """Add the expected number of times each piece is used in spelling each word once."""
        size = rows.shape[1]
        found = self.lattice(rows)
        alpha, total = self.forward(found, size)
        beta = np.full((len(rows), size), -np.inf)

        def use(k: int, i: int, log_p: np.ndarray, piece: np.ndarray, onward) -> np.ndarray:
            at = found[k - 1][:, i]
            tail = self._log(log_p, at) + onward
            share = np.exp(alpha[:, i] + tail - total)
            on = share > 0
            np.add.at(counts, piece[at[on]], share[on])
            return tail

        for i in range(size - 1, -1, -1):
            tails = []
            for k in range(1, min(size - i, len(found)) + 1):
                if i + k == size:
                    tails.append(use(k, i, self.log_close, self.v.close, 0.0))
                else:
                    tails.append(use(k, i, self.log_inner, self.v.inner, beta[:, i + k]))
            beta[:, i] = _log_sum(tails)

    def long_word(self, word: bytes, counts: np.ndarray | None = None) -> float:
        """The same for one long word, in time linear in its length."""
        size = len(word)
        rows = np.frombuffer(word, np.uint8)
        found = self.lattice(rows[None, :])
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]
        for k, at in enumerate(found, 1):
            for i in np.flatnonzero(at[0] >= 0).tolist():
                arcs[i + k].append((i, int(at[0, i])))

        def weight(j: int, a: int) -> float:
            return float(self.log_close[a] if j == size else self.log_inner[a])
        alpha = [-math.inf] * (size + 1)
        alpha[0] = 0.0
        for j in range(1, size + 1):
            alpha[j] = _log_sum_of([alpha[i] + weight(j, a) for i, a in arcs[j]])
        if counts is not None:
            beta = [-math.inf] * (size + 1)
            beta[size] = 0.0
            tails: list[list[float]] = [[] for _ in range(size + 1)]
            for j in range(size, 0, -1):
                if j < size:
                    beta[j] = _log_sum_of(tails[j])
                    tails[j] = []
                for i, a in arcs[j]:
                    w = weight(j, a) + beta[j]
                    tails[i].append(w)
                    share = math.exp(min(0.0, alpha[i] + w - alpha[size]))
                    if share > 0:
                        counts[(self.v.close if j == size else self.v.inner)[a]] += share
        return alpha[size]


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    if len(parts) == 1:
        return parts[0]
    s = np.stack(parts)
    top = s.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(s - safe).sum(axis=0))


def _log_sum_of(parts: list[float]) -> float:
    top = max(parts, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(x - top) for x in parts))


def by_length(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | bytes]]:
    """(places, matrix of their bytes) of words of equal length; long words by themselves, as bytes."""
    data, ends = raw_bytes(words)
    size = np.diff(ends)
    order = np.argsort(size, kind="stable")
    cuts = np.flatnonzero(np.diff(size[order])) + 1
    for group in np.split(order, cuts) if len(order) else []:
        n = int(size[group[0]])
        if n > LONG:
            for g in group:
                yield np.array([g]), data[ends[g]:ends[g + 1]].tobytes()
        elif n:
            for a in range(0, len(group), TOGETHER):
                part = group[a:a + TOGETHER]
                yield part, data[ends[part][:, None] + np.arange(n)]


# Training.

@dataclass(frozen=True)
class WordModel:
    """What scores need beside the counts themselves."""
    tokens: int       # N
    types: int        # V
    ends: int         # training texts
    discount: float
    pieces: Vocabulary


def word_counts(docs: DataFrame, trained: Column) -> DataFrame:
    """`w` (bytes of a word), `c` (its count in training texts) of every distinct word of all texts."""
    reach_workers(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            weight, done = np.asarray(b.column(1)).astype(np.int64), 0
            for part in chunks(b.column(0)):
                t = tokens(part, WORD_BYTES)
                _, first, which = np.unique(t.hashes, return_index=True, return_inverse=True)
                n = np.bincount(which, weights=weight[done:done + len(part)][t.owner], minlength=len(first)).astype(np.int64)
                done += len(part)
                yield pa.RecordBatch.from_arrays([t.spelled(first), pa.array(n)], ["w", "n"])

    rows = docs.select("_text", trained.cast("int").alias("trained"))
    return rows.mapInArrow(count, "w binary, n long").groupBy("w").agg(F.sum("n").alias("c"))


def expected_pieces(words: DataFrame, v: Vocabulary) -> np.ndarray:
    """Expected uses of every piece over the lattices of all words, each once. Tasks return one row a piece."""
    reach_workers(words.sparkSession)
    shared = words.sparkSession.sparkContext.broadcast(v)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        speller, counts = Speller(shared.value), np.zeros(len(shared.value.log_p))
        for b in batches:
            for _, part in by_length(b.column(0)):
                if isinstance(part, bytes):
                    speller.long_word(part, counts)
                else:
                    speller.add_expected(part, counts)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["piece", "x"])

    out = np.zeros(len(v.log_p))
    for r in words.select("w").mapInArrow(add, "piece int, x double").groupBy("piece").agg(F.sum("x").alias("x")).collect():
        out[r["piece"]] = r["x"]
    return out


def train(counted: DataFrame, ends: int, pieces: list[tuple[bytes, bool]], rounds: int = ROUNDS) -> WordModel:
    """The model of counted words and the number of training texts."""
    seen = counted.where("c > 0")
    s = seen.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"),
                 F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2")).first()
    v = vocabulary(pieces)
    for _ in range(rounds if s["v"] else 0):
        v = v.with_counts(expected_pieces(seen, v))
    n1, n2 = s["n1"] + (ends == 1), s["n2"] + (ends == 2)
    discount = min(0.95, max(0.05, n1 / (n1 + 2 * n2) if n1 else 0))
    return WordModel(int(s["n"]) + ends, int(s["v"]) + (ends > 0), ends, discount, v)


def log10_word(m: WordModel, count: np.ndarray, log_spell: np.ndarray) -> np.ndarray:
    """log10 P(word) of words seen `count` times in training."""
    if not m.tokens:
        return (log_spell - math.log(2)) / math.log(10)
    spelled_out = log_spell + math.log(m.discount * m.types / m.tokens)
    with np.errstate(divide="ignore"):
        whole_word = np.log(np.maximum(count - m.discount, 0) / m.tokens)
    return np.logaddexp(whole_word, spelled_out) / math.log(10)


def log10_end(m: WordModel) -> float:
    return math.log10((m.ends - m.discount) / m.tokens) if m.ends else math.log10(0.5)


def word_scores(counted: DataFrame, m: WordModel) -> DataFrame:
    """`h` (hash of a word), `c`, `score` (log10 probability)."""
    reach_workers(counted.sparkSession)
    shared = counted.sparkSession.sparkContext.broadcast(m)

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        speller = Speller(m.pieces)
        for b in batches:
            log_p = np.zeros(b.num_rows)
            for at, part in by_length(b.column(0)):
                log_p[at] = speller.long_word(part) if isinstance(part, bytes) else speller.log_spell(part)
            c = np.asarray(b.column(1))
            words = tokens(b.column(0), np.ones(256, bool))
            yield pa.RecordBatch.from_arrays([signed(words.hashes), b.column(1), pa.array(log10_word(m, c, log_p))], ["h", "c", "score"])

    return counted.select("w", "c").mapInArrow(spell, "h long, c long, score double")


def frequent(scored: DataFrame, most: int) -> tuple[int, list]:
    """(least count, words) of the frequent words: at most `most`, and all of that count or more."""
    eighths = F.floor(F.log2("c") * 8).cast("int")
    left, least = most, None
    for r in scored.where("c > 0").groupBy(eighths.alias("e")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("c")).orderBy(F.desc("e")).collect():
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    if least is None:
        return np.iinfo(np.int64).max, []
    return least, scored.where(F.col("c") >= least).collect()


# Scoring.

PART = "_key long, _id {0}, h long, n long, n_known long, base double, score double"


def text_parts(docs: DataFrame, known: list, m: WordModel) -> DataFrame:
    """Per text one row with the sums over its frequent words and the end (`h` null), and one row for each
    of its other words."""
    reach_workers(docs.sparkSession)
    h = np.array([r["h"] for r in known], np.int64).view(U)
    order = np.argsort(h)
    lists = (h[order], np.log10(np.array([r["c"] for r in known], float) + 1)[order], np.array([r["score"] for r in known], float)[order])
    shared = docs.sparkSession.sparkContext.broadcast((lists, log10_end(m), m.ends))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (keys, base, score), end, ends = shared.value
        names = ["_key", "_id", "h", "n", "n_known", "base", "score"]
        for b in batches:
            done = 0
            for part in chunks(b.column(2)):
                key, ids = b.column(0).slice(done, len(part)), b.column(1).slice(done, len(part))
                done += len(part)
                t = tokens(part, WORD_BYTES)
                owner, at = t.owner, sorted_lookup(keys, t.hashes)
                hit = at >= 0

                def total(x):
                    return np.bincount(owner[hit], weights=x[at[hit]], minlength=len(part)) if hit.any() else np.zeros(len(part))
                count = np.bincount(owner[hit], minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [key, ids, pa.nulls(len(part), pa.int64()), pa.array(t.counts + 1, pa.int64()), pa.array(count + (ends > 0), pa.int64()),
                     pa.array(total(base) + math.log10(ends + 1)), pa.array(total(score) + end)], names)
                if not hit.all():
                    rest = np.lexsort((t.hashes[~hit], owner[~hit]))
                    who, word = owner[~hit][rest], t.hashes[~hit][rest]
                    new = np.flatnonzero(np.append(True, (who[1:] != who[:-1]) | (word[1:] != word[:-1])))
                    n = np.diff(np.append(new, len(who)))
                    nothing = pa.nulls(len(new), pa.float64())
                    yield pa.RecordBatch.from_arrays(
                        [key.take(pa.array(who[new])), pa.nulls(len(new), ids.type), signed(word[new]), pa.array(n, pa.int64()),
                         pa.nulls(len(new), pa.int64()), nothing, nothing], names)

    kind = docs.schema["_id"].dataType.simpleString()
    return docs.select(F.xxhash64("_id", "_text").alias("_key"), "_id", "_text").mapInArrow(read, PART.format(kind))


def score(docs: DataFrame, vocabulary_path: str, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text",
          rounds: int = ROUNDS, most: int = FREQUENT) -> DataFrame:
    """`doc_id`, `held_out`, `n_tokens`, `n_known` (tokens seen in training), `train_tokens`, `base_score` (add-one counts),
    `score` (the lattice model). `held_out` is a condition on `_id`; rows it marks are not learned from."""
    d = whole(docs, id_col, text_col)
    out = F.coalesce(held_out, F.lit(False)) if held_out is not None else F.lit(False)
    pieces = read_pieces(vocabulary_path)
    counted = stored(word_counts(d, ~out), "word-counts")
    m = train(counted, d.where(~out).count(), pieces, rounds)
    scored = stored(word_scores(counted, m), "word-scores")
    least, known = frequent(scored, most)
    parts = stored(text_parts(d, known, m), "text-parts")
    rare = scored.where(F.col("c") < least).select(
        F.col("h").alias("rh"), F.log10(F.col("c") + 1).alias("rbase"), F.col("score").alias("rscore"), (F.col("c") > 0).cast("long").alias("rknown"))
    n = F.col("n")
    other = parts.where("h is not null").select("_key", "h", "n").join(rare, F.col("h") == F.col("rh")).groupBy("_key").agg(
        F.sum(n * F.col("rknown")).alias("n_known"), F.sum(n * F.col("rbase")).alias("base"), F.sum(n * F.col("rscore")).alias("score"))
    other = other.select("_key", F.lit(None).cast(parts.schema["_id"].dataType).alias("_id"), F.lit(0).cast("long").alias("n"), "n_known", "base", "score", F.lit(0).alias("row"))
    own = parts.where("h is null").select("_key", "_id", "n", "n_known", "base", "score", F.lit(1).alias("row"))
    sums = [F.sum(c).alias(c) for c in ("n", "n_known", "base", "score")]
    both = own.unionByName(other).groupBy("_key").agg(F.max("_id").alias("_id"), F.sum("row").alias("rows"), *sums)
    # Repeated rows share a key: their sums are alike, and each gets one row again.
    each = both.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("_one"))
    per_row = [(F.col(c) / F.col("rows")).alias(c) for c in ("base", "score")]
    whole_row = [F.expr(f"{c} div rows").alias(c) for c in ("n", "n_known")]
    unseen = math.log10(m.tokens + m.types + 1)
    return each.select("_id", *whole_row, *per_row).select(
        F.col("_id").alias("doc_id"), out.alias("held_out"), F.col("n").alias("n_tokens"), "n_known", F.lit(m.tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n") * F.lit(unseen)).alias("base_score"), "score")
