"""Hard negatives by angular triangle filtering.

Vectors become integers, x -> floor(scale * x), and every row stores its norm and its angles to a few
reference directions. Angles obey the triangle inequality, so the angle between an anchor a and a row v lies
within |angle(a, r) - angle(v, r)| and the lesser of angle(a, r) + angle(v, r) and 2 pi minus that sum, for
every reference r. The cosines of both ends times the norms bound the integer score; the bounds are
widened by more than the rounding of the stored angles (SLACK radians). Rows are stored by nearest reference
and angle to it, in runs of RUN rows whose least and largest angles and norms give one interval per anchor
and run. A run is scored, in integers, only if its interval overlaps the window an anchor still asks for:
at least its k-th best score so far, and for negatives within the share of the positive's score that counts.

Anchors are taken in blocks of at most BLOCK_ANCHORS rows, each of which is sent to every executor and
passes over all rows twice: for the positives, then for the negatives. A task keeps k rows per question. The
references are chosen from a sample of at most SAMPLE rows; they decide how much is skipped, never the result.

Defined cases: rows with a null label, a null or non-finite vector or component take no part; zero vectors
score zero with everything; vectors of unlike length have no score; rows that repeat id, label and integer vector
count once, rows that share an id only are rows of their own; a null id takes part as a candidate, behind all others
at equal scores; equal scores go by ascending id, then label; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyhound.llm.common import reach_workers, stored
from tallyhound.session import shared_folder, work_folder

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
# Share of the positive's score, in hundredths, that a negative's score must lie in.
SHARE = (30, 90)
BLOCK_ANCHORS = 2_048
SAMPLE = 2_048
REFERENCES = 16
RUN = 64
# Rows looked at together.
TOGETHER = 4_096
SLACK = 1e-5
# Sums of products below this are exact in doubles.
EXACT = float(2 ** 52)
NONE = np.iinfo(np.int64).min
ROW = "id {0}, label long, h long, q array<long>, norm double, angles array<float>, cell int, near double"


def integer_rows(vectors: DataFrame, id_col: str, label: Column, vector_col: str, scale: int) -> DataFrame:
    """`id`, `label`, `h`, `q` of every row that takes part, once."""
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), label.cast("long").alias("label"), v.alias("v")).where(
        F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))).select(
        "id", "label", F.transform("v", lambda x: F.floor(x * scale).cast("long")).alias("q"))
    return rows.groupBy("id", "label", F.xxhash64("q").alias("h")).agg(F.first("q").alias("q"))


def choose_references(sample: np.ndarray, n: int) -> np.ndarray:
    """Unit vectors of rows far from one another: each next one is farthest from those chosen."""
    norm = np.linalg.norm(sample, axis=1)
    unit = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(unit):
        return unit
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)):
        k = int(near.argmin())
        if near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, unit @ unit[k])
    return unit[chosen]


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows of lists as a matrix, which rows have that width); others are zero."""
    size = np.diff(np.asarray(column.offsets))
    fits = size == width
    values = np.asarray(column.flatten())
    out = np.zeros((len(column), width), values.dtype if len(values) else np.int64)
    out[fits] = values[np.repeat(fits, size)].reshape(int(fits.sum()), width)
    return out, fits


def angles(q: np.ndarray, norm: np.ndarray, references: np.ndarray) -> np.ndarray:
    cos = (q @ references.T) / np.maximum(norm, 1e-300)[:, None]
    return np.arccos(np.clip(cos, -1, 1))


def indexed(rows: DataFrame, references: np.ndarray) -> DataFrame:
    """The rows with norm, angles to the references, nearest reference and angle to it, stored by the latter."""
    reach_workers(rows.sparkSession)
    shared = rows.sparkSession.sparkContext.broadcast(references)
    n, width = references.shape

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            q, _ = matrix(b.column(3), width)
            q = q.astype(float)
            norm = np.sqrt((q * q).sum(axis=1))
            seen = angles(q, norm, shared.value) if n else np.zeros((len(q), 1))
            cell = seen.argmin(axis=1)
            offsets = pa.array(np.arange(len(q) + 1) * seen.shape[1], pa.int32())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(norm), pa.ListArray.from_arrays(offsets, pa.array(seen.astype(np.float32).ravel())),
                 pa.array(cell, pa.int32()), pa.array(seen[np.arange(len(q)), cell])],
                ["id", "label", "h", "q", "norm", "angles", "cell", "near"])

    made = rows.mapInArrow(look, ROW.format(rows.schema["id"].dataType.simpleString()))
    # Equal vectors, as of copies, are dealt over several tasks.
    return stored(made.repartitionByRange("cell", "near", "h", F.xxhash64("id")).sortWithinPartitions("cell", "near"), "angles")


@dataclass(frozen=True)
class Anchors:
    id: list
    label: np.ndarray
    h: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray


@dataclass(frozen=True)
class Asked:
    """Questions: the anchor asked for, the scores that count (both ends included), same label or another."""
    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


def intervals(a: Anchors, low: np.ndarray, high: np.ndarray, least_norm: np.ndarray, most_norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the scores of every (anchor, run); `low` and `high` are the runs' angles to each reference."""
    apart = np.zeros((len(a.norm), len(least_norm)))
    reach = np.full_like(apart, np.pi)
    for r in range(low.shape[1]):
        mine = a.angles[:, r][:, None]
        np.maximum(apart, np.maximum(mine - high[:, r], low[:, r] - mine), out=apart)
        np.minimum(reach, np.minimum(mine + high[:, r], 2 * np.pi - mine - low[:, r]), out=reach)
    top, bottom = np.cos(np.clip(apart - SLACK, 0, np.pi)), np.cos(np.clip(reach + SLACK, 0, np.pi))
    most = a.norm[:, None] * np.where(top >= 0, most_norm, least_norm) * top
    least = a.norm[:, None] * np.where(bottom >= 0, least_norm, most_norm) * bottom
    room = 1 + 1e-9 * a.norm[:, None] * most_norm
    return least - room, most + room


class Miner:
    """Keeps the best k rows of every question while rows go by."""

    def __init__(self, anchors: Anchors, asked: Asked):
        self.anchors, self.asked = anchors, asked
        self.best: list[list[tuple]] = [[] for _ in asked.anchor]
        self.low = asked.low.copy()
        self.of = [np.flatnonzero(asked.anchor == i) for i in range(len(anchors.label))]
        self.real = anchors.q.astype(float)
        self.scored = 0

    def add(self, ids: list, label: np.ndarray, h: np.ndarray, q: np.ndarray, fits: np.ndarray, norm: np.ndarray, seen: np.ndarray) -> None:
        a, asked = self.anchors, self.asked
        if not len(asked.anchor):
            return
        first = np.arange(0, len(label), RUN)
        least, most = intervals(a, np.minimum.reduceat(seen, first), np.maximum.reduceat(seen, first),
                                np.minimum.reduceat(norm, first), np.maximum.reduceat(norm, first))
        live = (most[asked.anchor] >= self.low[:, None]) & (least[asked.anchor] <= asked.high[:, None])
        wanted = np.zeros(least.shape, bool)
        np.logical_or.at(wanted, asked.anchor, live)
        score = np.full((len(a.label), len(label)), NONE)
        exact = a.norm.max(initial=0) * norm.max(initial=0) < EXACT
        real = q.astype(float) if exact else q
        for i, start in enumerate(first):
            who = np.flatnonzero(wanted[:, i])
            if len(who):
                stop = min(start + RUN, len(label))
                mine = self.real[who] if exact else a.q[who]
                score[who, start:stop] = (mine @ real[start:stop].T).astype(np.int64)
                self.scored += len(who) * (stop - start)
        score[:, ~fits] = NONE
        # Rows in the order of ties, so that the first of equal scores are the ones to keep.
        order = np.array(sorted(range(len(ids)), key=lambda j: (ids[j] is None, ids[j], label[j], h[j])))
        label, h = label[order], h[order]
        for i in np.flatnonzero(wanted.any(axis=1)):
            row = score[i][order]
            kind = (label == a.label[i]) == asked.same
            if asked.same:
                for j in np.flatnonzero((h == a.h[i]) & kind):
                    kind[j] = ids[order[j]] != a.id[i]
            near = np.flatnonzero((row >= self.low[self.of[i]].min()) & (row <= asked.high[self.of[i]].max()) & (row > NONE) & kind)
            for m in self.of[i] if len(near) else ():
                lo, hi = self.low[m], asked.high[m]
                inside = near[(row[near] >= lo) & (row[near] <= hi)]
                found = [(-int(row[j]), ids[order[j]] is None, ids[order[j]], int(label[j]), int(h[j])) for j in first_of(row, inside, asked.k)]
                if found:
                    kept = sorted(self.best[m] + found)[:asked.k]
                    self.best[m] = kept
                    if len(kept) == asked.k:
                        self.low[m] = max(lo, -kept[-1][0])


def first_of(score: np.ndarray, rows: np.ndarray, k: int) -> np.ndarray:
    """The k highest of `rows`, at equal scores those that come first."""
    if len(rows) <= k:
        return rows
    s = score[rows]
    least = np.partition(s, len(s) - k)[len(s) - k]
    above, equal = rows[s > least], rows[s == least]
    return np.concatenate([above, equal[:k - len(above)]])


def best_rows(rows: DataFrame, anchors: Anchors, asked: Asked) -> DataFrame:
    """The first k rows of every question: `m` (the question), `rank`, `id`, `label`, `h`, `score`."""
    shared = rows.sparkSession.sparkContext.broadcast((anchors, asked))
    kind = rows.schema["id"].dataType.simpleString()

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, asked = shared.value
        miner, id_type = Miner(anchors, asked), None
        for whole in batches:
            id_type = whole.column(0).type
            for at in range(0, whole.num_rows, TOGETHER):
                b = whole.slice(at, TOGETHER)
                q, fits = matrix(b.column(3), anchors.q.shape[1])
                seen, _ = matrix(b.column(5), anchors.angles.shape[1])
                miner.add(b.column(0).to_pylist(), np.asarray(b.column(1)), np.asarray(b.column(2)), q, fits, np.asarray(b.column(4)), seen.astype(float))
        out = [(m, i, lab, h, -s) for m, best in enumerate(miner.best) for s, _, i, lab, h in best]
        if out:
            m, i, lab, h, s = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(m, pa.int32()), pa.array(i, id_type), *(pa.array(x, pa.int64()) for x in (lab, h, s))],
                                             ["m", "id", "label", "h", "score"])

    found = rows.select("id", "label", "h", "q", "norm", "angles").mapInArrow(mine, f"m int, id {kind}, label long, h long, score long")
    order = Window.partitionBy("m").orderBy(F.desc("score"), F.asc_nulls_last("id"), "label", "h")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= asked.k)


def blocks(anchors: DataFrame, size: int) -> Iterator[list]:
    """The anchors in order, at most `size` at a time."""
    rest = anchors
    while True:
        got = rest.orderBy("id", "label", "h").limit(size).collect()
        if got:
            yield got
        if len(got) < size:
            return
        last = got[-1]
        after = [F.col(c) > F.lit(last[c]) for c in ("id", "label", "h")]
        same = [F.col(c) == F.lit(last[c]) for c in ("id", "label")]
        rest = anchors.where(after[0] | (same[0] & after[1]) | (same[0] & same[1] & after[2]))


def as_anchors(rows: list, width: int) -> Anchors:
    q = np.array([r["q"] for r in rows], np.int64).reshape(len(rows), width)
    return Anchors([r["id"] for r in rows], np.array([r["label"] for r in rows], np.int64), np.array([r["h"] for r in rows], np.int64), q,
                   np.array([r["norm"] for r in rows]), np.array([r["angles"] for r in rows], float))


def mine(vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", label: Column | str = "label", vector_col: str = "embedding",
         positives: int = POSITIVES, negatives: int = NEGATIVES, share: tuple[int, int] = SHARE, scale: int = SCALE,
         block: int = BLOCK_ANCHORS) -> DataFrame:
    """`anchor_id`, `positive_id`, `rank`, `negative_id`, `positive_score`, `negative_score`: for every anchor and each of its
    first `positives` rows of the same label, the first `negatives` rows of another label whose score lies within `share`
    hundredths of the positive's. `is_anchor` is a condition on `id`."""
    spark = vectors.sparkSession
    rows = integer_rows(vectors, id_col, F.col(label) if isinstance(label, str) else label, vector_col, scale)
    rows = stored(rows, "integer-vectors")
    id_type = rows.schema["id"].dataType.simpleString()
    ddl = f"anchor_id {id_type}, positive_id {id_type}, rank int, negative_id {id_type}, positive_score long, negative_score long"
    sample = rows.orderBy(F.xxhash64("h", "id"), "id").select("q").limit(SAMPLE).collect()
    widths = [r["n"] for r in rows.where(is_anchor).select(F.size("q").alias("n")).distinct().orderBy("n").collect()]
    shared_folder(spark)
    folder, n = work_folder(spark, "hard-negatives"), 0
    for width in widths:
        like = [r["q"] for r in sample if len(r["q"]) == width]
        kept = indexed(rows.where(F.size("q") == width), choose_references(np.array(like, float).reshape(len(like), width), REFERENCES))
        for part in blocks(kept.where(is_anchor), block):
            _block(kept, as_anchors(part, width), positives, negatives, share, ddl).write.parquet(f"{folder}/{n}")
            n += 1
    return spark.read.schema(ddl).parquet(*[f"{folder}/{i}" for i in range(n)]) if n else spark.createDataFrame([], ddl)


def _block(kept: DataFrame, anchors: Anchors, positives: int, negatives: int, share: tuple[int, int], ddl: str) -> DataFrame:
    spark = kept.sparkSession
    every = np.arange(len(anchors.label))
    limits = np.iinfo(np.int64)
    # At most `positives` rows per anchor of the block come back.
    good = best_rows(kept, anchors, Asked(every, np.full(len(every), limits.min + 1), np.full(len(every), limits.max), True, positives)).collect()
    good.sort(key=lambda r: (r["m"], r["rank"]))
    points = [int(r["score"]) for r in good]
    asked = Asked(np.array([r["m"] for r in good], int), np.array([-(-share[0] * s // 100) for s in points], np.int64),
                  np.array([share[1] * s // 100 for s in points], np.int64), False, negatives)
    id_type = kept.schema["id"].dataType.simpleString()
    pairs = spark.createDataFrame([(i, anchors.id[r["m"]], r["id"], points[i]) for i, r in enumerate(good)],
                                  f"pm int, anchor_id {id_type}, positive_id {id_type}, positive_score long")
    found = best_rows(kept, anchors, asked)
    out = found.join(F.broadcast(pairs), F.col("m") == F.col("pm"))
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
