"""Document quality by attention-based multiple-instance learning.

A text is cut into passages of 64 words (the last may be shorter). Each passage is encoded from counts
over its bytes and words, h = tanh(W x + c). Gated attention weighs the passages,
a = softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is a logistic function of the
weighted sum of the h. Everything is learned together, from document labels alone.

Defined cases: a text without words (null included) is one passage of zeros and is scored like any
other; repeated rows get equal scores; without labels of both kinds every score is the share of good
labels (0.5 without labels); an empty table gives an empty result. All passages of a text count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyhound.llm.common import learning_sample, reach_workers, stored, whole
from tallyhound.llm.words import chunks

# Labelled documents used to learn, at most; each sends all its passages, of a few numbers each.
SAMPLE_ROWS = 4_000
PASSAGE_WORDS = 64
# Byte classes, counted per passage.
CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "stop": b".?", "comma": b",;:", "shout": b"!",
           "bar": b"|", "symbol": b"#$%&*<>=~^_\\/@+", "bracket": b"()[]{}\"'`-", "line": b"\n"}
FEATURES = [*CLASSES, "wide", "word_bytes", "short_words", "capital_words", "marked_words", "repeated_words", "words"]


def _tables():
    cls = np.zeros(256, np.uint8)
    for k, chars in enumerate(CLASSES.values(), 1):
        cls[list(chars)] = k
    cls[128:] = len(CLASSES) + 1
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    rng = np.random.default_rng(7)
    return cls, blank, rng.integers(1, 2**63, 256, np.uint64) | np.uint64(1), rng.integers(1, 2**63, 64, np.uint64) | np.uint64(1)


CLASS, BLANK, BYTE_HASH, PLACE_HASH = _tables()


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(features of all passages, number of passages of each text)."""
    texts = texts.cast(pa.large_string())
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + n + 1]
    lo, hi = int(ends[0]), int(ends[-1])
    data = np.frombuffer(texts.buffers()[2], np.uint8)[lo:hi] if hi > lo else np.zeros(0, np.uint8)
    ends = ends - lo
    word = ~BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    starts = word.copy()
    starts[1:] &= ~word[:-1] | edge[1:-1]
    first = np.flatnonzero(starts)
    doc = np.searchsorted(ends, first, side="right") - 1
    words = np.bincount(doc, minlength=n)
    nth = np.arange(len(first)) - np.repeat(np.cumsum(words) - words, words)
    count = np.maximum(1, -(-words // PASSAGE_WORDS))
    base = np.cumsum(count) - count
    out = np.zeros((int(count.sum()), len(FEATURES)))
    if not len(first):
        return out, count
    opens = np.flatnonzero(nth % PASSAGE_WORDS == 0)
    at = base[doc[opens]] + nth[opens] // PASSAGE_WORDS
    cls = CLASS[data[first[0]:]]
    cut = first[opens] - first[0]
    for k in range(1, len(CLASSES) + 2):
        out[at, k - 1] = np.add.reduceat(cls == k, cut, dtype=np.int64)
    # Words, by byte sums from one word start to the next.
    place = np.arange(len(data))
    place[first[0]:] -= np.repeat(first, np.diff(np.append(first, len(data))))
    mixed = BYTE_HASH[data] * PLACE_HASH[place & 63]
    mixed[~word] = 0
    size = np.add.reduceat(word, first, dtype=np.int64)
    key = np.add.reduceat(mixed, first) ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, once = np.unique(key, return_index=True)
    again = np.ones(len(first), bool)
    again[once] = False
    is_class = CLASS[data]
    capital = np.add.reduceat(is_class == 1, first, dtype=np.int64) * 2 > size
    marks = np.add.reduceat((is_class >= 5) & (is_class <= 7), first, dtype=np.int64) > 0
    total = np.add.reduceat(np.ones(len(first)), opens)
    j = len(CLASSES) + 1
    for v in (size, size <= 3, capital & (size > 1), marks, again):
        out[at, j] = np.add.reduceat(v.astype(float), opens)
        j += 1
    bytes_ = np.maximum(out[at, len(CLASSES) + 1], 1)
    out[at, : len(CLASSES) + 1] /= bytes_[:, None]
    out[at, len(CLASSES) + 1] /= 10 * total
    out[at, len(CLASSES) + 2: j] /= total[:, None]
    out[at, j] = total / PASSAGE_WORDS
    # Shares close to 0 tell most.
    return np.sqrt(out), count


@dataclass(frozen=True)
class AttentionModel:
    mean: np.ndarray
    std: np.ndarray
    params: dict[str, np.ndarray]

    def score(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return forward(self.params, (x - self.mean) / self.std, count)["p"]


def forward(q: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    starts = np.cumsum(count) - count
    h = np.tanh(x @ q["W"] + q["c"])
    t, g = np.tanh(h @ q["V"]), 1 / (1 + np.exp(-(h @ q["U"])))
    e = (t * g) @ q["w"]
    e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), count))
    a = e / np.repeat(np.add.reduceat(e, starts), count)
    z = np.add.reduceat(h * a[:, None], starts, axis=0)
    return {"h": h, "t": t, "g": g, "a": a, "z": z, "p": 1 / (1 + np.exp(-np.clip(z @ q["o"] + q["b"], -30, 30)))}


def gradients(q: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean log-loss."""
    f = forward(q, x, count)
    starts = np.cumsum(count) - count
    dp = (f["p"] - y) / len(y)
    dz = np.repeat(dp[:, None] * q["o"], count, axis=0)
    da = (dz * f["h"]).sum(1)
    de = f["a"] * (da - np.repeat(np.add.reduceat(da * f["a"], starts), count))
    dt, dg = de[:, None] * q["w"] * f["g"], de[:, None] * q["w"] * f["t"]
    dt, dg = dt * (1 - f["t"] ** 2), dg * f["g"] * (1 - f["g"])
    dh = dz * f["a"][:, None] + dt @ q["V"].T + dg @ q["U"].T
    dh *= 1 - f["h"] ** 2
    return {"W": x.T @ dh, "c": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "w": ((f["t"] * f["g"]) * de[:, None]).sum(0), "o": f["z"].T @ dp, "b": dp.sum()}


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, width: int = 16, gate: int = 8, rounds: int = 200,
        decay: float = 1e-4, rate: float = 0.03) -> AttentionModel:
    """Adam over the whole sample."""
    rng = np.random.default_rng(11)
    n = len(FEATURES)
    q = {"W": rng.normal(0, n ** -0.5, (n, width)), "c": np.zeros(width), "V": rng.normal(0, width ** -0.5, (width, gate)),
         "U": rng.normal(0, width ** -0.5, (width, gate)), "w": rng.normal(0, gate ** -0.5, gate), "o": np.zeros(width), "b": np.zeros(())}
    good = y.mean() if len(y) else 0.5
    if not len(y) or not 0 < good < 1:
        good = float(np.clip(good, 1e-3, 1 - 1e-3))
        return AttentionModel(np.zeros(n), np.ones(n), q | {"b": np.array(np.log(good / (1 - good)))})
    q["b"] = np.array(np.log(good / (1 - good)))
    mean, std = x.mean(0), x.std(0) + 1e-3
    x = (x - mean) / std
    m, v = ({k: np.zeros_like(a) for k, a in q.items()} for _ in range(2))
    for step in range(1, rounds + 1):
        pace = rate * min(1.0, 2 * (1 - step / (rounds + 1)))
        for k, g in gradients(q, x, count, y).items():
            g = g + decay * q[k] * (k != "b")
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
            q[k] = q[k] - pace * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
    return AttentionModel(mean, std, q)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> AttentionModel:
    """Learn from at most `rows` labelled documents that are not held out."""
    sample = stored(learning_sample(docs, labels, label, rows, id_col, text_col), "quality-sample")
    reach_workers(docs.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in chunks(b.column(1)):
                x, count = passages(part)
                split = np.split(x, np.cumsum(count)[:-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)).cast(pa.string()), b.column(2).slice(at, len(part)).cast(pa.int32()), pa.array([s.ravel().astype(np.float32) for s in split], pa.list_(pa.float32()))],
                    ["id", "label", "x"])
                at += len(part)

    data: pd.DataFrame = sample.mapInArrow(read, "id string, label int, x array<float>").toPandas()
    data = data.sort_values("id", kind="stable")
    if data.empty:
        return fit(np.zeros((0, len(FEATURES))), np.zeros(0, int), np.zeros(0))
    rows_ = [np.asarray(v, float).reshape(-1, len(FEATURES)) for v in data["x"]]
    return fit(np.concatenate(rows_), np.array([len(r) for r in rows_]), data["label"].to_numpy(float))


def score(docs: DataFrame, model: AttentionModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `score` (0 to 1, higher: better) and `passages` of every row."""
    d = whole(docs, id_col, text_col)
    reach_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            at = 0
            for part in chunks(b.column(1)):
                x, count = passages(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)), pa.array(m.score(x, count), pa.float64()), pa.array(count.astype(np.int32))],
                    ["doc_id", "score", "passages"])
                at += len(part)

    return d.mapInArrow(run, f"doc_id {d.schema['_id'].dataType.simpleString()}, score double, passages int")
