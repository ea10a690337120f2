"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's probability is a logistic function of the terms it
contains; the document's is the noisy-or of its sentences', 1 - prod(1 - p). Only document labels are
used in training, and the sentence scores then tell where the offence is.

Defined cases: a null or empty text has no sentence and scores the probability of an empty bag, 0;
repeated rows get equal scores; without any labels, or with one kind only, every score is 0; an empty
table gives an empty result. Texts of any length are scored in full.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhound.llm.common import learning_sample, reach_workers, stored, whole

# Labelled documents used to learn, at most.
SAMPLE_ROWS = 12_000
# Terms of the sentence model, at most; documents of the sample that a term must be in; and the
# log-likelihood gain it must bring.
TERMS = 1_000
TERM_DOCUMENTS = 5
TERM_GAIN = 6.0
# Word beginnings of these lengths are terms too: offensive stems come in many inflections.
STEMS = (4, 5, 6)
SENTENCE = re.compile(r"[.!?\n]+")
WORD = re.compile(r"\w+")
# Offending sentences reported for a document are those at or above this.
OFFENDING = 0.5
# Words whose terms a worker remembers.
REMEMBERED = 150_000


def terms_of(word: str) -> list[str]:
    """The word and its beginnings, the latter marked with a dash."""
    return [word, *(word[:k] + "-" for k in STEMS if len(word) > k)]


class Lexicon(dict):
    """word -> indices of its known terms, filled as words are met."""

    def __init__(self, index: dict[str, int]):
        super().__init__()
        self.index = index

    def __missing__(self, word: str) -> tuple[int, ...]:
        found = tuple(self.index[t] for t in terms_of(word) if t in self.index)
        if len(self) > REMEMBERED:
            self.clear()
        self[word] = found
        return found


@dataclass(frozen=True)
class SentenceModel:
    terms: list[str]
    weights: np.ndarray
    bias: float


def sentence_terms(text: str, lexicon: Lexicon) -> list[tuple[int, int, list[int]]]:
    """(start, end, known terms) of each sentence that has any known term. Whole texts."""
    if not any([lexicon[w] for w in set(WORD.findall(text.lower()))]):
        return []
    out, start = [], 0
    for m in itertools.chain(SENTENCE.finditer(text), [None]):
        end = m.start() if m else len(text)
        found = {i for w in WORD.findall(text[start:end].lower()) for i in lexicon[w]}
        if found:
            out.append((start, end, sorted(found)))
        start = m.end() if m else end
    return out


def sentences(text: str) -> int:
    return sum([1 for s in SENTENCE.split(text) if s and not s.isspace()])


def noisy_or(logits: list[float], plain: int, bias: float) -> float:
    """1 - prod(1 - p) over the scored sentences and `plain` sentences without a known term."""
    keep = sum(np.logaddexp(0.0, z) for z in logits) + plain * np.logaddexp(0.0, bias)
    return float(-math.expm1(-keep))


def choose_terms(sample: DataFrame, terms: int = TERMS, least: int = TERM_DOCUMENTS) -> list[str]:
    """The terms whose presence in a document speaks most for the label (G-test)."""
    reach_workers(sample.sparkSession)

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            n, k = Counter(), Counter()
            for text, label in zip(f["_text"], f["_label"]):
                present = {t for w in set(WORD.findall(text.lower())) for t in terms_of(w)}
                n.update(present)
                if label:
                    k.update(present)
            yield pd.DataFrame({"t": list(n), "n": list(n.values()), "k": [k[t] for t in n]})

    counts = sample.select("_text", "_label").mapInPandas(count, "t string, n long, k long")
    counts = counts.groupBy("t").agg(F.sum("n").alias("n"), F.sum("k").alias("k")).where(F.col("n") >= least)
    total = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_label"), F.lit(0)).alias("k")).first()
    n, k = int(total["n"]), int(total["k"])
    if k == 0 or k == n:
        return []
    rate = k / n

    def part(c, expected):
        return F.when(c > 0, c * F.log(c / expected)).otherwise(0.0)
    gain = part(F.col("k"), F.col("n") * rate) + part(F.col("n") - F.col("k"), F.col("n") * (1 - rate))
    best = counts.where(F.col("k") > F.col("n") * rate).select("t", gain.alias("gain")).where(F.col("gain") >= TERM_GAIN)
    return [r["t"] for r in best.orderBy(F.desc("gain"), "t").limit(terms).collect()]


def bags(sample: DataFrame, terms: list[str]) -> pd.DataFrame:
    """Per sampled document: label, number of sentences, and the term ids of its sentences that
    have any, each sentence closed by -1."""
    reach_workers(sample.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lexicon = Lexicon({t: i for i, t in enumerate(terms)})
        for f in frames:
            found = [sentence_terms(t, lexicon) for t in f["_text"]]
            yield pd.DataFrame({
                "id": f["_id"].astype(str), "label": f["_label"], "n": [sentences(t) for t in f["_text"]],
                "terms": [[i for *_, s in b for i in (*s, -1)] for b in found]})

    out = sample.mapInPandas(read, "id string, label int, n int, terms array<int>").toPandas()
    return out.sort_values(["id", "n"], kind="stable").reset_index(drop=True)


def fit(data: pd.DataFrame, terms: list[str], rounds: int = 300, decay: float = 5e-5, rate: float = 0.1) -> SentenceModel:
    """Maximum likelihood of the noisy-or with Adam steps over the whole sample."""
    if data.empty or not terms:
        return SentenceModel([], np.zeros(0), -30.0)
    row, col, sent_doc, s = [], [], [], 0
    for d, flat in enumerate(data["terms"]):
        for i in flat:
            if i < 0:
                sent_doc.append(d)
                s += 1
            else:
                row.append(s)
                col.append(i)
    row, col, sent_doc = np.array(row, int), np.array(col, int), np.array(sent_doc, int)
    y = data["label"].to_numpy(float)
    plain = data["n"].to_numpy(float) - np.bincount(sent_doc, minlength=len(y))
    w, b = np.zeros(len(terms)), -6.0
    m, v = np.zeros(len(terms) + 1), np.zeros(len(terms) + 1)
    for step in range(1, rounds + 1):
        z = b + np.bincount(row, weights=w[col], minlength=s)
        keep = np.bincount(sent_doc, weights=np.logaddexp(0, z), minlength=len(y)) + plain * np.logaddexp(0, b)
        p = np.clip(-np.expm1(-keep), 1e-9, 1)
        # d loss / d keep: for y = 1 -(1 - p) / p, for y = 0 one.
        g = np.where(y > 0, -(1 - p) / p, 1.0) / len(y)
        gz = g[sent_doc] / (1 + np.exp(-z))
        grad = np.append(np.bincount(col, weights=gz[row], minlength=len(w)) + decay * w, gz.sum() + (g * plain).sum() / (1 + math.exp(-b)))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return SentenceModel(list(terms), w, float(b))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS,
          id_col: str = "doc_id", text_col: str = "text") -> SentenceModel:
    """Learn from at most `rows` labelled documents that are not held out."""
    sample = stored(learning_sample(docs, labels, label, rows, id_col, text_col), "toxicity-sample")
    terms = choose_terms(sample)
    return fit(bags(sample, terms), terms)


def judged(text: str, m: SentenceModel, lexicon: Lexicon) -> tuple[float, list[dict]]:
    """(probability, offending sentences) of a text."""
    n = sentences(text)
    logits = [(a, b, m.bias + m.weights[t].sum()) for a, b, t in sentence_terms(text, lexicon)]
    cut = math.log(OFFENDING / (1 - OFFENDING))
    return noisy_or([z for *_, z in logits], n - len(logits), m.bias), [{"start": a, "end": b} for a, b, z in logits if z >= cut]


def scorer(spark: SparkSession, model: SentenceModel) -> Callable[[Column], Column]:
    """Column function text -> score; only the text column travels to Python."""
    reach_workers(spark)
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lexicon = Lexicon({t: i for i, t in enumerate(shared.value.terms)})
        for part in texts:
            yield pd.Series([judged(t, shared.value, lexicon)[0] for t in part], dtype=float)

    return lambda text: probability(F.coalesce(text.cast("string"), F.lit("")))


def score(docs: DataFrame, model: SentenceModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`doc_id`, `score`, and where the offence is: number and character spans (start, end)
    of the sentences at or above OFFENDING."""
    d = whole(docs, id_col, text_col)
    reach_workers(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon({t: i for i, t in enumerate(shared.value.terms)})
        for b in batches:
            got = [judged(t, shared.value, lexicon) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([s for s, _ in got], pa.float64()), pa.array([x for _, x in got], spans)],
                ["doc_id", "score", "offending"])

    kind = d.schema["_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, score double, offending array<struct<start:int,end:int>>")
